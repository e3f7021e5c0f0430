from __future__ import annotations

import base64
import gzip
import hashlib
import io
import os
import random
import re
import time
from html.parser import HTMLParser

import pytest

from quarry.llm import html_text as H
from quarry.llm import warc as W


@pytest.mark.parametrize(("source", "want"), [
    (None, ""), ("", ""), ("   ", ""), ("plain &amp; simple", "plain & simple"), ("a<b>b</b>c <i> d", "abc d"),
    ("<p>one<p>two", "one\n\ntwo"), ("<ul><li>a<li>b<ol start=3><li>x<li>y</ol></ul>", "- a\n- b\n  3. x\n  4. y"),
    ("<div>a</div><div>b<br>c</div>", "a\nb\nc"), ("x<script>var t='</p>';</script>y<style>p{}</style>z", "xyz"),
    ("<head><title>T</title></head><body>shown", "shown"), ("<p hidden>no</p><p style='display: none'>no</p><p>yes", "yes"),
    ("<table><tr><th>Name<th>N<tr><td>ab<td>1</table>", "Name | N\nab   | 1"), ("<table><tr><td rowspan=2>r<td>2<tr><td>3</table>", "r | 2\n  | 3"),
    ("<pre>  a\n   b</pre>", "  a\n   b"), ("1 < 2 > 0", "1 < 2 > 0"), ("<!-- x --><p>y<!-- z", "y"), ("</p>a</div>", "a"),
    ("<blockquote><p>q</blockquote>r", "> q\n\nr"), ("<h1>H<p>t", "H\n\nt"), ("<dl><dt>k<dd>v</dl>", "k\n    v"), ("<td>loose</td>", "loose"),
    ("<img alt='pic'> <input value=yes> <textarea>t\nu</textarea>", "pic yes t\nu"), ("<input type=submit value=Go><input type=hidden value=no><button>Ok</button>", "Go Ok"),
    ("<pre>\na\n\n\nb</pre>", "a\n\n\nb"), ("a<br><br><br>b", "a\n\n\nb"), ("<p>a</p><div><p>b</p></div>", "a\n\nb"),
    ("x <svg><title>no</title><g/><text x=1>lab<tspan>el</tspan></text><path d=1>no</path><foreignObject><p>in</p></foreignObject></svg>", "x label\n\nin"),
    ("<math><mi>a</mi><mo>+</mo><mn>1</mn><annotation>no</annotation></math>", "a+1"), ("<map><p>m</p><area alt=x></map>", "m"),
    ("<object data=x>no</object><object>yes</object>", "yes"), ("<a href=\"x y='\">q</a><b \">r</b>", "qr"), ("a<b", "a"), ("<p title=\"a>b\">c", "c"),
    ("<table><tr><td colspan=2>ab<td>c<tr><td>1<td>2<td>3</table>", "ab |   | c\n1  | 2 | 3"), ("<table><tr><td rowspan=0>r<td>2<tr><td>3<tr><td>4</table>", "r | 2\n  | 3\n  | 4"),
])
def test_render(source, want):
    assert H.render(source).strip("\n") == want


def test_deep_and_broken_markup_is_repaired():
    assert H.render("<b>" * 50 + "x" + "</i>" * 50) == "x"
    assert H.render("<table><tr><td><table><tr><td>in</table></table>out").split() == ["in", "out"]


@pytest.mark.parametrize("tag", ["div", "b", "blockquote", "ul><li", "table><tr><td", "svg><g", "ol><li><p", "dl><dd"])
def test_nesting_has_no_limit(tag):
    n = 100_000 if tag.count("<") == 0 else 20_000
    assert H.render(f"<{tag}>" * n + "<text>deep").split()[-1] == "deep"


def test_unclosed_and_wrong_tags_take_linear_time():
    def seconds(n):
        began = time.perf_counter()
        assert H.render("<p><b>" * n + "x" + "</i></p>" * n + "<a \"" * n + "<!-" * n + "y").startswith("x")
        return time.perf_counter() - began

    seconds(1000)
    assert seconds(40_000) < 40 * max(seconds(4_000), 0.02)


class _Plain(HTMLParser):
    """Words of visible elements in the order of the source, by the standard library's tokeniser."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.hidden, self.parts = 0, []

    def handle_starttag(self, tag, attrs):
        if tag in ("head", "script", "style", "title"):
            self.hidden += 1
        elif tag in H.BLOCK | {"br", "td", "th"}:
            self.parts.append("\n")

    def handle_endtag(self, tag):
        if tag in ("head", "script", "style", "title"):
            self.hidden -= 1
        elif tag in H.BLOCK:
            self.parts.append("\n")

    def handle_data(self, data):
        if not self.hidden:
            self.parts.append(re.sub("[ \t\n\r\f]+", " ", data))

    def lines(self):
        return [re.sub(" +", " ", x).strip(" ") for x in "".join(self.parts).replace("\xa0", " ").split("\n") if x.strip(" ")]


def test_the_query_against_a_plain_extractor(spark, sf):
    """All pages: the same lines in the same order, but for list marks and empty lines."""
    pages = {r["page_id"]: r["html"] for r in spark.read.parquet(f"{sf}/pages.parquet").collect()}
    rows = H.op5_html_text(spark, sf).collect()
    assert {r["page_id"] for r in rows} == set(pages) and len(rows) == len(pages)
    for r in rows:
        plain = _Plain()
        plain.feed(pages[r["page_id"]] or "")
        got = [re.sub("^ *- ", "", x).replace("  ", " ").strip(" ") for x in r["text"].split("\n") if x.strip()]
        assert got == [re.sub("^ *- ", "", x) for x in plain.lines()]
        assert r["n_chars"] == len(r["text"]) and r["n_lines"] == len(r["text"].split("\n"))


def test_extract_rows(spark):
    rows = [(1, "u", "<title>A &amp; b</title><p>x"), (2, None, None), (None, "u", ""), (1, "u", "<title>A &amp; b</title><p>x")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "1 AS id", "'c' AS text")
    got = H.extract(pages).collect()
    assert sorted((r["page_id"] or 0, r["title"], r["text"], r["n_lines"]) for r in got) == [(0, "", "", 0), (1, "A & b", "x", 1), (1, "A & b", "x", 1), (2, "", "", 0)]
    assert H.extract(pages.limit(0)).count() == 0


def test_records_split_at_any_byte():
    data = b"".join(W.record(i, "http://x/ y", os.urandom(60) * (i % 9), "A" * 32, None, False) for i in range(60)) + b"\x1f\x8b\x08 not a member"
    for size in (1, 7, 100, 1 << 12, 1 << 20) if len(data) < 60_000 else (97, 1000, 1 << 20):
        got = [h["warc-record-id"] for s in range(0, len(data), size) for _, h, _ in W.records(io.BytesIO(data), s, min(s + size, len(data)))]
        assert got == [f"<urn:page:{i}>" for i in range(60)]


def test_false_magic_inside_a_payload():
    inner = gzip.compress(b"not a record", mtime=0)
    data = W.record(1, "u", inner * 50, "A" * 32, None, False) + W.record(2, "u", b"", "A" * 32, 1, True)
    assert [len(b) - b.find(b"\r\n\r\n") - 4 for _, _, b in W.records(io.BytesIO(data), 0, len(data))] == [len(inner) * 50, 0]


def test_warc_rows(spark, tmp_path):
    rows = [(1, "http://a b", "x"), (2, None, "x"), (3, "u", None), (4, "u", ""), (4, "u", ""), (None, "u", "z"), (6, "u", "é" * 50_000), (7, "u", "only")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "1 AS id", "'c' AS payload")
    archives = W.write_warc(pages, f"file://{tmp_path}/w")
    for split in (50, 1 << 20):
        got = sorted((r["page_id"] or 0, r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"] or 0) for r in W.read_warc(archives, split).collect())
        sha = lambda s: base64.b32encode(hashlib.sha1(s.encode()).digest()).decode()
        want = [(0, 1, sha("z"), "response", 0), (1, 1, sha("x"), "revisit", 2), (2, 1, sha("x"), "response", 0), (3, 0, sha(""), "revisit", 4), (4, 0, sha(""), "response", 0), (4, 0, sha(""), "revisit", 4), (6, 100_000, sha("é" * 50_000), "response", 0), (7, 4, sha("only"), "response", 0)]
        assert got == sorted(want)
    assert W.read_warc(W.write_warc(pages.limit(0), f"file://{tmp_path}/e")).count() == 0


def test_rows_without_an_id_leave_one_response(spark, tmp_path):
    rows = [(None, f"u{k % 40}", "same") for k in range(200)] + [(None, f"u{k % 40}", "held") for k in range(50)] + [(9, "u", "held")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(4)
    got = W.read_warc(W.write_warc(pages, f"file://{tmp_path}/n")).collect()
    kinds = sorted((r["payload_digest"], r["record_type"], r["page_id"] or 0, r["refers_to"] or 0) for r in got)
    sha = lambda s: base64.b32encode(hashlib.sha1(s.encode()).digest()).decode()
    want = [(sha("same"), "response", 0, 0)] + [(sha("same"), "revisit", 0, 0)] * 199 + [(sha("held"), "response", 9, 0)] + [(sha("held"), "revisit", 0, 9)] * 50
    assert kinds == sorted(want)


def _columns(table):
    """Columns of the cells of a table [[(text, across, down), ...], ...] by marking every covered field."""
    covered, out = set(), []
    for r, row in enumerate(table):
        at = 0
        for text, across, down in row:
            while (r, at) in covered and r:
                at += 1
            if text:
                out.append((r, at, text))
            if down != 1:
                for c in range(at, at + across):
                    covered -= {(x, c) for x in range(r + 1, len(table))}
                    covered |= {(x, c) for x in range(r + 1, len(table) if down == 0 else min(len(table), r + down))}
            at += across
    return out


def test_cells_find_their_columns_under_spans():
    rng = random.Random(8)
    for _ in range(400):
        table = [[(rng.choice(["", "x", "y"]), rng.choice([1, 1, 2, 4]), rng.choice([0, 1, 1, 2, 3, 5])) for _ in range(rng.randrange(6))] for _ in range(rng.randrange(1, 9))]
        grid = H.Table()
        for row in table:
            grid.row()
            for text, across, down in row:
                grid.place([text] if text else [], across, down or 1 << 30)
        assert [(r, c, cell[0]) for r, row in enumerate(grid.rows) for c, cell in row.items()] == _columns(table)


def test_open_spans_take_linear_time():
    page = "<table>" + "<tr><td rowspan=100000>x" * 20_000
    began = time.perf_counter()
    assert H.render(page).split() == ["x"] * 20_000
    assert time.perf_counter() - began < 10
    assert H.render("<table><tr><td rowspan=2>a<td>b<tr><td>c") == "a | b\n  | c"
