"""Column expressions over text; all run inside the JVM."""

from __future__ import annotations

import re
from functools import reduce

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from quarry import config
from quarry.config import DEFAULT

# What counts as a lexical token (hex with and without underscores, versions, numbers with a unit, identifiers), and
# what counts as an exact literal (hex, versions, numbers).
TOKEN = r"(?<![a-z0-9_])(?:0x[0-9a-f]+(?:_[0-9a-f]+)+|0x[0-9a-f]+|v?\d+(?:\.\d+)+(?:[a-z]+)?|\d+(?:[a-z]+)?|[a-z_][a-z0-9_]*)(?![a-z0-9_])"
LITERAL = r"(?i)(?<![A-Za-z0-9_])(?:0x[0-9A-Fa-f]+(?:_[0-9A-Fa-f]+)+|0x[0-9A-Fa-f]+|v?\d+(?:\.\d+)+|\d+)(?![A-Za-z0-9_])"
CJK = "[\\u4e00-\\u9fff]"


def _col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def all_matches(c: str | Column, pattern: str) -> Column:
    return F.regexp_extract_all(_col(c), F.lit(pattern), F.lit(0))


def contains_any(c: str | Column, words: list[str]) -> Column:
    return _col(c).rlike("|".join(re.escape(w) for w in words))


def first_of(cases: dict[str, Column], default: str) -> Column:
    """Name of the first true condition."""
    out = None
    for name, cond in cases.items():
        out = F.when(cond, name) if out is None else out.when(cond, name)
    return out.otherwise(default)


def lexical_tokens(c: str | Column) -> Column:
    """Tokens for BM25, repeats kept: ASCII tokens, hex values also without underscores, CJK runs of one or two."""
    low = F.lower(_col(c))

    def with_plain_hex(found: Column) -> Column:
        return F.concat(found, F.transform(F.filter(found, lambda t: t.startswith("0x") & t.contains("_")), lambda t: F.replace(t, F.lit("_"), F.lit(""))))

    ascii_ = F.flatten(F.transform(F.array(all_matches(low, TOKEN)), with_plain_hex))  # bound to a name, so found once
    every = F.concat(ascii_, F.when(low.rlike(CJK), all_matches(low, CJK + "{1,2}")).otherwise(F.array().cast("array<string>")))
    return F.filter(every, lambda t: ((F.length(t) > 1) | ((t >= "0") & (t <= "9"))) & ~t.isin(config.STOPWORDS))  # a hash lookup


def keywords(c: str | Column) -> Column:
    """Distinct words of over two characters, and CJK runs, without stopwords."""
    low = F.lower(_col(c))
    words = F.split(F.trim(F.regexp_replace(low, r"[^\p{L}\p{N}_\s\-]|\s+", " ")), " +")
    return F.array_distinct(F.concat(F.filter(words, lambda w: (F.length(w) > 2) & ~w.isin(config.STOPWORDS)), F.filter(all_matches(low, CJK + "{2,}"), lambda w: ~w.isin(config.STOPWORDS))))


def exact_literals(c: str | Column) -> Column:
    """Distinct numbers, versions and hex values, the latter with and without underscores."""
    found = F.transform(all_matches(c, LITERAL), F.lower)
    return F.array_distinct(F.concat(found, F.transform(F.filter(found, lambda t: t.startswith("0x") & t.contains("_")), lambda t: F.replace(t, F.lit("_"), F.lit("")))))


def type_by_name(c: str | Column) -> Column:
    low = F.lower(_col(c))
    return first_of({t: contains_any(low, ws) for t, ws in config.TYPE_BY_NAME.items()}, "doc")


def type_by_content(c: str | Column, by_name: str | Column | None = None) -> Column:
    """The type with most pattern hits in the first 2000 characters, from two hits; the earlier type wins a tie."""
    head = F.substring(_col(c), 1, 2000)
    hits = {t: reduce(lambda a, b: a + b, [head.rlike(p).cast("int") for p in ps]) for t, ps in config.TYPE_BY_CONTENT.items()}
    top = F.greatest(*hits.values())
    found = F.when(top >= 2, first_of({t: h == top for t, h in hits.items()}, "doc")).otherwise("doc")
    return found if by_name is None else F.when(_col(by_name) != "doc", _col(by_name)).otherwise(found)


def content_type(c: str | Column, base: str | Column) -> Column:
    b = _col(base)
    return F.when(b.isin("diagram", "chat"), b).when(contains_any(F.upper(_col(c)), [w.upper() for w in config.WARNINGS]), "warning").otherwise(b)


def chunk_size(t: str | Column) -> Column:
    return first_size(t, 0)


def first_size(t: str | Column, k: int) -> Column:
    out = None
    for name, v in config.DEFAULT.chunk_settings.items():
        if name != "default":
            out = F.when(_col(t) == name, v[k]) if out is None else out.when(_col(t) == name, v[k])
    return out.otherwise(DEFAULT.chunk_settings["default"][k])


def chunk_overlap(t: str | Column) -> Column:
    return first_size(t, 1)


def is_numeric_question(c: str | Column) -> Column:
    return _col(c).rlike(config.NUMERIC_QUESTION)


def question_class(c: str | Column) -> Column:
    low = F.lower(_col(c))
    return first_of({k: contains_any(low, ws) for k, ws in config.QUESTION_CLASSES.items()}, "general")


def is_noisy(c: str | Column, top: Column | None = None) -> Column:
    """Under 50 characters, over half one character, or under 0.3 letters; top: the count of the most frequent character, if known."""
    t = _col(c)
    most = most_frequent_char_count(t) if top is None else top
    letters = F.length(F.regexp_replace(t, r"[^\p{L}]", ""))
    return F.when(F.length(t) < 50, True).otherwise((most / F.length(t) > 0.5) | (letters / F.length(t) < 0.3))


def most_frequent_char_count(c: str | Column) -> Column:
    """Occurrences of the most frequent character, 0 for none; characters are counted in one pass over Arrow batches."""

    @F.pandas_udf("int")
    def top(texts: pd.Series) -> pd.Series:
        import numpy as np

        def count(s: str | None) -> int:
            if not s:
                return 0
            codes = np.frombuffer(s.encode("utf-32-le", "surrogatepass"), np.uint32)
            return int(np.bincount(codes).max() if codes.max() < 1 << 16 else np.unique(codes, return_counts=True)[1].max())

        return texts.map(count, na_action=None)

    return top(_col(c))


def estimate_tokens(c: str | Column) -> Column:
    """Tokens of a text by its characters: CJK at 1.5 each, others at 4."""
    cjk = F.length(F.regexp_replace(_col(c), "[^\\u4e00-\\u9fff]", ""))
    return F.floor(cjk / 1.5 + (F.length(_col(c)) - cjk) / 4).cast("long")


def chars_to_tokens(n: str | Column) -> Column:
    return F.floor(_col(n) / DEFAULT.chars_per_token).cast("long")


def collapse_blanks(c: str | Column) -> Column:
    return F.trim(F.regexp_replace(_col(c), "[\\s\\u3000\\u00a0]+", " "))


def strip(c: str | Column) -> Column:
    """c without white space of any kind at its ends."""
    return F.regexp_replace(_col(c), r"^[\s\p{Z}]+|[\s\p{Z}]+$", "")


def normalize_line(line: Column) -> Column:
    """Pipe rows of two cells and bullets become 'key: value'; null drops the line."""
    cells = F.filter(F.transform(F.split(line, "\\|"), strip), lambda x: x != "")
    bullet = r"^[\-\*•]\s*(.+?):\s*(.+)$"
    pipes = F.length(line) - F.length(F.replace(line, F.lit("|"), F.lit("")))
    dashes = F.forall(cells, lambda x: x.startswith("-"))
    row = F.when(F.size(cells) >= 3, line).when((F.size(cells) >= 2) & ~dashes, F.concat(F.get(cells, F.lit(0)), F.lit(": "), F.get(cells, F.lit(1))))
    item = strip(line)
    return F.when(pipes >= 2, row).when(item.rlike(bullet), F.concat(F.regexp_extract(item, bullet, 1), F.lit(": "), F.regexp_extract(item, bullet, 2))).otherwise(line)


def normalize_tables(c: str | Column) -> Column:
    return F.array_join(F.filter(F.transform(F.split(_col(c), "\n"), normalize_line), lambda x: x.isNotNull()), "\n")


def code_tokens(c: str | Column) -> Column:
    """Identifiers of three characters or more with their snake and camel parts, without stopwords."""
    stop = F.array(*map(F.lit, config.CODE_STOPWORDS))
    raw = F.filter(F.array_distinct(all_matches(c, "[A-Za-z_][A-Za-z0-9_]{2,}")), lambda t: ~F.array_contains(stop, F.lower(t)))
    parts = F.flatten(F.transform(raw, lambda t: F.concat(F.split(t, "_"), all_matches(t, "[A-Z]?[a-z]+|[A-Z]+(?=[A-Z]|$)"))))
    return F.array_sort(F.array_distinct(F.concat(raw, F.filter(parts, lambda p: (F.length(p) >= 3) & ~F.array_contains(stop, F.lower(p))))))


def url_name(c: str | Column) -> Column:
    """Host without www. and with underscores, and the last segment of the path."""
    u = _col(c)
    host = F.translate(F.replace(F.regexp_extract(u, r"^[a-zA-Z][a-zA-Z0-9+.\-]*://([^/?#]*)", 1), F.lit("www."), F.lit("")), ".:", "__")
    path = F.regexp_extract(u, r"^[a-zA-Z][a-zA-Z0-9+.\-]*://[^/?#]*([^?#]*)", 1)
    last = F.regexp_extract(path, r"([^/]+)/*$", 1)
    return F.when(last == "", host).otherwise(F.concat(host, F.lit("_"), F.regexp_replace(last, r"[^\p{L}\p{N}_\-]", "_")))


def page_title(c: str | Column) -> Column:
    return F.regexp_extract(_col(c), r"(?i)<title[^>]*>([^<]+)</title>", 1)


def chunk_key(source: Column, page: Column, index: Column, content: Column) -> Column:
    return F.concat(source, F.lit("::p"), page.cast("string"), F.lit("::c"), index.cast("string"), F.lit("::"), F.substring(F.md5(content.cast("binary")), 1, 8))


def node_id(path: Column, lang: Column, kind: Column, name: Column, extra: Column) -> Column:
    return F.substring(F.sha1(F.concat_ws("\x1f", path, lang, kind, name, extra).cast("binary")), 1, 24)


#: Steps from HTML to Markdown, in order: what is dropped, links, headings, list marks, line ends, other tags, entities.
MARKDOWN_STEPS = [
    *[(rf"(?is)<{tag}\b.*?</{tag}>", " ") for tag in ("script", "style", "head", "nav", "noscript", "template")],
    (r"(?s)<!--.*?-->", " "),
    (r"(?is)<a\b[^>]*?href=\"([^\"]*)\"[^>]*>(.*?)</a>", "[$2]($1)"),
    *[(rf"(?i)<h{k}\b[^>]*>", "\n" + "#" * k + " ") for k in range(1, 7)],
    (r"(?i)<li\b[^>]*>", "\n- "),
    (r"(?i)<br\s*/?>|</(p|div|li|h[1-6]|tr|ul|ol|table|article|section|footer|header|pre|blockquote)>|<(p|div|tr|table|article|section|footer)\b[^>]*>", "\n"),
    (r"<[^>]+>", ""),
    ("&nbsp;|\u00a0", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;|&apos;", "'"), ("&amp;", "&"),
]


def html_to_markdown(c: str | Column) -> Column:
    """A page as Markdown: headings, lists, links and paragraphs; no scripts, styles or navigation."""
    out = _col(c)
    for pattern, by in MARKDOWN_STEPS:
        out = F.regexp_replace(out, pattern, by)
    return out
