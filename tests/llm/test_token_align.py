from __future__ import annotations

import hashlib
import random
from collections import Counter

import pytest

from quarry.llm import token_align as ta


@pytest.fixture(scope="module")
def aligner():
    return ta.Aligner(*ta.default_tokenizers())


def plain_groups(aligner, text):
    """Groups of a whole text at once as (A ids, B ids), or None."""
    if not text:
        return None
    raw = (" " + text).encode()
    a, b = aligner.a.encode(" " + text, add_special_tokens=False).ids, aligner.b.encode(text)
    letters = {c: i for i, c in enumerate(ta._byte_letters())}
    a_raw = [bytes(letters[c] for c in aligner.a.id_to_token(i)) for i in a]
    b_raw = [bytes([int(aligner.b.id_to_piece(i)[3:5], 16)]) if aligner.b.is_byte(i) else aligner.b.id_to_piece(i).replace("▁", " ").encode() for i in b]
    if b"".join(a_raw) != raw or b"".join(b_raw) != raw:
        return None
    out, i, j, held, x, y = [], 0, 0, ([], []), 0, 0
    while i < len(a) or j < len(b):
        if x <= y:
            held[0].append(a[i])
            x, i = x + len(a_raw[i]), i + 1
        else:
            held[1].append(b[j])
            y, j = y + len(b_raw[j]), j + 1
        if x == y and held[1]:
            out.append((tuple(held[0]), tuple(held[1])))
            held = ([], [])
    return out


def brute(aligner, rows):
    found = [(i, plain_groups(aligner, t)) for i, t in rows]
    counts = Counter((g[0][-1], g[1][-1]) for _, x in found for g in x or ())
    best = {}
    for (_, b), n in counts.items():
        best[b] = max(n, best.get(b, 0))
    out = []
    for i, x in found:
        links = [(g[0][-1], g[1][-1]) for g in x or ()]
        text = ";".join(f"{','.join(map(str, a))}|{','.join(map(str, b))}" for a, b in x or ())
        out.append((
            i, sum(len(a) for a, _ in x or ()), sum(len(b) for _, b in x or ()), len(x or ()), len(links), sum(counts[k] == best[k[1]] for k in links),
            sum(counts[k] for k in links), hashlib.sha256(text.encode()).hexdigest() if text else "",
        ))
    return sorted(out, key=str)


ODD = [
    "a", " ", "  ", "\n", " a", "a ", "a  ", "a \n ", "\n\na", "a\n\n  b \n", "tab\there", "a\r\nb;\r\n", "x y", "▁x", "a▁", "<0x41> <s> <|endoftext|> </s>", "é Å ﬁ",
    "漢字 \U0001f600\U0001f469‍\U0001f680 end", "it's we'll  '  s", "a\x00b\x1cc", "x" * 3000, "　wide", "1234567 3.14", "​zero​ width", "def f(x):\n    return x  # done\n\n\n",
]


def test_pieces_give_the_groups_of_whole_texts(aligner):
    rng = random.Random(4)
    parts = [*ODD, "the", "quick", "brown", ",", ".", "  ", "\n"]
    texts = ODD + ["".join(rng.choice(parts) + rng.choice(["", " ", "\n"]) for _ in range(rng.randrange(1, 12))) for _ in range(600)]
    assert aligner.cuts
    for text, got in zip(texts, aligner.groups(texts), strict=True):
        want = plain_groups(aligner, text)
        assert got == "".join(f"{','.join(map(str, a))}|{'.'.join(map(str, b))};" for a, b in want or ()), text


def test_memory_is_bounded_and_changes_nothing(aligner, monkeypatch):
    monkeypatch.setattr(ta, "MEMORY", 2000)
    small = ta.Aligner(*ta.default_tokenizers())
    for k in range(50):
        texts = [f"word{k} other{k + 1} the end", "the end", "q" * 200 + f" {k}"]
        assert list(small.groups(texts)) == list(aligner.groups(texts))
    assert len(small.memory[0]) + len(small.memory[1]) < 40 and max(map(len, small.memory[0])) <= 64


@pytest.mark.parametrize("frequent", [0, 5, 200_000])
def test_odd_rows(spark, odd_docs, aligner, frequent):
    got = ta.align_tokens(odd_docs, frequent=frequent)[0]
    assert sorted(map(tuple, got.collect()), key=str) == brute(aligner, [(r["doc_id"], r["text"]) for r in odd_docs.collect()])
    docs = spark.createDataFrame(list(enumerate(ODD)), "doc_id long, text string")
    assert sorted(map(tuple, ta.align_tokens(docs, frequent=frequent)[0].collect()), key=str) == brute(aligner, list(enumerate(ODD)))


def test_empty(no_docs):
    out, dictionary, links = ta.align_tokens(no_docs)
    assert out.count() == dictionary.count() == links.count() == 0


def test_dictionary_and_links(spark):
    docs = spark.createDataFrame([(1, "the cat the cat"), (2, "the dog"), (3, None)], "doc_id long, text string")
    _, dictionary, links = ta.align_tokens(docs)
    rows = dictionary.collect()
    assert sum(r["frequency"] for r in rows) == 6 and max(r["documents"] for r in rows) == 2
    assert sorted(r["count"] for r in links.collect()) == [1, 2, 3] and links.where("best").count() == 3


def test_query_against_brute_force(spark, sf, aligner):
    got = sorted(map(tuple, ta.op13_token_align(spark, sf).collect()), key=str)
    assert got == brute(aligner, [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()])
