from __future__ import annotations

import hashlib
import random

import numpy as np
import pytest

from quarry.llm import lz_fingerprint as lz


def plain_phrases(text):
    """The phrase set by the definition: grow a piece until it is new."""
    seen, piece = set(), ""
    for c in text:
        piece += c
        if piece not in seen:
            seen.add(piece)
            piece = ""
    return seen


def plain_numbers(text):
    """The fingerprint by plain integers from the phrase set."""
    mask = (1 << 64) - 1

    def mix(h):
        for m in (0xFF51AFD7ED558CCD, 0xC4CEB9FE1A85EC53):
            h = ((h ^ (h >> 33)) * m) & mask
        return h ^ (h >> 33)

    least = {}
    for p in plain_phrases(text):
        h = mix(sum((ord(c) + 1) * pow(lz.BASE, i, 1 << 64) for i, c in enumerate(p)) & mask)
        least[h >> 57] = min(h, least.get(h >> 57, mask))
    if not least:
        return [0xFFFF] * 128
    out = []
    for b in range(128):
        at, step = b, 1
        while at not in least:
            at, step = mix((b * lz.BASE + step) & mask) >> 57, step + 1
        out.append(mix(least[at]) % 0xFFFF)
    return out


def brute(rows):
    """rows (id, text), repeated ids in the table's order."""
    rows = sorted(((i, t or "") for i, t in rows), key=lambda r: (r[0] is None, -(r[0] or 0)))
    own, out = [plain_numbers(t) for _, t in rows], []
    for k, (i, t) in enumerate(rows):
        j = (k + 1) % len(rows)
        half = len(t) // 2
        changed = t[: len(t) - half] + rows[j][1][:half]
        other = plain_numbers(changed)
        text = lambda x: "".join(f"{v:04x}" for v in x)
        same = lambda a, b: sum(x == y for x, y in zip(a, b, strict=True)) / 128
        out.append((i, len(t), hashlib.sha256(changed.encode()).hexdigest(), text(own[k]), text(other), same(own[k], other), same(own[k], own[j])))
    return sorted(out, key=str)


def test_phrases_are_those_of_the_definition():
    rng = random.Random(5)
    for n in (0, 1, 2, 3, 10, 500, 5000):
        for letters in ("a", "ab", "abcdefgh ", "αβ漢字😀 "):
            text = "".join(rng.choice(letters) for _ in range(n))
            seen = set()
            ends = lz.phrases(text, 0, seen)
            assert seen == plain_phrases(text) and len(ends) == len(seen)
            assert lz.fingerprint(text).tolist() == plain_numbers(text)


def test_long_texts_are_hashed_in_blocks(monkeypatch):
    text = "".join(random.Random(6).choice("abc ") for _ in range(5000)) + "a" * 3000
    want = lz.fingerprint(text)
    monkeypatch.setattr(lz, "BLOCK", 7)
    assert (lz.fingerprint(text) == want).all()


def test_both_fingerprints_share_the_beginning():
    rng = random.Random(7)
    for n in (0, 1, 2, 7, 100, 3001):
        a, b = ("".join(rng.choice("abcd ") for _ in range(n)) for _ in range(2))
        own, other = lz.both_fingerprints(a, lz.edited(a, b))
        assert (own == lz.fingerprint(a)).all() and (other == lz.fingerprint(lz.edited(a, b))).all()


def test_likeness_estimates_the_jaccard_likeness_of_phrase_sets(spark, sf):
    texts = [r["text"] or "" for r in spark.read.parquet(f"{sf}/documents.parquet").select("text").limit(60).collect()]
    gaps = []
    for a, b in zip(texts, texts[1:], strict=False):
        for other in (b, lz.edited(a, b)):
            x, y = plain_phrases(a), plain_phrases(other)
            gaps.append(lz.likeness(lz.fingerprint(a), lz.fingerprint(other)) - (len(x & y) / len(x | y) if x | y else 1))
    assert abs(np.mean(gaps)) < 0.02 and np.std(gaps) < 0.06


def test_odd_rows(odd_docs):
    got = sorted(map(tuple, lz.lz_fingerprints(odd_docs).collect()), key=str)
    assert got == brute([(r["doc_id"], r["text"]) for r in odd_docs.collect()])
    by = {r[0]: r for r in got}
    assert by[1][3] == by[4][3] and by[2][3] == by[3][3] == "ffff" * 128


@pytest.mark.parametrize("n", [0, 1, 2, 3, 40])
def test_small_tables_and_ranges(spark, n):
    rng = random.Random(n)
    rows = [(k * 3, "".join(rng.choice("ab ") for _ in range(rng.randrange(60)))) for k in range(n)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(map(tuple, lz.lz_fingerprints(docs).collect()), key=str) == brute(rows)


def test_hot_ids(spark):
    rows = [(None, "same text")] * 30 + [(5, "other text")] * 30 + [(k, f"text number {k}") for k in range(30)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = [(r["doc_id"], r["n_chars"], r["fingerprint"]) for r in lz.lz_fingerprints(docs).collect()]
    assert sorted(got, key=str) == sorted(((r[0], r[1], r[3]) for r in brute(rows)), key=str)


def test_query_against_brute_force(spark, sf):
    got = sorted(map(tuple, lz.op12_lz_fingerprint(spark, sf).collect()), key=str)
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()
    assert got == brute([tuple(r) for r in docs])
    near = [r[5] for r in got]
    assert np.mean(near) > np.mean([r[6] for r in got]) + 0.15
