from __future__ import annotations

import random
import re

import numpy as np

from quarry.llm import jaccard_join as J
from quarry.llm import textvec


def _shingles(text):
    w = re.findall(r"(?:[a-z0-9]|[^\x00-\x7f])+", (text or "").lower())
    return frozenset(tuple(w[k : k + 5]) for k in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])


def _brute(rows):
    """doc -> (class, links) by comparing all pairs."""
    sets, links, parent = [_shingles(t) for _, t in rows], [0] * len(rows), list(range(len(rows)))

    def root(k):
        while parent[k] != k:
            k = parent[k]
        return k

    for i in range(len(rows)):
        for j in range(i):
            a, b = sets[i], sets[j]
            if (not a and not b) or (a and b and 5 * len(a & b) >= 4 * len(a | b)):
                links[i] += 1
                links[j] += 1
                u, v = root(i), root(j)
                parent[max(u, v)] = min(u, v)
    least = {}
    for k, (i, _) in enumerate(rows):
        least[root(k)] = min(least.get(root(k), i), i)
    return {rows[k][0]: (least[root(k)], links[k]) for k in range(len(rows))}


def test_shingle_hashes_against_tuples():
    texts = ["a b c d e f", "", None, "a b c", "A, b  c!", "x " * 12, "b c d e f g", "Élan vital"]
    flat, offsets = textvec.shingles(*textvec.word_hashes([textvec.normal(t) for t in texts]))
    for i, a in enumerate(texts):
        assert len(set(flat[offsets[i] : offsets[i + 1]].tolist())) == len(_shingles(a))
        for j, b in enumerate(texts):
            assert len(set(flat[offsets[i] : offsets[i + 1]].tolist()) & set(flat[offsets[j] : offsets[j + 1]].tolist())) == len(_shingles(a) & _shingles(b))


def test_long_texts_are_hashed_in_segments(monkeypatch):
    text = textvec.normal(" ".join(f"w{i % 977}" for i in range(3000)))
    whole = textvec.word_hashes([text, b"", b"a b"])
    monkeypatch.setattr(textvec, "_SEGMENT", 500)
    parts = textvec.word_hashes([text, b"", b"a b"])
    assert all((a == b).all() for a, b in zip(whole, parts, strict=True))


def test_bayesian_bounds_are_rarely_missed():
    rng = np.random.default_rng(1)
    least = J.least_matches()
    same = rng.random((20_000, J.HASHES)) < 0.8
    lost = np.zeros(20_000, bool)
    for n, m in least.items():
        lost |= same[:, :n].sum(1) < m
    assert lost.mean() < 1e-3 and least[J.HASHES] > 0.5 * J.HASHES


def test_exact_counts():
    rng = random.Random(2)
    sets = [np.unique(np.array([rng.randrange(60) for _ in range(40)], np.uint64)) for _ in range(30)]
    got = J.linked(sets, sets, np.ones((30, 30), bool))
    for i in range(30):
        for j in range(30):
            a, b = set(sets[i].tolist()), set(sets[j].tolist())
            assert got[i, j] == (5 * len(a & b) >= 4 * len(a | b))


def test_join_against_brute_force(spark):
    rng = random.Random(7)
    base = [" ".join(rng.choice("abcdefghij") * rng.randrange(1, 4) for _ in range(rng.randrange(60, 120))) for _ in range(25)]
    rows = []
    for i in range(330):
        words = rng.choice(base).split()
        for _ in range(rng.choice([0, 0, 1, 1, 2, 3, 8])):
            words[rng.randrange(len(words))] = "zz" + str(rng.randrange(5))
        rows.append((i, " ".join(words) if i % 3 else " ".join(base[0].split()[: 60 - i % 7])))
    rows += [(1000, ""), (1001, None), (1002, "?!"), (1003, "one two"), (1004, "One, two!"), (1005, "two one")]
    got = {r["doc_id"]: (r["class_id"], r["n_links"]) for r in J.jaccard_join(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == _brute(rows)


def test_blocks_of_a_large_class(spark, monkeypatch):
    """A class of several blocks: every pair is compared once."""
    rng = random.Random(9)
    base = [f"w{k}" for k in range(150)]
    rows = []
    for i in range(90):
        words = list(base)
        words[rng.randrange(150)] = f"x{i}"
        rows.append((i, " ".join(words)))
    monkeypatch.setattr(J, "BLOCK", 16)
    got = {r["doc_id"]: (r["class_id"], r["n_links"]) for r in J.jaccard_join(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == _brute(rows)


def test_components(spark):
    edges = [(i, i + 1) for i in range(0, 20)] + [(100, 50), (50, 70), (7, 7)]
    got = {r["id"]: r["part"] for r in J.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(21)}, 100: 50, 70: 50, 50: 50}


def test_odd_rows(odd_docs, no_docs):
    rows = J.jaccard_join(odd_docs).collect()
    assert len(rows) == 10 and J.jaccard_join(no_docs).count() == 0
    by = {r["doc_id"]: r for r in rows}
    assert by[4]["class_id"] == by[9]["class_id"] == 1 and by[1]["n_links"] == 2
    assert by[2]["class_id"] == by[6]["class_id"] == 2 and by[3]["n_copies"] == 3
    assert by[7]["n_copies"] == 2 and by[None]["class_id"] is None


def test_null_and_repeated_ids_lose_no_links(spark):
    """Links go by text: near copies without ids, and different texts under one id."""
    base = [f"w{k}" for k in range(60)]
    near = [" ".join([*base[:-1], f"x{i}"]) for i in range(4)]
    other = " ".join(f"y{k}" for k in range(60))
    rows = [(None, near[0], 0), (None, near[1], 1), (7, near[2], 2), (7, other, 3), (8, other, 4), (None, near[0], 5)]
    got = {r["_c2"]: r for r in J.jaccard_rows(spark.createDataFrame(rows, "doc_id long, text string, tag int")).collect()}
    assert [got[k]["n_links"] for k in range(6)] == [3, 3, 3, 1, 1, 3] and [got[k]["n_text_links"] for k in range(6)] == [2, 2, 2, 0, 0, 2]
    assert {got[k]["class_id"] for k in (0, 1, 2, 5)} == {7} and {got[k]["class_id"] for k in (3, 4)} == {7}
    assert sum(got[k]["kept"] for k in (0, 1, 2, 5)) == 1 and sum(got[k]["kept"] for k in (3, 4)) == 1


def test_hot_buckets_are_dealt_over_sub_keys(spark, monkeypatch):
    monkeypatch.setattr(J, "HOT", 0)
    monkeypatch.setattr(J, "SALTS", 4)
    monkeypatch.setattr(J, "LEAST_HOT", 3)
    base = [f"w{k}" for k in range(80)]
    rows = [(i, " ".join([*base[:-1], f"x{i}"])) for i in range(12)] + [(100, "all alone here with some words")]
    got = {r["doc_id"]: (r["class_id"], r["n_links"]) for r in J.jaccard_join(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == _brute(rows)
