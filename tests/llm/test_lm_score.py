from __future__ import annotations

import math
import zlib
from collections import Counter

import numpy as np
import pytest

from quarry.llm import lm_score as L


def _base(rows):
    counts = Counter()
    for i, t in rows:
        if i is not None and zlib.crc32(str(i).encode()) % 7 != 2:
            counts.update(L.tokens(t))
    n, v = sum(counts.values()), len(counts)
    return {i: (len(L.tokens(t)), sum(counts[w] > 0 for w in L.tokens(t)), n, sum(math.log10((counts[w] + 1) / (n + v + 1)) for w in L.tokens(t))) for i, t in rows}


def _check(rows, got):
    want = _base(rows)
    for r in got:
        n, known, total, base = want[r["doc_id"]]
        assert (r["n_tokens"], r["n_known"], r["train_tokens"]) == (n, known, total)
        assert r["base_score"] == pytest.approx(base, rel=1e-9, abs=1e-9) and math.isfinite(r["score"])
        assert r["held_out"] == (r["doc_id"] is None or zlib.crc32(str(r["doc_id"]).encode()) % 7 == 2)


def test_probabilities_sum_to_one():
    rng = np.random.default_rng(0)
    sizes = L.Sizes(700, 60, 8)
    m = L.Model(np.log(np.full(sizes.out, 1 / sizes.out)), sizes)
    for x in m.tables():
        x += rng.standard_normal(x.shape).astype(np.float32) * 0.5
    m.normalise()
    every = np.arange(sizes.out)
    for last, before in ((0, 0), (sizes.out, sizes.out), (17, 650)):
        logs = m.log10(np.full(sizes.out, last), np.full(sizes.out, before), every)
        assert (10.0**logs).sum() == pytest.approx(1, rel=1e-4)


def test_training_beats_unigrams_on_a_chain():
    """The next token depends on the token before the last."""
    rng = np.random.default_rng(1)
    sizes = L.Sizes(40, 8, 16)
    ids = np.tile([5, 6, 5, 7, 8, 6, 8, 7], 2500)
    first = np.zeros(len(ids), bool)
    first[0] = True
    last, before = L.contexts(ids, first, sizes.out)
    counts = np.bincount(ids, minlength=sizes.out) + 0.5
    m = L.Model(np.log(counts / counts.sum()), sizes)
    t = L.Trainer(m, 2)
    for _ in range(150):
        at = rng.integers(0, len(ids), 2000)
        t.step(last[at], before[at], ids[at])
    m.normalise()
    assert m.log10(last, before, ids).mean() > -0.2 > math.log10(0.5)  # the last token alone leaves two choices


def test_class_of_matches_the_sql_form(spark):
    words = ["a", "ab", "abc", "abcd", "été", "漢字", ""]
    rows = spark.createDataFrame([(w.encode(),) for w in words], "token binary").selectExpr("crc32(substring(token, greatest(octet_length(token) - 2, 1), 3)) % 256 AS k").collect()
    assert [r["k"] for r in rows] == [L.class_of(w.encode(), 256) for w in words]


@pytest.mark.parametrize("most", [3, 10, 50, 200_000])
def test_frequent_tokens_are_those_of_the_highest_counts(spark, monkeypatch, most):
    monkeypatch.setattr(L, "FREQUENT", most)
    rng = np.random.default_rng(3)
    rows = [(f"t{k}".encode(), int(c)) for k, c in enumerate(rng.integers(1, 60, 300) ** 2)]
    got = L.frequent(spark.createDataFrame(rows, "token binary, c long"))
    assert got == sorted(rows, key=lambda x: (-x[1], x[0]))[: len(got)] and len(got) <= most
    assert len(got) > most - 40 if most < 300 else len(got) == 300


def test_scores_against_sums_over_the_vocabulary(spark, monkeypatch):
    """The model's score of each text, token by token, from softmax sums over all tokens."""
    monkeypatch.setattr(L, "FREQUENT", 30)
    held, learn = [], L.learn
    monkeypatch.setattr(L, "learn", lambda *a: held.append(learn(*a)) or held[-1])
    sizes = L.Sizes(12, 5, 6)
    rows = [(i, f"the w{i % 7} of w{i % 5} and x{i % 40} the end{i % 11}" * (i % 3)) for i in range(150)] + [(777, None), (None, "the unseen words")]
    got = {r["doc_id"]: r["score"] for r in L.score(spark.createDataFrame(rows, "doc_id long, text string"), sizes=sizes).collect()}
    k = held[0]
    counts = {bytes(r["token"]): r["c"] for r in k.counts.collect()}
    for i, text in rows:
        last = before = sizes.out
        want = 0.0
        for w in L.tokens(text):
            n = k.index.get(w, sizes.known + L.class_of(w, sizes.classes))
            q = k.model.last[last] + k.model.before[before]
            z = np.exp(k.model.out @ q + k.model.bias).astype(float)
            want += math.log10(z[n] / z.sum())
            if n >= sizes.known:
                want += math.log10((counts.get(w, 0) + 1) / (k.class_n[n - sizes.known] + k.class_v[n - sizes.known] + 1))
            last, before = n, last
        assert got[i] == pytest.approx(want, abs=2e-3)


def test_rows_against_brute_force(spark, monkeypatch):
    monkeypatch.setattr(L, "FREQUENT", 5)  # most counts come through the join
    rows = [(i, f"word{i % 5} Word{i % 3} x{i} und\tder \x0b the\x85same" if i % 9 else None) for i in range(120)]
    got = L.score(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert len(got) == 120
    _check(rows, got)


def test_odd_rows(odd_docs, no_docs):
    rows = {r["doc_id"]: r["text"] for r in odd_docs.collect()}
    got = L.score(odd_docs).collect()
    assert len(got) == 10 and L.score(no_docs).count() == 0
    assert {r["n_tokens"] for r in got if r["doc_id"] in (2, 3, 6)} == {1} and all(math.isfinite(r["score"]) for r in got) and None in rows


def test_held_out_documents_score_better_than_unigrams(spark):
    got = L.op1_lm_score(spark, "/root/testdata/sf0.01").where("held_out").collect()
    assert np.mean([r["score"] > r["base_score"] for r in got]) > 0.8


def test_long_tokens_are_joined_and_change_no_count(spark):
    """Tokens of over LONGEST bytes, however frequent, stay out of what goes to the driver and the tasks."""
    long = ["x" * 65, "漢" * 400, "y" * 5000]
    rows = [(k, f"a {long[k % 3]} {long[0]} b c{k % 4}") for k in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    sizes = L.Sizes(5, 8, 8)
    _check(rows, L.score(docs, sizes=sizes).collect())
    known = L.learn(docs.selectExpr("doc_id AS id", "text"), sizes)
    assert max(map(len, known.frequent)) <= L.LONGEST and not any(t.encode() in known.frequent for t in long)
    assert known.class_n.sum() + sum(known.frequent[t] for t in known.index) == known.total
