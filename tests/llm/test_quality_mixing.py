from __future__ import annotations

import zlib

import numpy as np
from pyspark.sql import functions as F

from quarry.llm import mixing, quality


def test_ranker_against_known_order():
    rng = np.random.default_rng(0)
    x = rng.standard_normal((600, 5))
    y = (x[:, 0] + 0.1 * rng.standard_normal(600) > -1).astype(int)
    m = quality.fit(x, y)
    raw = m.raw(x)
    assert raw[y == 1].mean() > raw[y == 0].mean() and np.abs(m.w[0]) > 3 * np.abs(m.w[1:]).max()
    assert ((m.score(x) >= quality.CUT) == y).mean() > 0.95
    assert abs((m.score(x) < quality.CUT).sum() - (y == 0).sum()) <= 1


def test_held_out_accuracy(spark):
    d = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet")
    got = {r["doc_id"]: r for r in quality.classify(docs, labels).collect()}
    assert len(got) == 1000 and all(r["held_out"] == (zlib.crc32(str(i).encode()) % 5 == 0) and 0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.3) for i, r in got.items())
    held = [(got[r["doc_id"]]["predicted"], r["quality"]) for r in labels.collect() if got[r["doc_id"]]["held_out"]]
    assert np.mean([a == b for a, b in held]) > 0.95


def test_the_query_against_brute_force_scores(spark):
    """op9 on a whole table: scores of a Bradley-Terry model that is fitted apart, by plain gradient descent, rank alike."""
    d = "/root/testdata/sf0.01"
    rows = {r["doc_id"]: r for r in quality.op9_quality(spark, d).collect()}
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{d}/documents.parquet").collect()}
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{d}/labels.parquet").collect() if r["doc_id"] in texts and r["quality"] in (0, 1)}
    assert set(rows) == set(texts)
    learn = sorted(i for i in labels if zlib.crc32(str(i).encode()) % 5)
    x, y = quality.features([texts[i] for i in learn]).astype(float), np.array([labels[i] for i in learn])
    every = quality.features([texts[i] for i in sorted(texts)]).astype(float)
    mean, scale = x.mean(0), x.std(0)
    scale[scale < 1e-4] = np.inf
    z = np.clip((x - mean) / scale, -8, 8)
    good, bad, w = z[y == 1], z[y == 0], np.zeros(z.shape[1])
    for _ in range(3000):  # the mean over all pairs, not over a sample of them
        g = -1 / (1 + np.exp(np.clip((good @ w)[:, None] - (bad @ w)[None], -30, 30)))
        w -= 0.5 * ((g.sum(1) @ good - g.sum(0) @ bad) / g.size + quality.RIDGE * w)
    raw = np.clip((every - mean) / scale, -8, 8) @ w
    cut = np.sort(z @ w)[len(bad) - 1 : len(bad) + 1].mean()
    got = np.array([rows[i]["score"] for i in sorted(texts)])
    assert np.corrcoef(np.argsort(np.argsort(raw)), np.argsort(np.argsort(got)))[0, 1] > 0.85  # one is fitted longer
    assert np.mean((raw >= cut) == (got >= quality.CUT)) > 0.97


def test_labels_of_the_held_out_fold_are_never_read(spark):
    docs = spark.createDataFrame([(i, f"{'GOOD' if i % 2 else 'bad'} text {i}") for i in range(200)], "doc_id long, text string")
    make = lambda flip: spark.createDataFrame([(i, (i % 2) ^ (flip and zlib.crc32(str(i).encode()) % 5 == 0)) for i in range(200)], "doc_id long, quality int")
    a, b = (sorted(quality.classify(docs, make(f)).collect()) for f in (False, True))
    assert a == b


def test_quality_odd_rows(odd_docs, no_docs, labels, no_labels):
    rows = quality.classify(odd_docs, labels).collect()
    assert len(rows) == 10 and all(0 <= r["score"] <= 1 for r in rows)
    assert [r["held_out"] for r in rows if r["doc_id"] is None] == [True]
    assert {r["predicted"] for r in quality.classify(odd_docs, no_labels).collect()} == {1}
    assert quality.classify(no_docs, labels).count() == 0


def test_rates_meet_targets(spark):
    rng = np.random.default_rng(5)
    p = rng.dirichlet([0.3, 0.2, 0.2], 500)
    t = rng.integers(1, 400, 500)
    members = spark.createDataFrame([(i, int(t[i]), p[i].tolist()) for i in range(500)], "id long, n_tokens long, p array<double>")
    steps = mixing.solve(members, (0.6, 0.3, 0.1))
    r = mixing.rates(t[:, None] * p, steps)
    share = (t * r) @ p / ((t * r) @ p).sum()
    assert (r >= 0).all() and np.abs(share - [0.6, 0.3, 0.1]).max() < 1e-3


def test_a_domain_without_a_target_keeps_its_tokens(spark):
    rng = np.random.default_rng(6)
    p = rng.dirichlet([3, 0.05, 0.3], 800)
    t = rng.integers(1, 400, 800)
    members = spark.createDataFrame([(i, int(t[i]), p[i].tolist()) for i in range(800)], "id long, n_tokens long, p array<double>")
    r = mixing.rates(t[:, None] * p, mixing.solve(members, (0.99, None, 0.01)))
    got, was = (t * r) @ p, t @ p
    assert abs(got[1] / was[1] - 1) < 0.02 and abs(got[2] / got[0] - 0.01 / 0.99) < 1e-3 and abs(got[0] / was[0] - 1) < 1e-3


def test_unreachable_targets_come_as_near_as_rates_can(spark):
    """Against plain projected gradient descent with short steps on all rates at once, with the same weights of squares."""
    p, t = np.array([[1.0, 0, 0], [0.9, 0.1, 0], [0.8, 0.1, 0.1], [0.9, 0.05, 0.05]]), np.array([10.0, 10.0, 30.0, 5.0])
    goal = mixing._goal(t @ p, mixing.TARGETS)
    q = t[:, None] * p
    inverse, r = np.linalg.pinv(q.T @ q, rcond=1e-9, hermitian=True), np.ones(4)
    for _ in range(20_000):
        r = np.clip(r - 0.2 * q @ (inverse @ (r @ q - goal)), 0, None)
    members = spark.createDataFrame([(i, int(t[i]), p[i].tolist()) for i in range(4)], "id long, n_tokens long, p array<double>")
    got = mixing.rates(q, mixing.solve(members))
    loss = lambda x: (x @ q - goal) @ inverse @ (x @ q - goal)
    assert (got >= 0).all() and loss(got) < loss(r) + 1e-3 * loss(np.ones(4))


def test_the_query_against_brute_force(spark):
    """Posteriors of a softmax model, rates by replayed steps and copies of every row, computed apart; on whole tables."""
    d = "/root/testdata/sf0.001"
    docs, labels = spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet")
    rows = {r["doc_id"]: r for r in mixing.op3_mixing(spark, d).collect()}
    model = mixing.train(docs, labels)
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    ids = sorted(texts)
    p = np.empty((len(ids), 3))
    for k, i in enumerate(ids):
        dense, words, _, n = mixing.features([texts[i]])
        z = dense[0].astype(float) @ model.dense + model.sparse[words].sum(0, dtype=float)
        p[k] = np.exp(z - z.max()) / np.exp(z - z.max()).sum()
        assert rows[i]["n_tokens"] == n[0] and np.abs(p[k] - [rows[i][f"p_{x}"] for x in mixing.DOMAINS]).max() < 1e-4
    t = np.array([rows[i]["n_tokens"] for i in ids], float)
    r = np.array([rows[i]["rate"] for i in ids])
    got = (t * r) @ p
    goal = mixing._goal(t @ p, mixing.TARGETS)
    assert np.abs(got - goal).max() / goal.sum() < mixing.ENOUGH + 1e-4 and rows[ids[0]]["unmet"] < mixing.ENOUGH
    assert (r >= 0).all() and all(rows[i]["copies"] in (int(x), int(x) + 1) for i, x in zip(ids, r, strict=True))
    known = {r["doc_id"]: 2 if r["toxic"] else int(r["quality"] == 0) for r in labels.collect() if r["doc_id"] in texts}
    assert np.mean([p[ids.index(i)].argmax() == y for i, y in known.items()]) > 0.9


def test_mixing_odd_rows(odd_docs, no_docs, labels, no_labels):
    rows = mixing.mix(odd_docs, labels).collect()
    assert len(rows) == 10 and all(r["rate"] >= 0 and r["copies"] in (int(r["rate"]), int(r["rate"]) + 1) and abs(r["p_clean"] + r["p_low"] + r["p_toxic"] - 1) < 1e-6 for r in rows)
    assert {r["n_tokens"] for r in rows if r["doc_id"] in (2, 3, 6)} == {0}
    assert {round(r["p_clean"], 6) for r in mixing.mix(odd_docs, no_labels).collect()} == {round(1 / 3, 6)}
    assert mixing.mix(no_docs, labels).count() == 0


def _shares(spark, p, t, targets):
    members = spark.createDataFrame([(i, int(t[i]), p[i].tolist()) for i in range(len(t))], "id long, n_tokens long, p array<double>")
    got = (t * mixing.rates(t[:, None] * p, mixing.solve(members, targets))) @ p
    return got / got.sum()


def test_rare_domains_reach_their_targets(spark):
    """Shares at which rates up to 4 are too few."""
    rng = np.random.default_rng(6)
    p = np.full((1200, 3), 0.0005)
    of = np.where(np.arange(1200) < 1194, 0, np.where(np.arange(1200) < 1198, 1, 2))
    p[np.arange(1200), of] = 0.999
    t = rng.integers(50, 150, 1200).astype(float)
    assert np.abs(_shares(spark, p, t, mixing.TARGETS) - mixing.TARGETS).max() < 5e-4


def test_targets_beyond_any_rates_are_least_squares_and_reported(spark, odd_docs, no_labels):
    unmet = {r["unmet"] for r in mixing.mix(odd_docs, no_labels).collect()}  # equal posteriors: no rates change the shares
    assert len(unmet) == 1 and unmet.pop() > 0.1


def test_the_pipeline_has_a_target_for_every_domain():
    import corpus_pipeline

    assert None not in corpus_pipeline.TARGETS and len(corpus_pipeline.TARGETS) == len(mixing.DOMAINS)


def test_copies_beyond_an_int_and_in_blocks(spark):
    rows = [(1, 0), (2, 1), (3, 10_000), (4, 10_001), (5, 25_000)]
    got = mixing.repeated(spark.createDataFrame(rows, "id long, copies long"), "copies").groupBy("id").count().collect()
    assert {r["id"]: r["count"] for r in got} == {i: n for i, n in rows if n}
    assert spark.createDataFrame([(5e9,)], "rate double").select(F.floor("rate").cast("long")).first()[0] == 5_000_000_000


def test_few_documents_of_a_domain_take_large_rates(spark):
    """One short toxic document against many clean ones: the rate is far beyond what a small table needs, and none is lost."""
    docs = spark.createDataFrame([(k, "clean words of some length here " * 30) for k in range(60)] + [(100, "bad")], "doc_id long, text string")
    labels = spark.createDataFrame([(k, 1, 0) for k in range(60)] + [(100, 1, 1)], "doc_id long, quality int, toxic int")
    rows = mixing.mix(docs, labels).collect()
    assert len(rows) == 61 and dict(mixing.mix(docs, labels).dtypes)["copies"] == "bigint" and all(r["copies"] >= 0 for r in rows)
