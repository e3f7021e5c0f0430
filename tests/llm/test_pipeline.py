from __future__ import annotations

import sys
from pathlib import Path

import corpus_pipeline as P
from quarry.llm import mixing, quality, textvec
from quarry.llm.common import materialize

sys.path.insert(0, str(Path(__file__).parent))
from test_jaccard_join import _shingles  # noqa: E402


def test_stages_by_what_their_operators_say(spark):
    d = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{d}/documents.parquet").withColumnRenamed("n_chars", "n_chars")
    columns, before = docs.columns, None
    items = [textvec.normal(r["text"]) for r in spark.read.parquet(f"{d}/benchmark.parquet").collect()]
    for name, stage in P.STAGES[:-1]:
        docs = materialize(stage(spark, docs, d), "stage")
        assert docs.columns == columns
        rows = docs.collect()
        assert rows and (before is None or {r["doc_id"] for r in rows} <= before)
        before = {r["doc_id"] for r in rows}
        texts = [textvec.normal(r["text"]) for r in rows]
        if name == "n-gram jaccard join":
            assert len(set(texts)) == len(texts)
        if name == "benchmark decontamination":
            assert not any(x in t for t in texts for x in items)
    last = P.STAGES[-1][1](spark, docs, d)
    assert last.count() == docs.count()


def test_odd_rows_pass_through(spark, odd_docs, no_docs):
    d = "/root/testdata/sf0.001"
    for rows in (odd_docs, no_docs):
        for _, stage in P.STAGES:
            rows = materialize(stage(spark, rows, d), "stage")
        assert rows.columns == ["doc_id", "start", "n_tokens", "ids_crc32"]


def test_leaks_are_dropped_by_row(spark):
    d = "/root/testdata/sf0.001"
    leak = spark.read.parquet(f"{d}/benchmark.parquet").first()["text"]
    docs = spark.createDataFrame([(None, leak), (None, "clean"), (5, leak), (5, "clean too")], "doc_id long, text string")
    assert sorted(r["text"] for r in P.drop_benchmark_leaks(spark, docs, d).collect()) == ["clean", "clean too"]


CLASHING = "doc_id long, text string, _c0 string, row int, key string, predicted int, score double, bands string, copies int, rate string"


def test_rows_are_judged_one_by_one(spark):
    """One id for several texts, repeated rows, and columns whose names the operators use themselves."""
    d = "/root/testdata/sf0.001"
    leak = spark.read.parquet(f"{d}/benchmark.parquet").first()["text"]
    good = [r["text"] for r in spark.read.parquet(f"{d}/documents.parquet").where("length(text) BETWEEN 600 AND 4000").orderBy("doc_id").limit(6).collect()]
    made = [(1, good[0]), (1, leak), (None, good[1]), (None, good[1]), (None, leak), (1, good[0]), (2, good[2] + " " + good[2]), (3, good[3])]
    docs = spark.createDataFrame([(i, t, f"c{k}", k, "key", 5, 0.5, "b", k, "r") for k, (i, t) in enumerate(made)], CLASHING)
    leaks = P.drop_benchmark_leaks(spark, docs, d)
    assert leaks.columns == docs.columns and sorted(r["row"] for r in leaks.collect()) == [0, 2, 3, 5, 6, 7]
    one = P.one_of_near_copies(spark, docs, d)
    assert one.columns == docs.columns and sorted(r["text"] for r in one.collect()) == sorted({t for _, t in made})
    kept = {r["row"] for r in P.keep_quality(spark, docs, d).collect()}
    ranker = quality.train(docs, spark.read.parquet(f"{d}/labels.parquet"))
    assert kept == {k for k, (_, t) in enumerate(made) if ranker.score(quality.features([t]).astype(float))[0] >= quality.CUT}
    mixed = P.mix_to_targets(spark, docs, d)
    assert mixed.columns == docs.columns


def test_stages_against_brute_force(spark):
    """Each stage on whole tables: what the ranker accepts, one text of each class, no quoted item, and copies by rate."""
    d = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{d}/documents.parquet")
    labels = spark.read.parquet(f"{d}/labels.parquet")
    ranker = quality.train(docs, labels)
    rows = docs.collect()
    scores = ranker.score(quality.features([r["text"] for r in rows]).astype(float))
    kept = materialize(P.keep_quality(spark, docs, d), "kept")
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted(r["doc_id"] for r, s in zip(rows, scores, strict=True) if s >= quality.CUT)
    one = materialize(P.one_of_near_copies(spark, kept, d), "one")
    sets = {r["doc_id"]: _shingles(r["text"]) for r in kept.collect()}
    parent = {i: i for i in sets}

    def root(k):
        while parent[k] != k:
            k = parent[k]
        return k

    ids = sorted(sets)
    for n, i in enumerate(ids):
        for j in ids[:n]:
            a, b = sets[i], sets[j]
            if (not a and not b) or (a and b and 5 * len(a & b) >= 4 * len(a | b)):
                parent[max(root(i), root(j))] = min(root(i), root(j))
    classes = [root(r["doc_id"]) for r in one.collect()]
    assert len(set(classes)) == len(classes) and set(classes) == {root(i) for i in ids}
    mixed = [r["doc_id"] for r in P.mix_to_targets(spark, one, d).collect()]
    told = {r["doc_id"]: r["copies"] for r in mixing.mix(one, labels, P.TARGETS).collect()}
    assert {i: mixed.count(i) for i in told} == told
