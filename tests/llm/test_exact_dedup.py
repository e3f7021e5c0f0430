from __future__ import annotations

import hashlib
import random

import duckdb
from pyspark.sql import functions as F

from quarry.llm import exact_dedup, mphf


def test_mphf_is_minimal_and_perfect():
    keys = [hashlib.sha256(str(i).encode()).digest() for i in range(5000)]
    sizes, bits, slots = mphf.build(keys)
    assert sorted(slots.tolist()) == list(range(5000))
    assert mphf.probe(sizes, bits, keys).tolist() == slots.tolist()
    others = [hashlib.sha256(f"x{i}".encode()).digest() for i in range(200)]
    found = mphf.probe(sizes, bits, others).tolist()
    assert all(s == -1 or keys[slots.tolist().index(s)] != k for s, k in zip(found, others, strict=True))
    assert mphf.build([])[2].tolist() == [] and mphf.probe([], b"", keys[:3]).tolist() == [-1] * 3


def test_odd_rows(odd_docs):
    rows = exact_dedup.exact_dedup(odd_docs, F.col("doc_id") % 2 == 0).collect()
    assert len(rows) == 10
    by = {(r["doc_id"], r["kept"]): r for r in rows}
    assert by[1, False]["keep_id"] == 4 and by[4, True]["group_size"] == 2
    assert by[2, False]["keep_id"] == 3 and by[3, True]["text_sha256"] == hashlib.sha256(b"").hexdigest()
    assert sorted(r["kept"] for r in rows if r["doc_id"] == 7) == [False, True]
    assert by[None, True]["keep_id"] is None and by[9, True]["group_size"] == 1


def test_empty(no_docs):
    assert exact_dedup.exact_dedup(no_docs, F.lit(True)).count() == 0


def test_against_sql_for_any_history(spark):
    rng = random.Random(3)
    rows = [(i, rng.choice(["a", "b", "", None, f"t{rng.randrange(40)}"])) for i in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    con = duckdb.connect()
    con.register("documents", docs.toPandas())
    want = sorted(con.sql("SELECT doc_id, keep_id, group_size, kept, text_sha256 FROM (" + exact_dedup.OP4_SQL + ")").fetchall())
    for history in (F.lit(True), F.lit(False), F.col("doc_id") < 100):
        got = exact_dedup.exact_dedup(docs, history).select("doc_id", "keep_id", "group_size", "kept", "text_sha256")
        assert sorted(map(tuple, got.collect())) == want


def test_rows_of_one_text_without_ids_are_dealt_out(spark):
    rows = [(None, "same")] * 300 + [(5, "twice")] * 40 + [(None, "twice")] * 20 + [(8, "x"), (None, "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    for history in (F.lit(True), F.lit(False), F.rand(3) < 0.5):
        got = [(r["text_sha256"], r["keep_id"], r["group_size"], r["kept"], r["doc_id"]) for r in exact_dedup.exact_dedup(docs, history).collect()]
        kept = sorted((r[1] or 0, r[2], r[4] or 0) for r in got if r[3])
        assert len(got) == len(rows) and kept == [(0, 300, 0), (5, 60, 5), (8, 2, 8)]
