"""Questions over texts without an index against BM25 computed from all texts, with copies, ties, blocks of questions and nulls."""

from __future__ import annotations

import random

import pytest
from test_lexical_index import QUERIES, brute, frame, texts

from quarry.operators import lexical_index, lexical_scan
from quarry.plans import bounded
from quarry.plans.queries import QUERIES as NAMED


def check(spark, docs, queries):
    q = spark.createDataFrame(sorted(queries.items()), "item_id long, text string")
    found, want = lexical_scan.passes(frame(spark, docs), q), brute(docs, queries)
    for k in (1, 7, 1000):
        got = {}
        for r in lexical_scan.top(found, k).collect():
            assert abs(r["score"] - want[r["query"], r["id"]]) < 2e-6
            got.setdefault(r["query"], []).append((r["rank"], r["id"]))
        for x in queries:
            best = sorted((-round(s, 6), i) for (y, i), s in want.items() if y == x)[:k]
            assert sorted(got.get(x, [])) == [(n, i) for n, (_, i) in enumerate(best, 1)]
    some = [(x, i) for x in queries for i in list(docs)[::5]]
    gates = {(r["query"], r["id"]): r["score"] for r in lexical_scan.gate(found, spark.createDataFrame(some * 2, "query long, id long")).collect()}
    assert gates.keys() == {k for k in want if k in set(some)} and all(abs(gates[k] - want[k]) < 2e-6 for k in gates)
    return found


def test_scores_of_all_texts_with_copies(spark, monkeypatch):
    monkeypatch.setattr(lexical_scan, "TEXTS", 7)
    docs = texts(random.Random(11), 90)
    docs |= {200 + k: docs[k % 3] for k in range(40)}  # ties in great number: the smaller ids stay
    found = check(spark, docs, QUERIES)
    allowed = [i for i in docs if i % 3 == 0]
    got = [r["id"] for r in lexical_scan.top(found, 5, spark.createDataFrame([(i,) for i in allowed], "id long")).where("query = 1").orderBy("rank").collect()]
    best = sorted((-round(s, 6), i) for (y, i), s in brute(docs, QUERIES).items() if y == 1 and i in allowed)[:5]
    assert got == [i for _, i in best]


def test_blocks_of_questions(spark, monkeypatch):
    monkeypatch.setattr(lexical_scan, "blocks", lambda df: bounded.blocks(df, 2))
    found = check(spark, texts(random.Random(12), 30), QUERIES)
    assert len(found) == 3


def test_empty_and_null_texts(spark):
    docs = spark.createDataFrame([(1, None), (2, ""), (3, "word1")], "doc_id long, text string")
    q = spark.createDataFrame([(1, "word1"), (2, None)], "item_id long, text string")
    assert [tuple(r) for r in lexical_scan.top(lexical_scan.passes(docs, q), 3).collect()] == [(1, 3, 1.0, 1)]
    assert lexical_scan.top(lexical_scan.passes(docs.limit(0), q), 3).count() == 0
    none = lexical_scan.passes(docs, q.limit(0))
    assert lexical_scan.top(none, 3).count() == 0
    assert lexical_scan.gate(none, spark.createDataFrame([(1, 3)], "query long, id long")).count() == 0


@pytest.mark.parametrize("name", ["bm25_topk", "gate_lexical", "numeric_evidence", "query_knowledge", "query_decisions"])
def test_one_batch_of_questions_builds_no_index(spark, sf, monkeypatch, name):
    def build(*_, **__):
        raise AssertionError("a whole index for one batch of questions")

    monkeypatch.setattr(lexical_index, "build", build)
    assert NAMED[name](spark, sf).count() > 0
