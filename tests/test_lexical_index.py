"""The stored inverted index against BM25 computed from all texts, through updates, deletions, races and compaction."""

from __future__ import annotations

import math
import random
from collections import Counter

import pytest

from quarry.config import DEFAULT
from quarry.operators import lexical_index as li
from quarry.operators import store

WORDS = [f"word{k}" for k in range(40)] + ["0x1f", "v1.2", "12mb", "the"]


def texts(rng, n, first=0):
    return {first + k: " ".join(rng.choice(WORDS[: rng.randrange(2, len(WORDS))]) for _ in range(rng.randrange(60))) for k in range(n)}


def frame(spark, docs):
    return spark.createDataFrame(sorted(docs.items()), "doc_id long, text string")


def brute(docs, queries):
    """{(query, id): score} by plain loops."""
    words = {i: [w for w in t.split() if w != "the"] for i, t in docs.items()}
    df, avg, out = Counter(w for x in words.values() for w in set(x)), sum(map(len, words.values())) / max(len(words), 1), {}
    for q, asked in queries.items():
        raw = {}
        for i, x in words.items():
            tf = Counter(x)
            for w in asked.split():
                if tf[w]:
                    idf = math.log((len(words) - df[w] + 0.5) / (df[w] + 0.5) + 1)
                    raw[i] = raw.get(i, 0) + idf * tf[w] * (DEFAULT.bm25_k1 + 1) / (tf[w] + DEFAULT.bm25_k1 * (1 - DEFAULT.bm25_b + DEFAULT.bm25_b * len(x) / avg))
        top = max(raw.values(), default=0)
        out.update({(q, i): r / top for i, r in raw.items() if round(r / top, 6) >= DEFAULT.bm25_floor})
    return out


def check(spark, index, docs, queries):
    q = spark.createDataFrame(sorted(queries.items()), "item_id long, text string")
    want = brute(docs, queries)
    got = {(r["query"], r["id"]): r["score"] for r in li.scores(index, q).collect()}
    assert got.keys() == want.keys() and all(abs(got[k] - v) < 2e-6 for k, v in want.items())
    for k in (1, 7):
        best = {}
        for r in li.top(index, q, k).collect():
            assert abs(r["score"] - want[r["query"], r["id"]]) < 2e-6
            best.setdefault(r["query"], []).append((r["rank"], -r["score"], r["id"]))
        for x in queries:
            all_of = sorted((-round(got[x, i], 6), i) for (y, i) in want if y == x)[:k]
            assert [(s, i) for _, s, i in sorted(best.get(x, []))] == all_of
    some = spark.createDataFrame([(x, i) for x in queries for i in list(docs)[::5]], "query long, id long")
    gates = {(r["query"], r["id"]): r["score"] for r in li.gate(index, q, some).collect()}
    assert gates.keys() == {k for k in want if k[1] in set(list(docs)[::5])} and all(abs(gates[k] - want[k]) < 2e-6 for k in gates)
    stats = {r["term"]: r["df"] for r in li.term_stats(index).collect()}
    assert stats == Counter(w for t in docs.values() for w in set(t.split()) - {"the"})


@pytest.fixture
def small(monkeypatch):
    monkeypatch.setattr(li, "BLOCK", 8)
    monkeypatch.setattr(li, "FIRST", 1)


QUERIES = {1: "word1 word2 word2", 2: "0x1f v1.2", 3: "the", 4: "nothing like it", 5: " ".join(WORDS)}


def test_changes_in_part_give_the_scores_of_a_rebuild(spark, tmp_path, small):
    rng, path = random.Random(1), f"file://{tmp_path}/index"
    docs = texts(rng, 90)
    check(spark, li.build(frame(spark, docs), path), docs, QUERIES)
    changed, gone = texts(rng, 12, 80), [3, 4, 85, 999]
    index = li.update(spark, path, frame(spark, changed), spark.createDataFrame([(i,) for i in gone], "doc_id long"))
    docs = {i: t for i, t in (docs | changed).items() if i not in gone or i in changed}
    assert index.documents == len(docs) and len(index.generations) == 3
    check(spark, index, docs, QUERIES)
    again = texts(rng, 3, 84)
    docs = docs | again
    li.update(spark, path, frame(spark, again))
    index = li.update(spark, path, deleted=spark.createDataFrame([(0,), (86,)], "doc_id long"))
    docs = {i: t for i, t in docs.items() if i not in (0, 86)}
    check(spark, index, docs, QUERIES)
    index = li.compact(spark, path)
    assert len(index.generations) == 1 and li.load(spark, path) == index
    check(spark, index, docs, QUERIES)


def test_within_restricts_before_scores_are_relative(spark, small):
    docs = texts(random.Random(2), 60)
    index, q = li.build(frame(spark, docs)), spark.createDataFrame([(1, "word1 word3")], "item_id long, text string")
    allowed = [i for i in docs if i % 3 == 0]
    got = [(r["id"], r["score"]) for r in li.top(index, q, 5, within=spark.createDataFrame([(i,) for i in allowed], "id long")).orderBy("rank").collect()]
    want = {i: s for (_, i), s in brute(docs, {1: "word1 word3"}).items() if i in allowed}
    top = max(want.values())
    assert got[0][1] == 1.0 and [i for i, _ in got] == [i for i, _ in sorted(want.items(), key=lambda x: (-round(x[1] / top, 6), x[0]))[:5]]


def test_empty_and_null_texts(spark):
    docs = spark.createDataFrame([(1, None), (2, ""), (3, "word1")], "doc_id long, text string")
    q = spark.createDataFrame([(1, "word1"), (2, None)], "item_id long, text string")
    assert [tuple(r) for r in li.top(li.build(docs), q, 3).collect()] == [(1, 3, 1.0, 1)]
    empty = li.build(docs.limit(0))
    assert li.top(empty, q, 3).count() == 0 and li.scores(empty, q).count() == 0 and empty.average == 1.0


def test_two_writers_lose_nothing(spark, tmp_path, monkeypatch):
    path, docs = f"file://{tmp_path}/index", {k: f"word{k} word0" for k in range(6)}
    li.build(frame(spark, docs), path)
    real, raced = store._switch, []

    def other_first(spark_, path_, *args, **kw):
        if not raced:
            raced.append(True)
            li.update(spark, path, frame(spark, {2: "word20 word0", 7: "word7"}))
        return real(spark_, path_, *args, **kw)

    monkeypatch.setattr(store, "_switch", other_first)
    index = li.update(spark, path, frame(spark, {2: "word30", 8: "word8 word0"}))
    assert raced
    check(spark, index, docs | {2: "word30", 7: "word7", 8: "word8 word0"}, {1: "word0 word2 word20 word30", 2: "word7 word8"})


def test_bounds_leave_blocks_closed(spark, monkeypatch):
    monkeypatch.setattr(li, "BLOCK", 8)
    docs = {k: "word1 " + "word2 " * (k % 4) + "filler " * (k + 1) for k in range(200)} | {500: "word1 word1 word3"}
    opened, every = li.opened(li.build(frame(spark, docs)), spark.createDataFrame([(1, "word1 word3")], "item_id long, text string"), 3)
    assert opened < every / 2
