"""Monotone alignment against the best score over all monotone alignments, and its table verdicts."""

from __future__ import annotations

import random
from difflib import SequenceMatcher
from functools import cache

from quarry.operators import alignment as al
from quarry.plans.queries import QUERIES


def best_score(left, right):
    @cache
    def go(i, j):
        if i == len(left) or j == len(right):
            return al.GAP * (len(left) - i + len(right) - j)
        r = SequenceMatcher(None, left[i], right[j]).ratio()
        return max(go(i + 1, j + 1) + (r if r >= al.LEAST else al.MISS), go(i + 1, j) + al.GAP, go(i, j + 1) + al.GAP)

    return go(0, 0)


def score_of(left, right, found):
    """The score of an alignment with these pairs; unpaired rows between two pairs go together where that is dearer than gaps apart."""
    total, at = 0.0, (0, 0)
    for i, j in [*found, (len(left), len(right))]:
        a, b = i - at[0], j - at[1]
        together = min(a, b)
        total += together * max(al.MISS, 2 * al.GAP) + (a + b - 2 * together) * al.GAP
        if i < len(left):
            total += SequenceMatcher(None, left[i], right[j]).ratio()
        at = i + 1, j + 1
    return total


def test_pairs_have_the_best_score_and_never_cross():
    rng = random.Random(9)
    words = ["alpha", "alphb", "beta 12", "beta 13", "gamma", "", "x"]
    for _ in range(300):
        left, right = ([rng.choice(words) for _ in range(rng.randrange(7))] for _ in range(2))
        found = al.pairs(left, right)
        assert all(a < c and b < d for (a, b), (c, d) in zip(found, found[1:], strict=False))
        assert all(SequenceMatcher(None, left[i], right[j]).ratio() >= al.LEAST for i, j in found)
        assert abs(score_of(left, right, found) - best_score(tuple(left), tuple(right))) < 1e-9
    assert al.pairs(["alpha", "beta", "gamma"], ["alpha", "gamma"]) == [(0, 0), (2, 1)]


def test_swapped_rows_are_never_both_matched(spark):
    left = [(1, k, t) for k, t in enumerate(["one first", "two second", "three third", "four fourth"])]
    right = [(1, k, t) for k, t in enumerate(["two second", "one first", "three third"])]
    schema = "k long, row int, text string"
    row = al.align_rows(spark.createDataFrame(left, schema), spark.createDataFrame(right, schema), "k").first()
    found = [tuple(p) for p in row["pairs"]]
    assert row["strategy"] == "dp" and not {(0, 1), (1, 0)} <= set(found) and (2, 2) in found
    assert all(a < c and b < d for (a, b), (c, d) in zip(found, found[1:], strict=False))


def test_strategies_nulls_and_empty_tables(spark):
    schema = "k long, row int, text string"
    left = spark.createDataFrame([(1, 5, "a"), (1, 9, None), (2, 1, "x"), (3, 1, "x"), (3, 2, "y"), (None, 1, "z")], schema)
    right = spark.createDataFrame([(1, 2, "q"), (1, 3, ""), (3, 4, "x"), (9, 1, "x")], schema)
    got = {r["k"]: (r["strategy"], [tuple(p) for p in r["pairs"]]) for r in al.align_rows(left, right, "k").collect()}
    assert got == {1: ("count", [(5, 2), (9, 3)]), 2: ("empty", []), 3: ("dp", [(1, 4)]), None: ("empty", [])}
    assert al.align_rows(left, right, "k", most=1).where("k = 3").first()["strategy"] == "too_large"
    assert al.align_rows(left.limit(0), right, "k").count() == 0


def test_verdicts_and_blockers(spark):
    schema = "k long, row int, col int, text string"
    cells = spark.createDataFrame([(1, r, c, f"row {r} cell {c}") for r in (1, 2, 3) for c in (1, 2)] + [(2, 1, 1, "a"), (2, 2, 1, "b"), (2, 3, 1, "c")], schema)
    seen = [(1, 11, 1, "row  1 cell 1"), (1, 11, 2, "row 1 other"), (1, 13, 1, "row 3 cell 1"), (2, 1, 1, "a")]
    verdicts, blockers = al.verdicts(cells, spark.createDataFrame(seen, schema), "k")
    got = {(r["k"], r["row"], r["col"]): r["verdict"] for r in verdicts.collect()}
    assert got == {(1, 1, 1): "match", (1, 1, 2): "differ", (1, 2, 1): "unanchored", (1, 2, 2): "unanchored", (1, 3, 1): "match", (1, 3, 2): "none", (2, 1, 1): "none", (2, 2, 1): "none", (2, 3, 1): "none"}
    assert sorted(map(tuple, blockers.collect())) == [(1, "unanchored_rows", 1), (2, "row_alignment_failed", 1)]


def test_conversations_against_brute_force(spark, sf):
    rows = spark.read.parquet(f"{sf}/conversations.parquet").collect()
    sides = {}
    for r in sorted(rows, key=lambda r: r["turn"]):
        sides.setdefault(r["conv_id"] // 2, ([], []))[r["conv_id"] % 2].append((r["turn"], " ".join((r["text"] or "").split())))
    got = {}
    for r in QUERIES["conversation_alignment"](spark, sf).collect():
        got.setdefault(r["k"], []).append((r["row"], r["other"]))
    for k, (a, b) in sides.items():
        found = [p for p in got.get(k, []) if p[0] is not None]
        if len(a) == len(b):
            assert found == [(x[0], y[0]) for x, y in zip(a, b, strict=True)]
        elif a and b:
            where = [([t for t, _ in a].index(x), [t for t, _ in b].index(y)) for x, y in found]
            left, right = [t for _, t in a], [t for _, t in b]
            assert abs(score_of(left, right, where) - best_score(tuple(left), tuple(right))) < 1e-9


def test_only_rows_between_equal_ends_are_compared(spark, monkeypatch):
    calls, real = [], al.likeness
    monkeypatch.setattr(al, "likeness", lambda *x: calls.append(x) or real(*x))
    left = [f"part {k * 7919} of {k}" for k in range(40)]
    right = [x for k, x in enumerate(left) if k != 20]
    right[18] = "other"
    assert al.pairs(left, right) == [(k, k) for k in range(18)] + [(19, 19)] + [(k, k - 1) for k in range(21, 40)] and len(calls) <= 6
    assert al.pairs(["x", "x", "y"], ["x", "y"]) == [(1, 0), (2, 1)]


def test_cells_meet_where_rows_are_aligned(spark, sf):
    plan = QUERIES["alignment_verdicts"](spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Join") == 1 and plan.count("Exchange hashpartitioning(l_orderkey") >= 1 and "hashpartitioning(k" not in plan
