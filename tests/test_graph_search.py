"""Bounded graph search against plain loops, with hubs, cycles and full seeds."""

from __future__ import annotations

import random

import pytest

from quarry.operators import graph


def _near(edges, start, hops, limit):
    out = {}
    for seed, nodes in start.items():
        hop, front = dict.fromkeys(nodes, 0), set(nodes)
        for h in range(1, hops + 1):
            front = {b for a, b in edges if a in front} - hop.keys()
            hop.update(dict.fromkeys(front, h))
        out.update({(seed, n): h for n, h in sorted(((n, h) for n, h in hop.items() if h), key=lambda x: (x[1], x[0]))[:limit]})
    return out


@pytest.mark.parametrize("direction", ["out", "in", "both"])
def test_neighbors_with_hubs_and_full_seeds(spark, direction):
    rng = random.Random(3)
    pairs = {(rng.randrange(60), rng.randrange(60)) for _ in range(70)} | {(0, k) for k in range(1, 60)} | {(k, 1) for k in range(2, 50)}
    edges = spark.createDataFrame([*pairs, (3, None)], "src long, dst long")
    start = {k: {k} for k in (0, 5, 7, 9, 58)} | {100: {5, 59}}
    rows = spark.createDataFrame([(s, n) for s, x in start.items() for n in x], "seed long, node long")
    step = pairs if direction == "out" else {(b, a) for a, b in pairs} if direction == "in" else pairs | {(b, a) for a, b in pairs}
    for hops, limit in ((1, 4), (2, 3), (2, 12), (2, 500)):
        got = {(r["seed"], r["node"]): r["hop"] for r in graph.neighbors(edges, rows, hops, direction, limit).collect()}
        assert got == _near(step, start, hops, limit)


def test_files_tell_what_the_limit_left_out(spark):
    edges = spark.createDataFrame([(1, k, "includes", None) for k in range(2, 8)] + [(9, 10, "calls", None), (9, 11, "imports", None)], "src long, dst long, type string, ambiguity_group long")
    rows = spark.createDataFrame([(1, 1), (9, 9)], "seed long, node long")
    got = sorted(map(tuple, graph.file_neighbors(edges, rows, 1, 3).select("seed", "node", "hop", "truncated").collect()))
    assert got == [(1, 2, 1, True), (1, 3, 1, True), (1, 4, 1, True), (9, 11, 1, False)]


def _paths(edges, src, dst, most, limit):
    done, front = [], [[src]]
    for _ in range(most):
        front = [[*p, b] for p in front for a, b in edges if a == p[-1] and b not in p]
        done += [p for p in front if p[-1] == dst]
        front = [p for p in front if p[-1] != dst]
    return sorted((len(p) - 1, " ".join(map(str, p))) for p in done)[:limit]


def test_paths_meet_in_the_middle(spark):
    rng = random.Random(4)
    pairs = {(rng.randrange(14), rng.randrange(14)) for _ in range(34)} | {(2, k) for k in range(8)}
    edges = spark.createDataFrame(sorted(pairs), "src long, dst long")
    asked = [(a, b) for a in range(14) for b in range(14)]
    for most, limit in ((1, 3), (2, 2), (3, 3), (4, 3)):
        got = {}
        for r in graph.paths(edges, spark.createDataFrame(asked + asked[:5], "src long, dst long"), most, limit).collect():
            got.setdefault((r["src"], r["dst"]), []).append((r["hops"], r["path"].replace(" > ", " ")))
        assert {k: sorted(v) for k, v in got.items()} == {(a, b): x for a, b in asked if a != b and (x := _paths(pairs, a, b, most, limit))}


def test_neighbors_of_more_nodes_than_a_broadcast_side_takes_and_of_repeated_edges(spark, monkeypatch):
    monkeypatch.setattr(graph, "MOST", 2)
    monkeypatch.setattr(graph, "EDGES", 40)
    rng = random.Random(6)
    pairs = {(rng.randrange(40), rng.randrange(40)) for _ in range(60)} | {(0, k) for k in range(1, 40)}
    edges = spark.createDataFrame([*pairs, *pairs, *pairs], "src long, dst long")
    start = {k: {k} for k in (0, 5, 7, 9)}
    got = {(r["seed"], r["node"]): r["hop"] for r in graph.neighbors(edges, spark.createDataFrame([(s, s) for s in start], "seed long, node long"), 2, "both", 6).collect()}
    assert got == _near(pairs | {(b, a) for a, b in pairs}, start, 2, 6)
