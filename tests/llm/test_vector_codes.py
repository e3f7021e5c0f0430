from __future__ import annotations

import hashlib
import math
import random

import duckdb
import numpy as np
import pytest

from quarry.llm import vector_codes as vc

SCHEMA = "vec_id long, embedding array<double>, label int, code string, error int, sub int"


def brute(rows, parts=vc.PARTS, entries=vc.ENTRIES, rounds=vc.ROUNDS):
    """The operator's rows by plain loops over Python's integers."""
    kept = [(i, [math.floor(256 * x) for x in v], y) for i, v, y in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    width = max(1, -(-max((len(v) for _, v, _ in kept), default=0) // parts))
    kept = [(i, v + [0] * (parts * width - len(v)), y) for i, v, y in kept]
    first = sorted(kept, key=lambda r: (r[0] is None, r[0] or 0, r[1]))[:entries]
    cut = lambda v, p: v[p * width : (p + 1) * width]
    books = [[cut(v, p) for _, v, _ in first] for p in range(parts)]

    def near(x, book):
        return min((sum((a - b) ** 2 for a, b in zip(x, c, strict=True)), e) for e, c in enumerate(book))

    for _ in range(rounds):
        for p in range(parts):
            held = {}
            for _, v, _ in kept:
                held.setdefault(near(cut(v, p), books[p])[1], []).append(cut(v, p))
            books[p] = [[sum(c) // len(held[e]) for c in zip(*held[e], strict=True)] if e in held else c for e, c in enumerate(books[p])]
    sha = hashlib.sha256(",".join(str(x) for b in books for c in b for x in c).encode()).hexdigest()
    out, sums = [], {}
    for i, v, y in kept:
        found = [near(cut(v, p), books[p]) for p in range(parts)]
        error = sum(d for d, _ in found)
        sums[y] = sums.get(y, 0) + error
        out.append((i, "".join(f"{e:02x}" for _, e in found), min(error, vc.LARGEST), y))
    return sorted(((i, c, e, min(sums[y], vc.LARGEST), sha) for i, c, e, y in out), key=str)


def run(spark, rows, **options):
    df = spark.createDataFrame([(*r, "x", 1, 2) for r in rows], SCHEMA)
    got = vc.compress_vectors(df, **options)[0]
    return sorted(map(tuple, got.select("vec_id", "code", "error", "label_error", "codebooks_sha256").collect()), key=str)


@pytest.mark.parametrize("spread", [3, 40, 10_000])
def test_tree_finds_the_nearest_entry_with_the_lowest_index(spread):
    rng = np.random.default_rng(spread)
    for width in (1, 2, 4):
        entries, points = rng.integers(-spread, spread, (64, width)), rng.integers(-spread, spread, (500, width))
        found, best = vc.Tree(entries).nearest(points)
        distances = ((points[:, None] - entries[None]) ** 2).sum(2)
        assert (found == distances.argmin(1)).all() and (best == distances.min(1)).all()
    assert not vc.Tree(np.ones((64, 2), np.int64)).nearest(points[:, :2])[0].any()


def test_against_brute_force_with_ties_copies_and_a_hot_label(spark):
    rng = random.Random(1)
    rows = [(rng.randrange(120) if k % 9 else None, [rng.choice([-0.01, 0.0, 0.004, 0.5, -1.0]) for _ in range(32)], None if k % 3 == 0 else rng.randrange(3)) for k in range(300)]
    rows += rows[:20]
    assert run(spark, rows) == brute(rows)


def test_odd_rows(spark):
    inf, nan = float("inf"), float("nan")
    rows = [(1, [1.0] * 16, 0), (2, None, 0), (3, [1.0, None], 1), (4, [nan] * 16, 1), (5, [-inf], 1), (6, [], None), (None, [0.25, -0.001], None), (7, [2.0] * 20, 5), (7, [2.0] * 20, 5)]
    got = run(spark, rows)
    assert got == brute(rows) and len(got) == 5


def test_large_components_stay_exact(spark):
    rng = random.Random(2)
    rows = [(k, [rng.uniform(-1, 1) * 10 ** rng.randrange(14) for _ in range(16)], k % 2) for k in range(90)]
    assert run(spark, rows, entries=8) == brute(rows, entries=8)


def test_empty(spark):
    assert run(spark, []) == [] and run(spark, [(1, None, 3)]) == []
    assert vc.compress_vectors(spark.createDataFrame([], SCHEMA))[1] is None
    with pytest.raises(ValueError):
        vc.compress_vectors(spark.createDataFrame([], SCHEMA), entries=257)


def test_query_against_sql_and_brute_force(spark, sf):
    got = sorted(map(tuple, vc.op11_vector_codes(spark, sf).select("vec_id", "code", "error", "label_error", "codebooks_sha256").collect()), key=str)
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{sf}/embeddings.parquet'")
    want = con.sql(f"SELECT vec_id, code, error, label_error, codebooks_sha256 FROM ({vc.OP11_SQL})").fetchall()
    assert got == sorted(want, key=str)
    rows = [(r["vec_id"], r["embedding"], r["label"]) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()]
    assert got == brute(rows)
