from __future__ import annotations

import random
import zlib

from quarry.llm import sharding


def test_tree_finds_the_tightest_bin():
    rng, tree, bins = random.Random(1), sharding.SizeTree(), []
    for i in range(3000):
        if bins and rng.random() < 0.5:
            size = rng.randrange(1000)
            fit = min((b for b in bins if b[0] >= size), default=None)
            assert tree.pop_tightest(size) == fit
            if fit:
                bins.remove(fit)
        else:
            bins.append((rng.randrange(1000), i))
            tree.add(bins[-1])


def test_tree_stays_balanced():
    tree = sharding.SizeTree()
    for i in range(4000):
        tree.add((i, i))
    for size in range(0, 1500):
        tree.pop_tightest(size)

    def height(t):
        return 1 + max(height(tree.left[t]), height(tree.right[t])) if t else 0

    assert height(tree.root) <= 2 * 12 and len(tree.key) == 4001
    for i in range(1000):
        tree.add((9, i))
    assert len(tree.key) == 4001


def test_whole_result_against_packing_all_groups_at_once(spark, monkeypatch):
    """With pallets smaller than any group the driver packs the groups themselves."""
    monkeypatch.setattr(sharding, "PALLETS", 10**9)
    rng = random.Random(5)
    docs = [(i if i % 5 else None, rng.choice("abcdefgh") * rng.choice([0, 3, 40, 200, 500 + i % 50])) for i in range(700)]
    rows = sharding.shard(spark.createDataFrame(docs, "doc_id long, text string"), 7).collect()
    sizes = {}
    for _, t in docs:
        sizes[t] = sizes.get(t, 0) + len(t) + 8
    order = sorted(sizes.values(), reverse=True)
    want = sharding._loads(order, sharding.pack_evenly(order, 7), 7)
    got = [0] * 7
    for r in rows:
        got[r["shard"]] += r["size"]
    assert sorted(got) == sorted(want) and len(rows) == 700
    by = {}
    for r in rows:
        by.setdefault((r["text_crc32"], r["size"]), set()).add(r["shard"])
    assert all(len(x) == 1 for x in by.values())


def test_best_fit_decreasing_against_brute_force():
    rng = random.Random(2)
    for _ in range(50):
        sizes, cap = [rng.randrange(1, 60) for _ in range(40)], 60
        got, left = sharding.best_fit_decreasing(sizes, cap), []
        for i in sorted(range(40), key=lambda i: (-sizes[i], i)):
            fit = min(((r, b) for b, r in enumerate(left) if r >= sizes[i]), default=None)
            if fit is None:
                left.append(cap)
                fit = (cap, len(left) - 1)
            left[fit[1]] -= sizes[i]
            assert got[i] == fit[1]


def test_pack_evenly_isolates_large_items():
    of = sharding.pack_evenly([1000] + [1] * 230, 24)
    assert of.count(of[0]) == 1
    loads = sharding._loads([1000] + [1] * 230, of, 24)
    assert max(x for b, x in enumerate(loads) if b != of[0]) == 10
    assert sharding.pack_evenly([], 3) == [] and sharding.pack_evenly([5], 1) == [0]


def _check(rows, docs, shards):
    assert len(rows) == len(docs)
    by_shard, by_text = {}, {}
    for r in rows:
        by_shard.setdefault(r["shard"], []).append(r["slot"])
    assert all(sorted(v) == list(range(len(v))) for v in by_shard.values()) and set(by_shard) <= set(range(shards))
    texts = {}
    for i, t in docs:
        texts.setdefault(i, t)
    for r in rows:
        t = (texts[r["doc_id"]] or "").encode()
        assert r["size"] == len(t) + 8 and r["text_crc32"] == zlib.crc32(t) and r["law"] == "bytes" and r["grown_shard"] is None
        by_text.setdefault(t, set()).add(r["shard"])
    assert all(len(v) == 1 for v in by_text.values())


def test_odd_rows(odd_docs):
    docs = [(r["doc_id"], r["text"]) for r in odd_docs.collect()]
    _check(sharding.shard(odd_docs).collect(), docs, 24)


def test_empty(no_docs):
    assert sharding.shard(no_docs).count() == 0


def test_even_sizes_with_a_hot_group(spark):
    rng = random.Random(4)
    docs = [(i, "same" if i % 3 == 0 else "x" * rng.randrange(300) + str(i)) for i in range(1500)]
    rows = sharding.shard(spark.createDataFrame(docs, "doc_id long, text string"), 6).collect()
    _check(rows, docs, 6)
    loads = {}
    for r in rows:
        loads[r["shard"]] = loads.get(r["shard"], 0) + r["size"]
    assert max(loads.values()) - min(loads.values()) < 0.01 * max(loads.values())
