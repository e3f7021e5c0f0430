"""N-gram Jaccard join: MinHash buckets give candidates, a Bayesian test drops most, exact set sizes decide the rest.

Texts with the same words are one node. A bucket belongs to the least node that any of its nodes shares a bucket with, and
a node goes once to each owner of its buckets; there all pairs are compared, block by block for an owner of many nodes:
MinHash values in steps, dropping a pair once the posterior probability that its similarity reaches the threshold is below
the tolerance; pairs that remain are verified on their whole shingle sets. A pair with several common owners counts at the
least of them. Pairs never leave a task: it returns each node's number of links and a spanning forest of them.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from fractions import Fraction
from functools import lru_cache
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm import textvec
from quarry.llm.common import SALTS, annotate, annotated, materialize, salt, settings, spread, table

WORDS, THRESHOLD = 5, Fraction(4, 5)
#: Buckets: a pair of similarity 0.8 shares none of them with probability (1 - 0.8^5)^32 = 3e-6.
BANDS, ROWS = 32, 5
HASHES = BANDS * ROWS
#: MinHash values compared at a time, and the posterior probability below which a pair is dropped.
STEP, TOLERANCE = 16, 1e-6
#: Nodes and bytes of text of a block, about; the pairs of two blocks are compared in one group.
BLOCK, BLOCK_BYTES = 256, 16 << 20
#: A bucket is hot if it holds over this share of the texts and this many; as each text is in BANDS buckets, BANDS / HOT are at most.
HOT, LEAST_HOT = 1e-3, 1000
_CELLS = 4_000_000
#: A Bloom filter of the candidates' ids, 8 MB at most by Spark's default bound, is applied to the texts before a shuffle.
PRUNE = {
    "spark.sql.optimizer.runtime.bloomFilter.enabled": "true",
    "spark.sql.optimizer.runtime.bloomFilter.applicationSideScanSizeThreshold": "0",
    "spark.sql.optimizer.runtime.bloomFilter.creationSideThreshold": "100g",
    "spark.sql.execution.arrow.maxRecordsPerBatch": "512",
}
_rng = np.random.default_rng(5)
_XOR, _MUL = _rng.integers(0, 1 << 32, HASHES, dtype=np.uint32), _rng.integers(0, 1 << 32, HASHES, dtype=np.uint32) | np.uint32(1)
_BAND = _rng.integers(0, 1 << 63, (BANDS, ROWS), dtype=np.uint64) | np.uint64(1)


def minhash(flat: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """A row of HASHES values per text with shingles; others get rows of zeros."""
    out = np.zeros((len(offsets) - 1, HASHES), np.uint32)
    some = np.flatnonzero(np.diff(offsets))
    if len(some):
        x = (flat >> np.uint64(32)).astype(np.uint32)
        for j in range(HASHES):
            h = (x ^ _XOR[j]) * _MUL[j]
            h ^= h >> np.uint32(15)
            out[some, j] = np.minimum.reduceat(h, offsets[some])
    return out


def bands(signatures: np.ndarray) -> np.ndarray:
    parts = signatures.reshape(len(signatures), BANDS, ROWS).astype(np.uint64)
    return textvec.mix((parts * _BAND[None]).sum(2, dtype=np.uint64)).view(np.int64)


@lru_cache
def least_matches(threshold: Fraction = THRESHOLD, tolerance: float = TOLERANCE) -> dict[int, int]:
    """For n compared values, the fewest matches m for which P(similarity >= threshold | m, n) reaches the tolerance.

    With a uniform prior the posterior is Beta(m + 1, n - m + 1), whose upper tail is a sum of binomials.
    """
    t, out = float(threshold), {}
    for n in range(STEP, HASHES + 1, STEP):
        tail, m = 0.0, -1
        while tail < tolerance:  # P(Beta(m + 1, n - m + 1) >= t) = P(Binomial(n + 1, t) <= m)
            m += 1
            tail += comb(n + 1, m) * t**m * (1 - t) ** (n + 1 - m)
        out[n] = m
    return out


def candidates(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Which pairs of signatures (rows of a, rows of b) no step of the Bayesian test drops."""
    alive, matches = np.ones((len(a), len(b)), bool), np.zeros((len(a), len(b)), np.int16)
    for n, least in least_matches().items():
        for j in range(n - STEP, n):
            matches += a[:, j][:, None] == b[:, j][None]
        alive &= matches >= least
        if not alive.any():
            break
    return alive


def linked(a: list[np.ndarray], b: list[np.ndarray], wanted: np.ndarray) -> np.ndarray:
    """Which of the wanted pairs of shingle sets (sorted, distinct) reach the threshold, counted exactly."""
    out = np.zeros_like(wanted)
    rows, cols = np.flatnonzero(wanted.any(1)), np.flatnonzero(wanted.any(0))
    if not len(rows):
        return out
    names, where = np.unique(np.concatenate([a[i] for i in rows] + [b[j] for j in cols]), return_inverse=True)
    sizes = [len(a[i]) for i in rows] + [len(b[j]) for j in cols]
    of = np.repeat(np.arange(len(sizes)), sizes)
    order = np.argsort(where, kind="stable")
    where, of = where[order], of[order]
    common = np.zeros((len(rows), len(cols)), np.float32)
    step = max(1, _CELLS // len(sizes))
    for lo in range(0, len(names), step):
        i, j = np.searchsorted(where, [lo, lo + step])
        m = np.zeros((len(sizes), min(step, len(names) - lo)), np.float32)
        m[of[i:j], where[i:j] - lo] = 1
        common += m[: len(rows)] @ m[len(rows) :].T  # whole numbers below 2^24 are exact in a chunk
    union = np.array(sizes[: len(rows)])[:, None] + np.array(sizes[len(rows) :])[None] - common
    out[np.ix_(rows, cols)] = common * THRESHOLD.denominator >= union * THRESHOLD.numerator
    return out & wanted


def _signed(cols: dict) -> Iterator[dict]:
    normals = [textvec.normal(t) for t in cols["text"]]
    flat, offsets = textvec.shingles(*textvec.word_hashes(normals), WORDS)
    sig = bands(minhash(flat, offsets))
    some = np.diff(offsets) > 0
    yield {"key": [hashlib.md5(b).digest() for b in normals], "bands": [x if s else [] for x, s in zip(sig.tolist(), some, strict=True)]}


def _here(owners: list[list[int]], owner: int) -> np.ndarray:
    """Which pairs of nodes count at owner: those of which it is the least common owner."""
    names: dict[tuple, int] = {}
    of = np.array([names.setdefault(tuple(x), len(names)) for x in owners])
    sets = [{y for y in x if y < owner} for x in names]
    free = np.array([[not (a & b) for b in sets] for a in sets])
    return free[of][:, of]


def _compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Groups (owner, i, j) of blocks i and j: the links between nodes of the two, or within one if i = j."""
    schema = pa.schema([("node", pa.int64()), ("links", pa.int64()), ("weight", pa.int64()), ("near", pa.int64())])
    for rows in _groups(batches):
        block = np.array(rows["block"])
        flat, offsets = textvec.shingles(*textvec.word_hashes([textvec.normal(t) for t in rows["text"]]), WORDS)
        sets = [np.unique(flat[x:y]) for x, y in zip(offsets, offsets[1:], strict=False)]
        sig, here = minhash(flat, offsets), _here(rows["owners"], rows["owner"][0])
        one = rows["i"][0] == rows["j"][0]
        left, right = np.flatnonzero(block == rows["i"][0]), np.flatnonzero(block == rows["j"][0])
        nodes, weights = np.array(rows["node"]), np.array(rows["copies"])
        links, weight, parent = np.zeros(len(nodes), np.int64), np.zeros(len(nodes), np.int64), list(range(len(nodes)))
        for x in range(0, len(left), BLOCK):  # a block can hold somewhat more than BLOCK
            for y in range(0, len(right), BLOCK):
                if one and y < x:
                    continue
                p, q = left[x : x + BLOCK], right[y : y + BLOCK]
                wanted = candidates(sig[p], sig[q]) & here[np.ix_(p, q)]
                if one and x == y:
                    wanted &= np.triu(np.ones_like(wanted), 1)
                found = linked([sets[k] for k in p], [sets[k] for k in q], wanted)
                links[p] += found.sum(1)
                links[q] += found.sum(0)
                weight[p] += found @ weights[q]
                weight[q] += weights[p] @ found
                for k in np.flatnonzero(found.any(1)):
                    for m in np.flatnonzero(found[k]):
                        u, v = _root(parent, p[k]), _root(parent, q[m])
                        if u != v:
                            parent[max(u, v)] = min(u, v)
        some = np.flatnonzero(links)
        yield pa.RecordBatch.from_pydict({"node": nodes[some], "links": links[some], "weight": weight[some], "near": [nodes[_root(parent, int(k))] for k in some]}, schema=schema)


def _root(parent: list[int], k: int) -> int:
    while parent[k] != k:
        parent[k] = parent[parent[k]]
        k = parent[k]
    return k


def _groups(batches: Iterator[pa.RecordBatch]) -> Iterator[dict[str, list]]:
    key, held = None, {}
    for batch in batches:
        cols = batch.to_pydict()
        for k, now in enumerate(zip(cols["owner"], cols["i"], cols["j"], strict=True)):
            if now != key:
                if held:
                    yield held
                key, held = now, {c: [] for c in cols}
            for c, v in cols.items():
                held[c].append(v[k])
    if held:
        yield held


def components(edges: DataFrame) -> DataFrame:
    """(id, part) for all ends of edges (a, b): part is the least id that is connected to id.

    Large-star and small-star steps in turn, each written to the shared folder, until nothing changes.
    """
    edges = materialize(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    ends = materialize(edges.select(F.col("a").alias("id")).union(edges.select("b")).distinct(), "ends")
    before = None
    while True:
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        # large star: neighbours above a node are tied to the least of its neighbourhood
        # (a node with very many neighbours is dealt over the sub-keys of these)
        both = both.withColumn("s", salt("b"))
        least = both.groupBy("a", "s").agg(F.min("b").alias("m")).groupBy("a").agg(F.min("m").alias("m"), F.collect_list("s").alias("s"))
        least = least.select("a", F.explode("s").alias("s"), F.least("a", "m").alias("m"))
        large = both.where("b > a").join(least, ["a", "s"]).select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        large = materialize(large, "star")
        # small star: a node and its lesser neighbours are tied to the least of them
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        edges = large.join(least, "a").select(F.explode(F.array("a", "b")).alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        edges = materialize(edges, "star")
        state = tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b") % (1 << 40))).first())
        if state == before:
            break
        before = state
    return ends.join(edges.select(F.col("a").alias("id"), F.col("b").alias("part")), "id", "left").select("id", F.coalesce("part", "id").alias("part"))


def _owned(hashed: DataFrame, texts: int) -> DataFrame:
    """(node, owners) of the nodes (node, band, h) that share a bucket (band, h) with others; texts: number of nodes.

    Least nodes of buckets are combined where the rows are; where rows meet their bucket's, hot ones are dealt over sub-keys.
    """
    shared = materialize(hashed.groupBy("band", "h").agg(F.min("node").alias("least"), F.count("*").alias("n")).where("n > 1"), "shared")
    hot = F.broadcast(shared.where(F.col("n") > max(HOT * texts, LEAST_HOT)).select("band", "h", F.lit(True).alias("hot")))  # BANDS / HOT rows at most

    def dealt(rows: DataFrame) -> DataFrame:
        return rows.join(hot, ["band", "h"], "left").withColumn("sub", F.when(F.col("hot"), salt("node", SALTS)).otherwise(0)).drop("hot")

    def spread_out(buckets: DataFrame) -> DataFrame:
        subs = F.when(F.col("hot"), F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))
        return buckets.join(hot, ["band", "h"], "left").withColumn("sub", F.explode(subs)).drop("hot")

    with settings(hashed.sparkSession, PRUNE):
        hits = materialize(dealt(hashed).join(spread_out(shared.where("n > 1")).drop("n"), ["band", "h", "sub"]), "hits")
    hits = materialize(hits.join(hits.groupBy("node").agg(F.min("least").alias("label")), "node"), "labels")
    owners = hits.groupBy("band", "h").agg(F.min("label").alias("owner"))
    owned = hits.join(spread_out(owners), ["band", "h", "sub"])
    return owned.groupBy("node").agg(F.sort_array(F.collect_set("owner")).alias("owners"))


def jaccard_rows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The columns of docs, as annotate() names them, with class_id, n_links, n_text_links, n_copies and kept of jaccard_join()."""
    width = len(docs.columns)
    columns = [f"_c{k}" for k in range(width)]
    rows = docs.toDF(*columns).withColumn("row", F.monotonically_increasing_id())
    text = annotated(docs, text_col)
    signed = annotate(rows, _signed, "key binary, bands array<long>", text_col=f"_c{docs.columns.index(text_col)}")
    signed = materialize(signed.withColumnRenamed(f"_c{width}", "row").withColumn("id", annotated(docs, id_col).cast("long")), "signed")  # written, so row numbers are stable
    dealt = signed.withColumn("sub", salt("row"))
    subs = dealt.groupBy("key", "sub").agg(F.min("id").alias("id"), F.min("row").alias("node"), F.count("*").alias("n"))
    texts = materialize(subs.groupBy("key").agg(F.min("id").alias("id"), F.min("node").alias("node"), F.sum("n").alias("copies"), F.collect_list("sub").alias("subs")), "texts")
    nodes = materialize(signed.where("size(bands) > 0").select(F.col("row").alias("node"), "bands", F.octet_length(text).alias("size")).join(texts.select("node", "copies"), "node"), "nodes")
    owned = _owned(nodes.select("node", F.posexplode("bands").alias("band", "h")), nodes.count()).join(nodes.select("node", "size", "copies"), "node")
    asked = materialize(owned.withColumn("owner", F.explode("owners")).withColumn("sub", salt("node")), "asked")
    sizes = spread(asked, ["owner"], "sub", n=(F.sum, F.lit(1)), bytes=(F.sum, "size"))
    asked = asked.join(sizes, ["owner", "sub"]).withColumn("blocks", F.ceil(F.greatest(F.col("n") / BLOCK, F.col("bytes") / BLOCK_BYTES)).cast("int"))
    asked = materialize(asked.select("owner", "owners", "node", "copies", "blocks", F.pmod(F.xxhash64("node", F.lit("block")), F.col("blocks")).cast("int").alias("block")), "blocks")
    with settings(docs.sparkSession, PRUNE):  # only candidates' texts are shuffled
        full = signed.select(F.col("row").alias("node"), text.alias("text")).join(asked.where("blocks > 0"), "node").withColumn("other", F.explode(F.expr("sequence(0, blocks - 1)")))
        pairs = full.select("owner", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", "node", "owners", "copies", "text")
        # by range, as groups of blocks are few and alike in size, and a hash would put several of them in one task
        grouped = pairs.repartitionByRange("owner", "i", "j").sortWithinPartitions("owner", "i", "j")
        found = materialize(grouped.mapInArrow(_compare, "node long, links long, weight long, near long"), "links")
    classes = components(found.select(F.col("node").alias("a"), F.col("near").alias("b")))
    counts = found.groupBy("node").agg(F.sum("links").alias("links"), F.sum("weight").alias("weight"))
    of = texts.join(counts, "node", "left").join(classes.select(F.col("id").alias("node"), "part"), "node", "left")
    of = materialize(of.withColumn("part", F.coalesce("part", "node")).withColumn("deal", salt("node")), "counted")
    classes = spread(of, ["part"], "deal", class_id=(F.min, "id"), first=(F.min, "node"))
    of = of.drop("id").join(classes, ["part", "deal"]).withColumn("sub", F.explode("subs")).select("key", "sub", "class_id", "first", "links", "weight", "copies")
    return dealt.select(*columns, "row", "key", "sub").join(of, ["key", "sub"]).select(
        *columns, "class_id", (F.coalesce("weight", F.lit(0)) + F.col("copies") - 1).alias("n_links"),
        F.coalesce("links", F.lit(0)).alias("n_text_links"), F.col("copies").alias("n_copies"), (F.col("row") == F.col("first")).alias("kept"),
    )


def jaccard_join(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: doc_id, class_id, n_links, n_text_links, n_copies, kept.

    Texts are linked if the sets of their runs of WORDS words (of all words, if fewer) have a Jaccard similarity of
    THRESHOLD or more. A class is a set of documents connected by links; class_id is its least id. n_links: other rows
    linked to the row, n_text_links: texts of other words linked to its text, n_copies: rows with its words, itself among
    them. kept: whether the row is the one of its class to stay, the first in the table. Texts without words (null,
    empty, punctuation) are copies of one another and are linked to no others. Links and classes go by rows: ids may be
    null or repeated, with different texts too. A null id is never a class_id unless the class has no other. An empty
    table gives no rows; other columns are ignored; repeated rows are copies.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    return jaccard_rows(rows, "id", "text").drop("_c1").withColumnRenamed("_c0", id_col)


def op8_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join(table(spark, sf_dir, "documents"))
