"""Exact dedup: a minimal perfect hash over the distinct digests of the history answers for new rows.

The history is split into shards by digest. A shard's task builds a minimal perfect hash whose slots hold the full
digest, the winner's locator (its id) and the number of rows. Digests of new rows go to their shard, a lookup compares
all bytes, and members join the group of their slot; nonmembers form groups of their own.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quarry.llm import mphf
from quarry.llm.common import SALTS, materialize, table

#: Distinct digests of the history, or of the new rows, in one shard; about 50 bytes each.
SHARD_KEYS = 50_000


def digest(text: str | Column) -> Column:
    """SHA-256 of the text in UTF-8 as 32 bytes; null counts as empty."""
    return F.unhex(F.sha2(F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit("")), 256))


def _shard(n: int) -> Column:
    return F.pmod(F.xxhash64("digest"), F.lit(n)).cast("int")


def _groups(rows: DataFrame, old: bool) -> DataFrame:
    """A row per digest; rows of hot digests are combined by sub-key before they meet."""
    return (
        rows.groupBy("digest", "sub").agg(F.max("id").alias("id"), F.count("*").alias("n"))
        .groupBy("digest").agg(F.max(F.struct("id", "sub")).alias("w"), F.sum("n").alias("n"), F.sort_array(F.collect_list("sub")).alias("subs"))
        .select("digest", F.col("w.id").alias("winner"), F.col("w.sub").alias("place"), "n", "subs", F.lit(old).alias("old"))
    )


def build_index(history: DataFrame, shards: int) -> DataFrame:
    """Index of history (digest, winner, n; distinct digests): a row per shard that has digests."""

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for shard, rows in _by_shard(batches):
            sizes, bits, slots = mphf.build(rows["digest"])
            order = sorted(range(len(slots)), key=slots.__getitem__)
            yield pa.RecordBatch.from_pydict({
                "shard": [shard], "sizes": [sizes], "bits": [bits], "digests": [b"".join(rows["digest"][i] for i in order)],
                "winners": [[rows["winner"][i] for i in order]], "places": [[rows["place"][i] for i in order]], "counts": [[rows["n"][i] for i in order]],
            }, schema=pa.schema([("shard", pa.int32()), ("sizes", pa.list_(pa.int64())), ("bits", pa.binary()), ("digests", pa.binary()), ("winners", pa.list_(pa.int64())), ("places", pa.list_(pa.int32())), ("counts", pa.list_(pa.int64()))]))

    rows = history.select(_shard(shards).alias("shard"), "digest", "winner", "place", "n").repartition("shard").sortWithinPartitions("shard")
    return rows.mapInArrow(build, "shard int, sizes array<long>, bits binary, digests binary, winners array<long>, places array<int>, counts array<long>")


def _by_shard(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, dict[str, list]]]:
    """Rows of each shard, of batches that are sorted by shard."""
    shard, held = None, {}
    for batch in batches:
        cols = batch.to_pydict()
        for k, s in enumerate(cols["shard"]):
            if s != shard:
                if held:
                    yield shard, held
                shard, held = s, {c: [] for c in cols}
            for c, v in cols.items():
                held[c].append(v[k])
    if held:
        yield shard, held


def lookup(groups: DataFrame, index: DataFrame, shards: int) -> DataFrame:
    """groups (digest, winner, place, n, subs) with old_winner, old_place and old_n of their slot; null for nonmembers."""

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, rows in _by_shard(batches):
            i = next((k for k, x in enumerate(rows["sizes"]) if x is not None), None)
            ask = [k for k, x in enumerate(rows["digest"]) if x is not None]
            if not ask:
                continue
            keys = [rows["digest"][k] for k in ask]
            winners, places, counts = [None] * len(ask), [None] * len(ask), [None] * len(ask)
            if i is not None:
                full = rows["digests"][i]
                for k, s in enumerate(mphf.probe(rows["sizes"][i], rows["bits"][i], keys).tolist()):
                    if s >= 0 and full[32 * s : 32 * s + 32] == keys[k]:
                        winners[k], places[k], counts[k] = rows["winners"][i][s], rows["places"][i][s], rows["counts"][i][s]
            yield pa.RecordBatch.from_pydict({
                "digest": keys, "winner": [rows["winner"][k] for k in ask], "place": [rows["place"][k] for k in ask], "n": [rows["n"][k] for k in ask], "subs": [rows["subs"][k] for k in ask],
                "old_winner": winners, "old_place": places, "old_n": counts,
            }, schema=pa.schema([("digest", pa.binary()), ("winner", pa.int64()), ("place", pa.int32()), ("n", pa.int64()), ("subs", pa.list_(pa.int32())), ("old_winner", pa.int64()), ("old_place", pa.int32()), ("old_n", pa.int64())]))

    asked = groups.select(_shard(shards).alias("shard"), "digest", "winner", "place", "n", "subs")
    both = asked.unionByName(index, allowMissingColumns=True).repartition("shard").sortWithinPartitions("shard")
    return both.mapInArrow(probe, "digest binary, winner long, place int, n long, subs array<int>, old_winner long, old_place int, old_n long")


def exact_dedup(docs: DataFrame, history: Column, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: doc_id, keep_id, group_size, kept, text_sha256, known.

    history: boolean column; its rows are those of earlier batches, over whose digests the index is built. Texts are
    equal if their bytes are; a null text counts as empty. The largest id of a group stays. Nulls in history count as
    false; null ids never win over others and rows with them are kept only if their whole group has none. Of rows with
    the same id and text one is kept. An empty table gives no rows; other columns are ignored. known: the text is in the
    history.
    """
    rows = materialize(
        docs.select(F.col(id_col).cast("long").alias("id"), digest(text_col).alias("digest"), F.coalesce(history, F.lit(False)).alias("old"), F.pmod(F.monotonically_increasing_id(), F.lit(SALTS)).cast("int").alias("sub")),
        "digests",
    )
    past, new = _groups(rows.where("old"), True), _groups(rows.where("NOT old"), False)
    past, new = materialize(past, "past"), materialize(new, "new")
    shards = -(-max(past.count(), new.count()) // SHARD_KEYS) or 1
    index = materialize(build_index(past, shards), "mphf")
    asked = materialize(lookup(new, index, shards), "asked")
    # what the lookups found updates the winners of the history's groups
    found = asked.where("old_n IS NOT NULL").select("digest", F.struct("winner", "place").alias("new_best"), F.col("n").alias("new_n"), F.col("subs").alias("new_subs"))
    best = F.struct("winner", "place")
    whole = F.when(F.col("new_best") > best, F.col("new_best")).otherwise(best)
    kept_past = past.join(found, "digest", "left").select(
        "digest", whole.alias("best"), (F.col("n") + F.coalesce("new_n", F.lit(0))).alias("group_size"),
        F.array_union("subs", F.coalesce("new_subs", F.array().cast("array<int>"))).alias("subs"), F.lit(True).alias("known"),
    )
    kept_new = asked.where("old_n IS NULL").select("digest", best.alias("best"), F.col("n").alias("group_size"), "subs", F.lit(False).alias("known"))
    answer = kept_past.unionByName(kept_new).select("digest", F.explode("subs").alias("sub"), F.col("best.winner").alias("keep_id"), F.col("best.place").alias("place"), "group_size", "known")
    first = F.row_number().over(Window.partitionBy("digest", "sub").orderBy(F.col("id").desc_nulls_last()))
    return rows.join(answer, ["digest", "sub"]).withColumn("first", first).select(
        F.col("id").alias(id_col), "keep_id", "group_size",
        (F.col("id").eqNullSafe(F.col("keep_id")) & (F.col("sub") == F.col("place")) & _one_of_equals()).alias("kept"), F.lower(F.hex("digest")).alias("text_sha256"), "known",
    )


def _one_of_equals() -> Column:
    """Of rows with the same text and id, the first. In a sub-key the largest id comes first, so its first row is row 1."""
    return F.col("first") == 1


def op4_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents: rows with even ids are the history, the others the new batch."""
    docs = table(spark, sf_dir, "documents")
    return exact_dedup(docs, F.col("doc_id") % 2 == 0)


OP4_SQL = """
WITH t AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
g AS (SELECT text, max(doc_id) AS keep_id, count(*) AS group_size, bool_or(doc_id % 2 = 0) AS known FROM t GROUP BY text)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(t.text) AS text_sha256, known
FROM t JOIN g ON t.text = g.text
"""
