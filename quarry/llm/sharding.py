"""Sharding: best-fit-decreasing bin packing of indivisible groups of equal texts.

Groups below a pallet's size are packed in parallel, by the same rule, into pallets; the driver packs the pallets and
larger groups, of which there can be only a bounded number, into the shards. The shards' common capacity is the
smallest that suffices.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quarry.llm.common import materialize, salt, table

SHARDS = 24
#: Pallets that a shard is divided into; what the driver packs is at most about twice this times the shards, and one
#: partly filled pallet for each of PACKERS tasks.
PALLETS = 1024
PACKERS = 8192


class SizeTree:
    """Bins in the order of (remaining capacity, number): a binary tree balanced by levels.

    A left child is one level below its parent, a right child at most as high, a right grandchild lower; so the height is
    at most twice the logarithm of the number of bins. Node 0 is the empty tree.
    """

    def __init__(self) -> None:
        self.key: list[tuple[int, int]] = [(-1, -1)]
        self.left, self.right, self.level, self.free = [0], [0], [0], []
        self.root = 0

    def add(self, key: tuple[int, int]) -> None:
        self.root = self._add(self.root, key)

    def pop_tightest(self, size: int) -> tuple[int, int] | None:
        """Take out the bin with the least remaining capacity that is size at least."""
        t, found, want = self.root, None, (size, -1)
        while t:
            if self.key[t] >= want:
                found, t = self.key[t], self.left[t]
            else:
                t = self.right[t]
        if found is not None:
            self.root = self._remove(self.root, found)
        return found

    def _skew(self, t: int) -> int:
        """Turn a left child of the same level to the top."""
        x = self.left[t]
        if not x or self.level[x] != self.level[t]:
            return t
        self.left[t], self.right[x] = self.right[x], t
        return x

    def _split(self, t: int) -> int:
        """Raise the middle of three nodes of one level in a row."""
        x = self.right[t]
        if not x or self.level[self.right[x]] != self.level[t]:
            return t
        self.right[t], self.left[x] = self.left[x], t
        self.level[x] += 1
        return x

    def _add(self, t: int, key: tuple[int, int]) -> int:
        if not t:
            if self.free:
                t = self.free.pop()
                self.key[t], self.left[t], self.right[t], self.level[t] = key, 0, 0, 1
                return t
            for column, v in ((self.key, key), (self.left, 0), (self.right, 0), (self.level, 1)):
                column.append(v)
            return len(self.key) - 1
        if key < self.key[t]:
            self.left[t] = self._add(self.left[t], key)
        else:
            self.right[t] = self._add(self.right[t], key)
        return self._split(self._skew(t))

    def _remove(self, t: int, key: tuple[int, int]) -> int:
        if key < self.key[t]:
            self.left[t] = self._remove(self.left[t], key)
        elif key > self.key[t]:
            self.right[t] = self._remove(self.right[t], key)
        elif not self.left[t]:
            self.free.append(t)
            return self.right[t]
        else:  # the greatest of the left takes its place
            x = self.left[t]
            while self.right[x]:
                x = self.right[x]
            self.key[t] = self.key[x]
            self.left[t] = self._remove(self.left[t], self.key[x])
        low = min(self.level[self.left[t]], self.level[self.right[t]]) + 1
        if low < self.level[t]:
            self.level[t] = low
            if self.right[t] and self.level[self.right[t]] > low:
                self.level[self.right[t]] = low
        t = self._skew(t)
        if r := self.right[t]:
            self.right[t] = r = self._skew(r)
            if self.right[r]:
                self.right[r] = self._skew(self.right[r])
        t = self._split(t)
        if self.right[t]:
            self.right[t] = self._split(self.right[t])
        return t


class Packer:
    """Best-fit-decreasing into bins of one capacity; bins stay open for later items."""

    def __init__(self, capacity: int, most: int | None = None) -> None:
        self.capacity, self.most, self.bins, self.tree = capacity, most, 0, SizeTree()

    def add(self, sizes: list[int]) -> list[int] | None:
        """Bin of each item, items taken by falling size (ties: in their order); larger items than the capacity get own bins.

        None if more than most bins would be needed.
        """
        out = [0] * len(sizes)
        for i in sorted(range(len(sizes)), key=lambda i: (-sizes[i], i)):
            found = self.tree.pop_tightest(sizes[i])
            if found is None:
                if self.bins == self.most:
                    return None
                found, self.bins = (max(self.capacity, sizes[i]), self.bins), self.bins + 1
            out[i] = found[1]
            self.tree.add((found[0] - sizes[i], found[1]))
        return out


def best_fit_decreasing(sizes: list[int], capacity: int, most: int | None = None) -> list[int] | None:
    return Packer(capacity, most).add(sizes)


def pack_evenly(sizes: list[int], bins: int) -> list[int]:
    """Bin of each item, by best-fit-decreasing into the smallest common capacity for which bins suffice.

    An item that exceeds an even share has a bin to itself and the others share the rest.
    """
    out, left, free = [-1] * len(sizes), sorted(range(len(sizes)), key=lambda i: (-sizes[i], i)), bins
    total = sum(sizes)
    while len(left) and free > 1 and sizes[left[0]] * free > total:
        i = left.pop(0)
        out[i], total, free = bins - free, total - sizes[i], free - 1
    if not left:
        return out
    rest = [sizes[i] for i in left]
    low, high = -(-total // free), -(-total // free) + max(rest)
    best = None
    while low < high:
        mid = (low + high) // 2
        if (found := best_fit_decreasing(rest, mid, free)) is None:
            low = mid + 1
        else:
            best, high = found, mid
    best = best if best is not None and high == low and max(_loads(rest, best, free)) <= low else best_fit_decreasing(rest, low, free)
    while best is None:
        low += max(1, low // 1000)
        best = best_fit_decreasing(rest, low, free)
    for i, b in zip(left, best, strict=True):
        out[i] = bins - free + b
    return out


def _loads(sizes: list[int], of: list[int], bins: int) -> list[int]:
    loads = [0] * bins
    for s, b in zip(sizes, of, strict=True):
        loads[b] += s
    return loads


def shard(docs: DataFrame, shards: int = SHARDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: doc_id, size, text_crc32, law ('bytes'), shard, slot, grown_shard (null).

    size: bytes of the text in UTF-8 (null: none) plus 8. Equal texts, null and empty ones among them, form a group that
    no two shards share. Slots number a shard's rows from 0 without gaps. A group above an even share fills a shard alone.
    An empty table gives no rows; null ids and repeated rows count as rows of their own; other columns are ignored.
    """
    spark = docs.sparkSession
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = materialize(
        docs.select(F.col(id_col).cast("long").alias("id"), (F.octet_length(text) + 8).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("crc"), F.unhex(F.md5(text.cast("binary"))).alias("key"), F.monotonically_increasing_id().alias("row")),
        "sizes",
    ).withColumn("sub", salt("row"))  # by row, as ids may be null or repeated
    subs = rows.groupBy("key", "size", "sub").agg(F.count("*").alias("n"))
    groups = materialize(subs.groupBy("key", "size").agg(F.sum("n").alias("n"), F.sort_array(F.collect_list(F.struct("sub", "n"))).alias("subs")).withColumn("bytes", F.col("size") * F.col("n")), "groups")
    total = groups.agg(F.sum("bytes")).first()[0] or 0
    pallet = max(1, total // (shards * PALLETS))

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # groups come by falling size; pallets stay open over the batches, so one of them at most is less than half full
        packer, tag, rows_in = Packer(pallet), uuid.uuid4().hex, {}
        for batch in batches:
            base, bins = [], packer.add(batch.column("bytes").to_pylist())
            for b, n in zip(bins, batch.column("n").to_pylist(), strict=True):
                base.append(rows_in.get(b, 0))
                rows_in[b] = base[-1] + n
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([f"{tag}-{b}" for b in bins]), pa.array(base, pa.int64())], names=[*batch.schema.names, "pallet", "base"])

    packed = groups.coalesce(PACKERS).sortWithinPartitions(F.desc("bytes"), "key", "size").mapInArrow(fill, "key binary, size long, n long, subs array<struct<sub:int,n:long>>, bytes long, pallet string, base long")
    packed = materialize(packed, "pallets")
    # bounded: all pallets but one of each task are half full at least
    loads = packed.groupBy("pallet").agg(F.sum("bytes").alias("bytes"), F.sum("n").alias("n")).orderBy(F.desc("bytes"), F.desc("n"), "pallet").collect()
    starts, placed = [0] * shards, []
    for load, b in zip(loads, pack_evenly([x["bytes"] for x in loads], shards), strict=True):
        placed.append((load["pallet"], b, starts[b]))
        starts[b] += load["n"]
    where = F.broadcast(spark.createDataFrame(placed, "pallet string, shard int, start long"))
    before = F.sum("part.n").over(Window.partitionBy("key", "size").orderBy("part.sub").rowsBetween(Window.unboundedPreceding, -1))
    spots = (
        packed.join(where, "pallet").select("key", "size", "shard", (F.col("start") + F.col("base")).alias("start"), F.explode("subs").alias("part"))
        .select("key", "size", F.col("part.sub").alias("sub"), "shard", (F.col("start") + F.coalesce(before, F.lit(0))).alias("start"))
    )
    nth = F.row_number().over(Window.partitionBy("key", "size", "sub").orderBy("id", "row")) - 1
    return rows.join(spots, ["key", "size", "sub"]).select(
        F.col("id").alias(id_col), "size", F.col("crc").alias("text_crc32"), F.lit("bytes").alias("law"), "shard", (F.col("start") + nth).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"),
    )


def op2_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard(table(spark, sf_dir, "documents"))
