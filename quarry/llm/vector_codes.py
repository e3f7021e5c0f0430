"""Vector codes: each part of a vector becomes the index of the nearest entry of that part's codebook.

All numbers are integers. A round broadcasts a kd-tree per codebook; tasks look up the nearest entries of their rows by
branch and bound, visiting nodes whose bound equals the best distance so far too, so that of entries at the same distance
the one with the lower index wins. Tasks send sums and counts per entry, which Spark adds up; nothing else leaves a task.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm.common import SALTS, materialize, spread, table

#: Vectors are cut into PARTS parts, codebooks have ENTRIES entries and are moved ROUNDS times.
PARTS, ENTRIES, ROUNDS = 16, 64, 2
#: A component is the integer below SCALE times its value.
SCALE = 256
#: Entries in a leaf of a tree.
LEAF = 8
#: The largest long. Larger errors count as this one.
LARGEST = (1 << 63) - 1


class Tree:
    """kd-tree over the rows of entries; the boxes of nodes are tight."""

    def __init__(self, entries: np.ndarray, members: np.ndarray | None = None) -> None:
        self.members = np.arange(len(entries)) if members is None else members  # ascending
        own = entries[self.members]
        self.low, self.high, self.children, self.own = own.min(0), own.max(0), (), own
        spans = self.high - self.low
        axis = int(np.argmax(spans)) if len(spans) else 0
        if len(own) > LEAF and spans[axis] > 0:
            order = np.sort(own[:, axis])
            cut = order[(len(own) - 1) // 2]
            cut = cut if cut < order[-1] else order[np.searchsorted(order, cut) - 1]  # both sides hold entries
            left = own[:, axis] <= cut
            self.children = (Tree(entries, self.members[left]), Tree(entries, self.members[~left]))

    def bound(self, points: np.ndarray) -> np.ndarray:
        """Squared distances of points from the node's box."""
        gap = np.maximum(np.maximum(self.low - points, points - self.high), 0)
        return (gap * gap).sum(1)

    def nearest(self, points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Index and squared distance of each point's nearest entry; of equally near ones, the lowest index."""
        found = np.full(len(points), -1, np.int64)
        best = np.zeros(len(points), points.dtype)
        self._visit(points, np.arange(len(points)), found, best)
        return found, best

    def _visit(self, points: np.ndarray, at: np.ndarray, found: np.ndarray, best: np.ndarray) -> None:
        if not len(at):
            return
        if not self.children:
            gap = points[at][:, None, :] - self.own[None]
            distance = (gap * gap).sum(2)
            nearest = np.argmin(distance, 1)  # the first, so the lowest index of the leaf
            distance, index = distance[np.arange(len(at)), nearest], self.members[nearest]
            better = (found[at] < 0) | (distance < best[at]) | ((distance == best[at]) & (index < found[at]))
            found[at[better]], best[at[better]] = index[better], distance[better]
            return
        left, right = self.children
        bounds = left.bound(points[at]), right.bound(points[at])
        first = bounds[0] <= bounds[1]
        left._visit(points, at[first], found, best)
        right._visit(points, at[~first], found, best)
        for child, side, bound in ((right, first, bounds[1]), (left, ~first, bounds[0])):
            open_ = side & (bound <= best[at])  # a bound that equals the best distance may hide a lower index
            child._visit(points, at[open_], found, best)


class Codebooks:
    """The entries of all parts, and a tree for each."""

    def __init__(self, entries: list[list[list[int]]]) -> None:
        self.entries = entries
        self.width = len(entries[0][0])
        self.most = max((abs(x) for part in entries for e in part for x in e), default=0)
        self._trees: dict[type, list[Tree]] = {}
        self.trees(np.int64)

    def trees(self, kind: type) -> list[Tree]:
        if kind not in self._trees:
            self._trees[kind] = [Tree(np.array(part, kind)) for part in self.entries]
        return self._trees[kind]

    def kind(self, rows: np.ndarray) -> type:
        """int64 where no squared distance can leave it; Python's integers otherwise."""
        most = max(self.most, int(rows.max(initial=0)), -int(rows.min(initial=0)))
        return np.int64 if (2 * most) ** 2 * len(self.entries) * self.width < LARGEST else object

    def assign(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For rows of components: indices (row, part) and the sum of squared distances of each row."""
        kind = self.kind(rows)
        rows, errors = rows.astype(kind), np.zeros(len(rows), kind)
        codes = np.empty((len(rows), len(self.entries)), np.int64)
        for p, tree in enumerate(self.trees(kind)):
            codes[:, p], distance = tree.nearest(rows[:, p * self.width : (p + 1) * self.width])
            errors = errors + distance
        return codes, errors

    def moved(self, sums: dict[tuple[int, int, int], tuple[int, int]]) -> Codebooks:
        """Entries replaced by the floors of sum / count, given as (part, entry, position): (sum, count)."""
        out = [[list(e) for e in part] for part in self.entries]
        for (p, e, i), (total, n) in sums.items():
            out[p][e][i] = total // n
        return Codebooks(out)

    def digest(self) -> str:
        text = ",".join(str(x) for part in self.entries for e in part for x in e)
        return hashlib.sha256(text.encode()).hexdigest()


def components(vector: str | Column) -> Column:
    """floor(SCALE * x) of each component as longs; beyond the range of longs, the nearest long."""
    return F.transform(vector, lambda x: F.floor(x.cast("double") * F.lit(float(SCALE))).cast("long"))


def usable(vector: str | Column) -> Column:
    """True where the vector is not null and all its components are finite numbers."""
    v = F.col(vector) if isinstance(vector, str) else vector
    return v.isNotNull() & F.coalesce(F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < float("inf"))), F.lit(False))


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), width)


def _sums(rows: DataFrame, books: Codebooks, parts: int) -> Codebooks:
    """The codebooks after one round over all rows."""
    shared, width = rows.sparkSession.sparkContext.broadcast(books), books.width
    schema = pa.schema([("part", pa.int32()), ("entry", pa.int32()), ("position", pa.int32()), ("total", pa.decimal128(38, 0)), ("n", pa.int64())])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        books, sizes = shared.value, (parts, len(shared.value.entries[0]))
        counts, totals = np.zeros(sizes, np.int64), np.zeros((*sizes, width), object)
        for batch in batches:
            v = _matrix(batch.column("v"), parts * width)
            if not len(v):
                continue
            codes, _ = books.assign(v)
            safe = np.int64 if max(int(v.max()), -int(v.min())) * len(v) < LARGEST else object
            for p in range(parts):
                own = np.zeros((sizes[1], width), safe)
                np.add.at(own, codes[:, p], v[:, p * width : (p + 1) * width].astype(safe))
                totals[p] += own.astype(object)
                counts[p] += np.bincount(codes[:, p], minlength=sizes[1])
        p, e = np.nonzero(counts)
        yield pa.RecordBatch.from_arrays([
            pa.array(np.repeat(p, width), pa.int32()), pa.array(np.repeat(e, width), pa.int32()), pa.array(np.tile(np.arange(width), len(p)), pa.int32()),
            pa.array([Decimal(int(x)) for x in totals[p, e].ravel()], pa.decimal128(38, 0)), pa.array(np.repeat(counts[p, e], width), pa.int64()),
        ], schema=schema)

    sent = rows.select("v").mapInArrow(add, "part int, entry int, position int, total decimal(38, 0), n long")
    found = sent.groupBy("part", "entry", "position").agg(F.sum("total").alias("total"), F.sum("n").alias("n")).collect()  # at most a row per component
    return books.moved({(r["part"], r["entry"], r["position"]): (int(r["total"]), r["n"]) for r in found})


def compress_vectors(
    vectors: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label"
) -> tuple[DataFrame, Codebooks | None]:
    """Codes of vectors (vec_id, label, code, error, label_error, codebooks_sha256), and the codebooks.

    Rows whose vector is null or has null or non-finite components are dropped. Vectors that are shorter than the
    longest, or whose length is no multiple of parts, count as followed by zeros. Codebooks start as the parts of the
    rows with the smallest ids (null ids last; of equal ids, the smaller vector first), and have fewer entries where
    there are fewer rows. Repeated ids and rows are rows of their own. Errors beyond the range of longs count as the
    largest long. Without rows to keep there are no codes, and the codebooks are None. Other columns are ignored.
    """
    if not 0 < entries <= 256:
        raise ValueError("a code has two hex digits a part: 1 to 256 entries")
    kept = vectors.where(usable(vector_col)).select(F.col(id_col).alias("vec_id"), F.col(label_col).alias("label"), components(vector_col).alias("v"))
    longest = kept.agg(F.max(F.size("v"))).first()[0]
    width = max(1, -(-(longest or 0) // parts))
    zeros = F.array_repeat(F.lit(0).cast("long"), F.lit(parts * width) - F.size("v"))
    kept = kept.withColumn("v", F.when(F.size("v") == parts * width, F.col("v")).otherwise(F.concat("v", zeros)))
    # a row's sub-key comes from its place, so equal rows are dealt out too
    rows = materialize(kept.withColumn("sub", F.pmod(F.monotonically_increasing_id(), F.lit(SALTS)).cast("int")), "vectors")
    first = [r["v"] for r in rows.orderBy(F.col("vec_id").asc_nulls_last(), "v").select("v").limit(entries).collect()]
    if not first:
        none = rows.select("vec_id", "label", F.lit("").alias("code"), F.lit(0).cast("long").alias("error"), F.lit(0).cast("long").alias("label_error"))
        return none.withColumn("codebooks_sha256", F.lit("")), None
    books = Codebooks([[v[p * width : (p + 1) * width] for v in first] for p in range(parts)])
    for _ in range(rounds):
        books = _sums(rows, books, parts)
    coded = materialize(_codes(rows, books, parts), "codes")
    key = F.coalesce(F.concat(F.lit("="), F.col("label").cast("string")), F.lit(""))  # nulls together
    coded = coded.withColumn("key", key)
    sums = spread(coded.withColumn("e", F.col("error").cast("decimal(38, 0)")), ["key"], "sub", label_error=(F.sum, "e"))
    sums = sums.withColumn("label_error", F.least("label_error", F.lit(Decimal(LARGEST)).cast("decimal(38, 0)")).cast("long"))
    out = coded.join(sums, ["key", "sub"]).select("vec_id", "label", "code", "error", "label_error", F.lit(books.digest()).alias("codebooks_sha256"))
    return out, books


def _codes(rows: DataFrame, books: Codebooks, parts: int) -> DataFrame:
    """rows with code and error instead of v."""
    shared, width = rows.sparkSession.sparkContext.broadcast(books), books.width
    others = [c for c in rows.columns if c != "v"]

    def look_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            codes, errors = shared.value.assign(_matrix(batch.column("v"), parts * width))
            texts = [row.tobytes().hex() for row in codes.astype(np.uint8)]
            own = [batch.column(c) for c in others]
            yield pa.RecordBatch.from_arrays([*own, pa.array(texts, pa.string()), pa.array([min(int(e), LARGEST) for e in errors], pa.int64())], names=[*others, "code", "error"])

    kinds = ", ".join(f"{c} {rows.schema[c].dataType.simpleString()}" for c in others)
    return rows.mapInArrow(look_up, f"{kinds}, code string, error long")


def op11_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compress_vectors(table(spark, sf_dir, "embeddings"))[0]


def _nearest_sql(books: str) -> str:
    """SQL: the nearest entry of books for each row of parts, as distance * 256 + entry."""
    return f"""SELECT r, p, min(256 * list_sum(list_transform(list_zip(x, c), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) + e) AS near
    FROM parts JOIN {books} USING (p) GROUP BY r, p"""


def _moved_sql(books: str, near: str) -> str:
    """SQL: books after a round with the assignments near."""
    return f"""SELECT b.p, b.e, coalesce(m.c, b.c) AS c FROM {books} b LEFT JOIN (
        SELECT p, e, list((s - ((s % n) + n) % n) // n ORDER BY i) AS c FROM (
            SELECT p, e, i, sum(y) AS s, count(*) AS n FROM (
                SELECT p, near % 256 AS e, unnest(x) AS y, generate_subscripts(x, 1) AS i FROM parts JOIN {near} USING (r, p)) GROUP BY p, e, i)
        GROUP BY p, e) m ON b.p = m.p AND b.e = m.e"""


OP11_SQL = f"""
WITH kept AS (
    SELECT vec_id, label, list_transform(embedding, lambda x: CAST(floor({SCALE} * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
    WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
rows AS (SELECT *, row_number() OVER (ORDER BY vec_id NULLS LAST, v) - 1 AS r, len(v) // {PARTS} AS w FROM kept),
parts AS (SELECT r, p, v[CAST(p * w + 1 AS BIGINT) : CAST(p * w + w AS BIGINT)] AS x FROM rows, range({PARTS}) AS t(p)),
c0 AS (SELECT p, r AS e, x AS c FROM parts WHERE r < {ENTRIES}),
n0 AS ({_nearest_sql("c0")}),
c1 AS ({_moved_sql("c0", "n0")}),
n1 AS ({_nearest_sql("c1")}),
c2 AS ({_moved_sql("c1", "n1")}),
n2 AS ({_nearest_sql("c2")}),
codes AS (SELECT r, string_agg(printf('%02x', CAST(near % 256 AS BIGINT)), '' ORDER BY p) AS code, CAST(sum(near // 256) AS BIGINT) AS error FROM n2 GROUP BY r),
sha AS (SELECT sha256(string_agg(array_to_string(c, ','), ',' ORDER BY p, e)) AS codebooks_sha256 FROM c2)
SELECT vec_id, label, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, codebooks_sha256
FROM rows JOIN codes USING (r), sha
"""
