"""Helpers that the operators of this subpackage share: shared storage, salting and batching."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from quarry.shipping import ensure_importable

#: Sub-keys that a hot key's rows are dealt over; a key's rows shrink by this factor in any one task.
SALTS = 256
#: Bytes of text that a Python task handles at a time.
CHUNK_BYTES = 1 << 20


def shared_root(spark: SparkSession) -> str:
    """The folder that the driver and all executors share: spark.checkpoint.dir of the session.

    Only where that is unset (a local session, as in tests) an own folder under the system's temporary one is set.
    """
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if root:
        return root
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    set_here = getattr(spark, "_quarry_root", None)
    if set_here is None:
        set_here = spark._quarry_root = "file://" + tempfile.mkdtemp(prefix="quarry-")
    return set_here


def fresh_path(spark: SparkSession, label: str) -> str:
    return f"{shared_root(spark).rstrip('/')}/quarry/{label}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Cut lineage: write df to the shared folder and read it back, so a lost executor costs no recomputation."""
    spark = df.sparkSession
    ensure_importable(spark)
    path = fresh_path(spark, label)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def numbered(df: DataFrame, name: str, label: str) -> DataFrame:
    """df with a number of its own for each row in the column name; written out, so that the numbers are stable."""
    return materialize(df.withColumn(name, F.monotonically_increasing_id()), label)


@contextmanager
def settings(spark: SparkSession, values: dict[str, str]) -> Iterator[None]:
    """Session settings that hold for what runs inside."""
    before = {k: spark.conf.get(k, None) for k in values}
    for k, v in values.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            if v is None:
                spark.conf.unset(k)
            else:
                spark.conf.set(k, v)


def salt(key: str | Column, n: int = SALTS) -> Column:
    """A sub-key from 0 to n - 1 that depends on the value alone."""
    return F.pmod(F.xxhash64(key), F.lit(n)).cast("int")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ensure_importable(spark)
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def text_chunks(texts: list, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges [i, j) of texts with about limit characters each; a longer text is a range of its own."""
    i = size = 0
    for j, t in enumerate(texts):
        n = len(t) if t else 0
        if j > i and size + n > limit:
            yield i, j
            i, size = j, 0
        size += n
    if i < len(texts):
        yield i, len(texts)


def map_rows(df: DataFrame, f: Callable[..., Iterable[dict]], schema: str, *args) -> DataFrame:
    """mapInArrow over bounded slices: f(columns as lists by name, *args) yields dicts of columns.

    The slices hold about CHUNK_BYTES of the column named text (or html), so memory does not follow the batch.
    """
    ensure_importable(df.sparkSession)
    target = _arrow_schema(df.sparkSession, schema)
    names = df.columns
    heavy = next((c for c in ("text", "html") if c in names), None)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cols = {c: batch.column(k).to_pylist() for k, c in enumerate(names)}
            spans = text_chunks(cols[heavy]) if heavy else [(0, batch.num_rows)]
            for i, j in spans:
                if i == j:
                    continue
                for out in f({c: v[i:j] for c, v in cols.items()}, *args):
                    yield to_batch(out, target)

    return df.mapInArrow(run, schema)


def annotate(docs: DataFrame, f: Callable[..., Iterable[dict]], schema: str, *args, text_col: str = "text") -> DataFrame:
    """docs with the columns of schema, which f({"text": texts}, *args) yields for slices of about CHUNK_BYTES of texts.

    The columns of docs get the names _c0, _c1, ... in their order, so that none of them can clash; plain() gives the names
    back. Columns other than the text stay Arrow data.
    """
    ensure_importable(docs.sparkSession)
    target, at = _arrow_schema(docs.sparkSession, schema), docs.columns.index(text_col)
    renamed = docs.toDF(*[f"_c{k}" for k in range(len(docs.columns))])
    kept = renamed.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(at).to_pylist()
            for i, j in text_chunks(texts):
                for out in f({"text": texts[i:j]}, *args):
                    yield pa.RecordBatch.from_arrays([*batch.slice(i, j - i).columns, *(_array(out[x.name], x.type) for x in target)], names=[*kept, *target.names])

    return renamed.mapInArrow(run, StructType([*renamed.schema.fields, *_parsed(docs.sparkSession, schema).fields]))


def plain(rows: DataFrame, docs: DataFrame) -> DataFrame:
    """The columns that rows has from docs by annotate(), under their own names."""
    return rows.select(*[F.col(f"_c{k}").alias(c) for k, c in enumerate(docs.columns)])


def annotated(docs: DataFrame, column: str) -> Column:
    """The column of docs among those of annotate()."""
    return F.col(f"_c{docs.columns.index(column)}")


def spread(rows: DataFrame, keys: list[str], sub: str, **aggregates: tuple[Callable, str | Column]) -> DataFrame:
    """Aggregates (F.min, F.max or F.sum, and a column) by keys, repeated for each sub-key that the key's rows have.

    Rows join it by the keys and sub, so a hot key's rows are dealt over its sub-keys both here and in the join.
    """
    subs = rows.groupBy(*keys, sub).agg(*[f(c).alias(name) for name, (f, c) in aggregates.items()])
    whole = subs.groupBy(*keys).agg(*[f(name).alias(name) for name, (f, _) in aggregates.items()], F.collect_list(sub).alias(sub))
    return whole.withColumn(sub, F.explode(sub))


def lowest_hashes(rows: DataFrame, key: str, most: int) -> DataFrame:
    """The rows with the lowest hashes of key, most of them; a cut on the hash first keeps what partitions send small."""
    share = min(1.0, (1.5 * most + 1000) / max(rows.count(), 1))
    h = F.xxhash64(key)
    return rows.where(F.shiftrightunsigned(h, 33) <= int(share * 2**31)).orderBy(F.shiftrightunsigned(h, 33), *rows.columns).limit(most)


def to_batch(out: dict, target: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([_array(out[x.name], x.type) for x in target], schema=target)


def _array(values, kind: pa.DataType) -> pa.Array:
    if isinstance(values, pa.Array):
        return values if values.type == kind else values.cast(kind)
    if hasattr(values, "ndim") and values.ndim == 2:
        flat = pa.array(values.reshape(-1), kind.value_type)
        step = values.shape[1]
        return pa.ListArray.from_arrays(pa.array(range(0, step * len(values) + 1, step), pa.int32()), flat).cast(kind)
    return pa.array(values, kind)


def _arrow_schema(spark: SparkSession, ddl: str) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(_parsed(spark, ddl))


def _parsed(spark: SparkSession, ddl: str) -> StructType:
    return spark.createDataFrame([], ddl).schema
