"""Vector arithmetic on array columns, in double."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    """0 where a norm is 0 or the lengths differ."""
    return F.when((F.size(a) != F.size(b)) | (norm(a) == 0) | (norm(b) == 0), 0.0).otherwise(dot(a, b) / (norm(a) * norm(b)))


def normalize(a: Column) -> Column:
    """a over its norm; zeros where that is 0. The norm stands in an array of its own, so that it is worked out once, not for each place."""
    each = lambda n: F.transform(a, lambda x: F.when(n == 0, 0.0).otherwise(x.cast("double") / n))
    return F.get(F.transform(F.array(norm(a)), each), F.lit(0))


def means(rows: DataFrame, key: str, vec: str) -> DataFrame:
    """(key, i, mean): the mean vector of each key, a row for each place."""
    return rows.select(key, F.posexplode(vec).alias("i", "x")).groupBy(key, "i").agg(F.round(F.avg(F.col("x").cast("double")), 6).alias("mean"))
