"""Evidence ranges: merging, file diversity and packing under a budget; intervals and number ranges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quarry.config import DEFAULT
from quarry.operators import scans


def merge_ranges(ranges: DataFrame, key: list[str]) -> DataFrame:
    """(key, start, end, n, priority): overlapping or adjacent integer ranges (start, end, priority) of a key joined.

    With columns symbol, anchor and reason the joined range has those of its range of highest priority, and all reasons once,
    as they come (reasons).
    """
    w = Window.partitionBy(*key).orderBy("start", "end").rowsBetween(Window.unboundedPreceding, -1)
    new = F.when(F.col("start") <= F.max("end").over(w) + 1, 0).otherwise(1)
    marked = ranges.withColumn("_new", new).withColumn("_island", F.sum("_new").over(Window.partitionBy(*key).orderBy("start", "end").rowsBetween(Window.unboundedPreceding, 0)))
    best = F.struct("priority", -F.col("start"), -F.col("end"))
    more = [F.max_by(c, best).alias(c) for c in ("symbol", "anchor") if c in ranges.columns]
    if "reason" in ranges.columns:
        more.append(F.array_distinct(F.transform(F.array_sort(F.collect_list(F.struct("start", "end", "reason"))), lambda x: x["reason"])).alias("reasons"))
    return marked.groupBy(*key, "_island").agg(F.min("start").alias("start"), F.max("end").alias("end"), F.count("*").alias("n"), F.max("priority").alias("priority"), *more).drop("_island")


def diversify(candidates: DataFrame, group: str, path: str = "path", penalty: int = DEFAULT.diversity_penalty) -> DataFrame:
    """candidates with place: the greedy order by priority less penalty for each earlier pick of the same path, in closed form."""
    nth = F.row_number().over(Window.partitionBy(group, path).orderBy(F.desc("priority"), "start", "end"))
    value = candidates.withColumn("value", F.col("priority") - penalty * (nth - 1))
    return value.withColumn("place", F.row_number().over(Window.partitionBy(group).orderBy(F.desc("value"), path, "start", "end")))


def pack(rows: DataFrame, group: str, order: list, size: str, limit: int) -> DataFrame:
    """Rows of each group, in order, while their sizes sum to limit at most."""
    return scans.running(rows, [group], order, size).where(F.col("running") <= limit).drop("ordinal")


def number_ranges(numbers: DataFrame, key: str, value: str) -> DataFrame:
    """(key, ranges): distinct integers as '1-3, 7'."""
    d = numbers.select(key, value).distinct()
    isle = d.withColumn("_g", F.col(value) - F.row_number().over(Window.partitionBy(key).orderBy(value)))
    part = isle.groupBy(key, "_g").agg(F.min(value).alias("a"), F.max(value).alias("b"))
    label = F.when(F.col("a") == F.col("b"), F.col("a").cast("string")).otherwise(F.concat_ws("-", F.col("a").cast("string"), F.col("b").cast("string")))
    return part.groupBy(key).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("a", label.alias("s")))), lambda x: x["s"]), ", ").alias("ranges"))
