"""Checks and updates of stored records: gates, coverage, tilings, catalogue deltas, closures and scores of answers."""

from __future__ import annotations

from itertools import count

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quarry.operators import scans
from quarry.plans.reuse import reuse


def coverage(rows: DataFrame, group: str, present: Column) -> DataFrame:
    """(group, eligible, present, percent): percent in whole numbers, rounded down."""
    a = rows.groupBy(group).agg(F.count("*").alias("eligible"), F.count(F.when(present, 1)).alias("present"))
    return a.withColumn("percent", F.floor(F.col("present") * 100 / F.col("eligible")).cast("long"))


def regressions(baseline: DataFrame, now: DataFrame, family: str, metric: str, tolerance: float) -> DataFrame:
    """(family, before, after) of families that are gone, or whose metric fell by more than the tolerance."""
    j = baseline.select(family, F.col(metric).alias("before")).join(now.select(family, F.col(metric).alias("after")), family, "left")
    return j.where(F.col("after").isNull() | (F.col("before") - F.col("after") > tolerance))


def tiles(parts: DataFrame, key: str, start: str, end: str) -> DataFrame:
    """(key, parts, whole): whether a key's ranges follow each other from 1 without gaps."""
    w = Window.partitionBy(key).orderBy(start)
    ok = F.col(start) == F.coalesce(F.lag(end).over(w) + 1, F.lit(1))
    return parts.withColumn("_ok", ok).groupBy(key).agg(F.count("*").alias("parts"), F.bool_and("_ok").alias("whole"))


def catalog_delta(old: DataFrame, new: DataFrame, name: str, member: str) -> DataFrame:
    """Names whose sets of members differ, by a symmetric difference of the distinct pairs."""
    a, b = old.select(name, member).distinct(), new.select(name, member).distinct()
    return a.exceptAll(b).union(b.exceptAll(a)).select(name).distinct()


def closure(edges: DataFrame, start: DataFrame) -> DataFrame:
    """(seed, node, depth): all that start (seed, node) reaches over edges (a, b), by least depth; rounds go on until nothing is new."""
    seen = reuse(start.select("seed", "node", F.lit(0).alias("depth")))
    front = seen
    for depth in count(1):
        step = front.join(edges, front["node"] == edges["a"]).select("seed", F.col("b").alias("node")).distinct().join(seen, ["seed", "node"], "left_anti").withColumn("depth", F.lit(depth))
        front = reuse(step)
        if front.isEmpty():
            break
        seen = reuse(seen.union(front))
    return seen


def answer_quality(has_ref: Column, ref_right: Column, keywords: Column, top: Column) -> Column:
    return F.round(0.25 * has_ref.cast("int") + 0.25 * ref_right.cast("int") + 0.3 * keywords + 0.2 * (top >= 0.3).cast("int"), 6)


def gold_recall(texts: DataFrame, gold: DataFrame, key: str) -> DataFrame:
    """(key, gold, found, recall): share of gold strings (key, gold) within the key's text; 1.0 without any."""
    hit = texts.join(gold, key, "left").groupBy(key).agg(F.count("gold").alias("gold"), F.count(F.when(F.contains("text", "gold"), 1)).alias("found"))
    return hit.withColumn("recall", F.round(F.when(F.col("gold") == 0, 1.0).otherwise(F.col("found") / F.col("gold")), 6))


def term_hits(lines: DataFrame, terms: list[str], most: int, key: str) -> DataFrame:
    """(key, line_no, terms): lines with the terms they contain, most of them first, at most so many per key."""
    arr = F.array(*[F.lit(x) for x in terms])
    found = F.filter(arr, lambda x: F.contains(F.lower("line"), x))
    w = Window.partitionBy(key).orderBy(F.desc(F.size("found")), "line_no")
    return lines.withColumn("found", found).where(F.size("found") > 0).withColumn("rn", F.row_number().over(w)).where(F.col("rn") <= most).select(key, "line_no", F.array_join("found", ",").alias("terms"))


def ordinals(rows: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """rows with ordinal from 0 within their key."""
    return scans.running(rows, key, order)


def renew(rules: DataFrame, ids: DataFrame, days: int, today: Column) -> DataFrame:
    """rules with those of ids to be reviewed days from today and their hits counted."""
    hit = ids.groupBy("id").agg(F.count("*").alias("_n"))
    return rules.join(hit, "id", "left").withColumn("review_by", F.when(F.col("_n").isNotNull(), F.date_add(today, days)).otherwise(F.col("review_by"))).withColumn("hits", F.col("hits") + F.coalesce("_n", F.lit(0))).drop("_n")
