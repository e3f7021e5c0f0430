"""Budgets, trimming and run lengths of conversations and event logs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quarry.config import DEFAULT
from quarry.functions import text
from quarry.operators import trimming


def budget(messages: DataFrame, context: int, key: str = "conv_id") -> DataFrame:
    """(key, messages, tool_messages, chars, tokens, used, level) against a context of that many tokens."""
    a = messages.groupBy(key).agg(F.count("*").alias("messages"), F.count(F.when(F.col("role") == "tool", 1)).alias("tool_messages"), F.sum(F.coalesce(F.length("text"), F.lit(0))).cast("long").alias("chars"))
    a = a.withColumn("tokens", text.chars_to_tokens("chars")).withColumn("used", F.round((F.col("tokens") + DEFAULT.reserve_tokens) / context, 6))
    return a.withColumn("level", F.when(F.col("used") >= DEFAULT.hard_limit, "hard").when(F.col("used") >= DEFAULT.soft_limit, "soft").otherwise("ok"))


def trim(messages: DataFrame, role: str, recent: int = DEFAULT.recent_tool_outputs, chars: int = 200, key: str = "conv_id", order: str = "turn") -> DataFrame:
    """messages with trimmed: of the role's messages all but the recent ones are cut to so many characters and marked."""
    w = Window.partitionBy(key, "role").orderBy(F.desc(order))
    age = F.row_number().over(w)
    old = (F.col("role") == role) & (F.col("age") > recent) & (F.length("text") > chars)
    return messages.withColumn("age", age).withColumn("trimmed", F.when(old, F.concat(F.left("text", F.lit(chars)), F.lit("…"))).otherwise(F.col("text")))


def last_of_role(messages: DataFrame, role: str, key: str = "conv_id", order: str = "turn") -> DataFrame:
    """messages with the order of the latest earlier message of the role: who a later message answers."""
    w = Window.partitionBy(key).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    return messages.withColumn("answers", F.last(F.when(F.col("role") == role, F.col(order)), ignorenulls=True).over(w))


def run_lengths(events: DataFrame, key: list[str], value: Column, order: list[str]) -> DataFrame:
    """events with run_length: how often in a row the key has shown the same value, from 1."""
    w = Window.partitionBy(*key).orderBy(*order)
    new = F.when(F.col("_v").eqNullSafe(F.lag("_v").over(w)), 0).otherwise(1)
    runs = events.withColumn("_v", value).withColumn("_new", new).withColumn("_run", F.sum("_new").over(w))
    return runs.withColumn("run_length", F.row_number().over(Window.partitionBy(*key, "_run").orderBy(*order))).drop("_v", "_new", "_run")


def truncate_keep_errors(c: str | Column, limit: int, errors: int = 5) -> Column:
    """Head of 30 %, tail of 70 % of limit, by whole lines, and the first error lines of what lies between."""
    t = F.col(c) if isinstance(c, str) else c
    head = int(limit * 0.3)
    return F.when(F.length(t) <= limit, t).otherwise(trimming.cut_between(t, head, limit - head, errors, "[... cut ...]"))


def fit_budget(messages: DataFrame, budget: int, recent: int = DEFAULT.recent_tool_outputs, key: str = "conv_id", order: str = "turn") -> DataFrame:
    """messages (conv_id, turn, role, text) with fitted: under a budget of characters for each conversation.

    Outputs of tools before the recent ones become summaries. If a conversation is still too long, its longest messages are
    cut to one common length, the largest that fits; the others stay whole.
    """
    age = F.row_number().over(Window.partitionBy(key, "role").orderBy(F.desc(order)))
    old = (F.col("role") == "tool") & (F.col("_age") > recent)
    m = messages.withColumn("_age", age).withColumn("_s", F.when(old, trimming.summary(F.col("text"))).otherwise(F.coalesce("text", F.lit("")))).withColumn("_n", F.length("_s"))
    by = Window.partitionBy(key).orderBy("_n", order)
    before = F.coalesce(F.sum("_n").over(by.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    left = F.count("*").over(Window.partitionBy(key)) - F.row_number().over(by) + 1
    level = F.floor((F.lit(budget) - before) / left)
    m = m.withColumn("_level", F.greatest(level, F.lit(0))).withColumn("_cap", F.min(F.when(F.col("_n") > F.col("_level"), F.struct("_n", order, "_level"))).over(Window.partitionBy(key)))
    return m.withColumn("fitted", F.when(F.col("_cap").isNull(), F.col("_s")).otherwise(F.left("_s", F.col("_cap._level").cast("int")))).drop("_age", "_s", "_n", "_level", "_cap")


def rate(rows: DataFrame, ratings: DataFrame) -> DataFrame:
    """rows (index, rating, …) with ratings (index, rating) of 1, 0 or -1 put in; others and unknown places are errors."""
    wrong = ratings.where(~F.col("rating").isin(1, 0, -1)).select("index").union(ratings.join(rows.select("index"), "index", "left_anti").select("index")).limit(5).collect()
    if wrong:
        raise ValueError("cannot rate " + ", ".join(str(r["index"]) for r in wrong))
    new = ratings.groupBy("index").agg(F.last("rating").alias("_r"))
    return rows.join(new, "index", "left").withColumn("rating", F.coalesce("_r", "rating")).drop("_r")


def formatted_context(refs: Column, snippets: Column, most: int = 5, chars: int = 500) -> Column:
    """References (source, content) and snippets as one text, the first few of each."""
    r = F.transform(F.slice(refs, 1, most), lambda x: F.concat(F.lit("["), x["source"], F.lit("] "), F.left(x["content"], F.lit(chars))))
    return F.array_join(F.concat(r, F.slice(snippets, 1, most)), "\n")


def enforce(usage: DataFrame) -> None:
    """An error if a conversation of budget() is over the hard limit."""
    over = usage.where("level = 'hard'").limit(5).collect()
    if over:
        raise ValueError("over the hard limit: " + ", ".join(str(r[0]) for r in over))


def last_metrics(parts: DataFrame, key: str, order: str) -> DataFrame:
    """(key, metrics) of streamed parts: those of the last part that has any."""
    return parts.where("metrics IS NOT NULL").groupBy(key).agg(F.max_by("metrics", order).alias("metrics"))


def interaction_stats(rows: DataFrame) -> DataFrame:
    """One row: total, rated, unrated, and counts of ratings 1, 0 and -1."""
    n = lambda c: F.count(F.when(c, 1))
    r = F.col("rating")
    return rows.agg(F.count("*").alias("total"), n(r.isNotNull()).alias("rated"), n(r.isNull()).alias("unrated"), n(r == 1).alias("good"), n(r == 0).alias("neutral"), n(r == -1).alias("bad"))


def training_rows(rows: DataFrame, least: int = 1) -> DataFrame:
    """(instruction, input, output) of interactions rated least or better."""
    return rows.where(F.col("rating") >= least).select(F.col("question").alias("instruction"), F.lit("").alias("input"), F.col("answer").alias("output"))
