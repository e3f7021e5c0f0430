"""Rules that a user approved: adding, renewing, counting and showing them; every change gives the whole new table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quarry.operators.store import rule_problem

REVIEW_DAYS = 90


def in_scope(project: str | Column | None) -> Column:
    """Global rules, and those of the project."""
    own = F.lit(None).cast("string") if project is None else F.lit(project) if isinstance(project, str) else project
    return (F.col("scope") == "global") | F.coalesce(F.col("project") == own, F.lit(False))


def expired(rules: DataFrame, project: str | Column | None, today: Column) -> DataFrame:
    """Rules in scope whose review is overdue."""
    return rules.where(in_scope(project) & (F.col("review_by") < today))


def next_number(rules: DataFrame, counter: int = 1) -> DataFrame:
    """One row: the number of the next rule; the counter keeps numbers of deleted rules from coming back."""
    highest = F.max(F.substring("id", 3, 20).cast("int"))
    return rules.agg(F.greatest(F.coalesce(highest, F.lit(0)) + 1, F.lit(counter)).alias("number"))


def propose(rules: DataFrame, wanted: DataFrame, today: Column, counter: int = 1, days: int = REVIEW_DAYS) -> DataFrame:
    """(rule, scope, project, id, outcome) of wanted (ord, rule, scope, project): refused, a duplicate's id, or a new one.

    A rule is the same if text, scope and project are; of several equal wanted ones the first is added.
    """
    w = wanted.withColumn("rule", F.trim("rule")).withColumn("project", F.when(F.col("scope") == "project", F.col("project")))
    problem = F.when(~F.coalesce(F.col("scope").isin("project", "global"), F.lit(False)), "scope").when((F.col("scope") == "project") & F.coalesce(~F.col("project").startswith("/"), F.lit(True)), "root").otherwise(rule_problem("rule"))
    w = w.withColumn("problem", problem)
    same = [F.col("w.rule") == F.col("r.rule"), F.col("w.scope") == F.col("r.scope"), F.col("w.project").eqNullSafe(F.col("r.project"))]
    known = w.alias("w").join(rules.select("id", "rule", "scope", "project").alias("r"), same, "left").select("w.*", "r.id")
    first = F.row_number().over(Window.partitionBy("rule", "scope", "project").orderBy("ord"))
    known = known.withColumn("_first", first)
    fresh = (F.col("problem") == "") & F.col("id").isNull()
    start = next_number(rules, counter)
    numbered = known.crossJoin(F.broadcast(start)).withColumn("_k", F.sum((fresh & (F.col("_first") == 1)).cast("int")).over(Window.orderBy("ord")))  # proposals of one call
    of_first = F.first(F.when(fresh & (F.col("_first") == 1), F.col("number") + F.col("_k") - 1), ignorenulls=True).over(Window.partitionBy("rule", "scope", "project"))
    new_id = F.concat(F.lit("L-"), F.lpad(of_first.cast("string"), 3, "0"))
    outcome = F.when(F.col("problem") != "", F.concat(F.lit("refused: "), "problem")).when(F.col("id").isNotNull() | (F.col("_first") > 1), "duplicate").otherwise("added")
    return numbered.select("ord", "rule", "scope", "project", F.when(F.col("problem") != "", None).otherwise(F.coalesce("id", new_id)).alias("id"), outcome.alias("outcome"), F.when(outcome == "added", F.date_add(today, days)).alias("review_by"))


def delete(rules: DataFrame, ids: DataFrame) -> DataFrame:
    """rules without those of ids (id); an unknown id is an error."""
    unknown = ids.join(rules.select("id"), "id", "left_anti").limit(5).collect()
    if unknown:
        raise KeyError(", ".join(str(r["id"]) for r in unknown))
    return rules.join(ids.select("id").distinct(), "id", "left_anti")


def hit(rules: DataFrame, ids: DataFrame, now: Column) -> DataFrame:
    """rules with hits counted and the time of the last one."""
    n = ids.groupBy("id").agg(F.count("*").alias("_n"))
    return rules.join(n, "id", "left").withColumn("hits", F.col("hits") + F.coalesce("_n", F.lit(0))).withColumn("last_triggered", F.when(F.col("_n").isNotNull(), now).otherwise(F.col("last_triggered"))).drop("_n")


def citations(c: str | Column) -> Column:
    """Ids of rules that a text cites, each once, in order."""
    return F.array_distinct(F.regexp_extract_all(F.col(c) if isinstance(c, str) else c, F.lit(r"\[(L-\d{3,})\]"), F.lit(1)))


def shown(rules: DataFrame, key: str) -> DataFrame:
    """(key, markdown): active rules as a list for a model."""
    line = F.concat(F.lit("- ["), "id", F.lit("] "), "rule")
    return rules.groupBy(key).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("id", line.alias("s")))), lambda x: x["s"]), "\n").alias("markdown"))
