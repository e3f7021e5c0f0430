"""Retrieval metrics over ranked lists and graded relevance."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def ranking_metrics(ranked: DataFrame, relevant: DataFrame, k: int) -> DataFrame:
    """(query, recall, rr, ndcg) of ranked (query, id, rank from 1) against relevant (query, id, grade).

    Queries without relevant rows give no row, so means pass over them.
    """
    gain = F.pow(F.lit(2.0), F.col("grade")) - 1
    # relevant rows may be most pairs of queries and documents: they are counted by grade, and only ranked ones are looked at singly
    grades = relevant.groupBy("query", "grade").agg(F.count("*").alias("_n"))
    every = grades.groupBy("query").agg(F.sum("_n").alias("_all"))
    best = grades.withColumn("_before", F.coalesce(F.sum("_n").over(Window.partitionBy("query").orderBy(F.desc("grade")).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).where(F.col("_before") < k)
    places = best.select("query", "grade", F.explode(F.sequence(F.col("_before") + 1, F.least(F.col("_before") + F.col("_n"), F.lit(k)))).alias("ir"))
    ideal = places.groupBy("query").agg(F.sum(gain / F.log2(F.col("ir") + 1)).alias("idcg"))
    met = relevant.join(ranked, ["query", "id"]).groupBy("query").agg(
        F.count(F.when(F.col("rank") <= k, 1)).alias("_hits"), F.min("rank").alias("_first"), F.sum(F.when(F.col("rank") <= k, gain / F.log2(F.col("rank") + 1))).alias("dcg"),
    )
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    got = every.join(met, "query", "left").select("query", (zero(F.col("_hits")) / F.col("_all")).alias("recall"), zero(1 / F.col("_first")).alias("rr"), zero(F.col("dcg")).alias("dcg"))
    return got.join(ideal, "query").select("query", F.round("recall", 6).alias("recall"), F.round("rr", 6).alias("rr"), F.round(F.col("dcg") / F.col("idcg"), 6).alias("ndcg"))


def family_summary(results: DataFrame, family: str, metrics: list[str], hits: list[str] | None = None) -> DataFrame:
    """(family, cases, means of metrics, sums of hits)."""
    return results.groupBy(family).agg(F.count("*").alias("cases"), *[F.round(F.avg(m), 4).alias(m) for m in metrics], *[F.sum(F.col(h).cast("int")).alias(h) for h in hits or []])


def evaluate_lanes(lanes: dict[str, DataFrame], gold_files: DataFrame, gold_symbols: DataFrame, k: int) -> DataFrame:
    """(lane, query, recall, mrr, symbol_recall) of several rankings (query, file, symbol, kind, score, ord) of the same questions."""
    out = None
    for name, ranked in lanes.items():
        places = ranked.withColumn("rank", F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), "ord")))
        f = file_metrics(best_per_file(ranked), gold_files, k).select("query", "recall", "mrr")
        s = symbol_metrics(places, gold_symbols, k).select("query", F.col("recall").alias("symbol_recall"))
        part = f.join(s, "query", "full_outer").withColumn("lane", F.lit(name))
        out = part if out is None else out.unionByName(part)
    return out


def stability(runs: DataFrame, case: str, value: str, limit: float = 0.1) -> DataFrame:
    """Per case the mean, population deviation, least, most and range of repeated runs, and whether they differ too much."""
    a = runs.groupBy(case).agg(F.count("*").alias("runs"), F.round(F.avg(value), 6).alias("mean"), F.round(F.stddev_pop(value), 6).alias("std"), F.min(value).alias("low"), F.max(value).alias("high"))
    return a.withColumn("range", F.round(F.col("high") - F.col("low"), 6)).withColumn("unstable", F.col("std") > limit)


def edge_precision(found: DataFrame, gold: DataFrame) -> DataFrame:
    """One row: precision over found edges, repeats counted, and recall over distinct gold edges (src, dst)."""
    g = gold.distinct()
    right = found.join(g, ["src", "dst"], "left_semi").agg(F.count("*").alias("right"))
    met = g.join(found, ["src", "dst"], "left_semi").agg(F.count("*").alias("met"))
    n, m = found.agg(F.count("*").alias("found")), g.agg(F.count("*").alias("gold"))
    return n.crossJoin(m).crossJoin(right).crossJoin(met).select("found", "gold", F.round(F.col("right") / F.col("found"), 6).alias("precision"), F.round(F.col("met") / F.col("gold"), 6).alias("recall"))


def best_per_file(ranked: DataFrame, file: str = "file", order: str = "ord") -> DataFrame:
    """(query, file, score, rank): files by their best document, the first of equal ones; ranks come before any cut."""
    w = Window.partitionBy("query", file).orderBy(F.desc("score"), order)
    best = ranked.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")
    return best.withColumn("rank", F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), file)))


def file_metrics(files: DataFrame, gold: DataFrame, k: int) -> DataFrame:
    """(query, recall, mrr, hits, misses) of best_per_file() against gold (query, file)."""
    j = gold.join(files.where(F.col("rank") <= k).select("query", "file", "rank"), ["query", "file"], "left")
    found = F.col("rank").isNotNull()
    names = lambda c: F.array_join(F.array_sort(F.collect_list(F.when(c, F.col("file")))), ",")
    return j.groupBy("query").agg(F.round(F.count("rank") / F.count("*"), 6).alias("recall"), F.round(F.coalesce(1 / F.min("rank"), F.lit(0.0)), 6).alias("mrr"), names(found).alias("hits"), names(~found).alias("misses"))


def symbol_metrics(ranked: DataFrame, gold: DataFrame, k: int) -> DataFrame:
    """(query, recall, found, missing, kinds) of ranked (query, symbol, kind, rank) against gold (query, symbol)."""
    top = ranked.where(F.col("rank") <= k).join(gold.distinct(), ["query", "symbol"], "left_semi")
    kinds = top.groupBy("query", "kind").agg(F.count("*").alias("n")).groupBy("query").agg(F.array_join(F.array_sort(F.collect_list(F.concat_ws(":", "kind", F.col("n").cast("string")))), ",").alias("kinds"))
    j = gold.distinct().join(top.select("query", "symbol", F.lit(True).alias("hit")).distinct(), ["query", "symbol"], "left")
    names = lambda c: F.array_join(F.array_sort(F.collect_list(F.when(c, F.col("symbol")))), ",")
    a = j.groupBy("query").agg(F.round(F.count("hit") / F.count("*"), 6).alias("recall"), names(F.col("hit").isNotNull()).alias("found"), names(F.col("hit").isNull()).alias("missing"))
    return a.join(kinds, "query", "left").withColumn("kinds", F.coalesce("kinds", F.lit("")))


def macro(results: DataFrame, metrics: list[str], tags: str | None = None) -> DataFrame:
    """Means over queries: one row, or one for each tag of an array of them."""
    rows = results if tags is None else results.select(F.explode(tags).alias("tag"), *metrics)
    means = [F.count("*").alias("cases"), *[F.round(F.avg(m), 6).alias(m) for m in metrics]]
    return rows.agg(*means) if tags is None else rows.groupBy("tag").agg(*means)


def evidence_correctness(coverage: Column, gold: Column, answer: Column) -> Column:
    """Coverage, or with gold pieces (an array) 0.6 of it and 0.4 of their share that the answer holds, letters of either case."""
    found = F.size(F.filter(gold, lambda g: F.contains(F.lower(answer), F.lower(g)))) / F.size(gold)
    return F.round(F.when(F.size(gold) > 0, 0.6 * coverage + 0.4 * found).otherwise(coverage), 6)


def context_metrics(evidence: DataFrame, budgets: DataFrame, gold: DataFrame) -> DataFrame:
    """(query, used, within, coverage, precision) of evidence (query, path, text) under budgets (query, budget, declared)."""
    e = evidence.groupBy("query").agg(F.sum(F.length("text")).alias("used"), F.countDistinct("path").alias("files"))
    g = gold.select("query", "path").distinct()
    hits = g.join(evidence.select("query", "path").distinct(), ["query", "path"], "left_semi").groupBy("query").agg(F.count("*").alias("hits"))
    n = g.groupBy("query").agg(F.count("*").alias("gold"))
    j = budgets.join(e, "query", "left").join(n, "query", "left").join(hits, "query", "left").fillna(0, ["used", "files", "gold", "hits"])
    share = lambda b, d: F.round(F.when(F.col(b) > 0, F.col("hits") / F.col(b)).otherwise(d), 6)
    return j.select("query", "used", ((F.col("used") <= F.col("budget")) & (F.col("used") == F.coalesce("declared", "used"))).alias("within"), share("gold", 1.0).alias("coverage"), share("files", 0.0).alias("precision"))


def edge_lists(found: DataFrame, gold: DataFrame) -> DataFrame:
    """(kind, src, dst): found edges that are not gold (false), and gold ones that were not found (missing), each once."""
    side = lambda df, n: df.select("src", "dst", F.lit(n).alias("_side"))
    each = side(found, 1).unionByName(side(gold, 2)).groupBy("src", "dst").agg(F.min("_side").alias("_a"), F.max("_side").alias("_b"))
    alone = each.where(F.col("_a") == F.col("_b")).withColumn("kind", F.when(F.col("_a") == 1, "false").otherwise("missing"))
    return alone.select("src", "dst", "kind")


def answer_scores(cases: DataFrame, predictions: DataFrame) -> DataFrame:
    """One row of scores; cases (case, should_refuse, relevant, values), predictions (case, refused, cited, answer_values, cited_values).

    Every case has one prediction and every prediction a case, else it is an error. A refusal of an answerable case scores
    0; an answer counts if what it cites is relevant and bears out its values.
    """
    both = cases.select("case", F.lit(1).alias("c")).join(predictions.groupBy("case").agg(F.count("*").alias("p")), "case", "full_outer")
    wrong = both.where("c IS NULL OR p IS NULL OR p > 1").limit(5).collect()
    if wrong:
        raise ValueError("cases and predictions differ: " + ", ".join(str(r["case"]) for r in wrong))
    j = cases.join(predictions, "case")
    right = (F.size("cited") > 0) & (F.size(F.array_except("cited", "relevant")) == 0) & (F.size(F.array_except("answer_values", "cited_values")) == 0)
    citation = F.when(~F.col("refused"), right.cast("int")).when(~F.col("should_refuse"), 0)
    asked = F.size("values") > 0
    numeric = F.when(asked & ~F.col("refused"), (F.size(F.array_except("values", "answer_values")) == 0).cast("int")).when(asked & ~F.col("should_refuse"), 0)
    share = lambda n, d: F.round(F.try_divide(F.count(F.when(n, 1)), F.count(F.when(d, 1))), 6)
    return j.agg(
        F.round(F.coalesce(F.avg(citation), F.lit(0.0)), 6).alias("citation"), F.round(F.coalesce(F.avg(numeric), F.lit(0.0)), 6).alias("numeric"), F.round(F.avg(F.col("refused").cast("int")), 6).alias("refusal_rate"),
        F.round(F.avg((F.col("refused") == F.col("should_refuse")).cast("int")), 6).alias("refusal_accuracy"), share(F.col("refused") & F.col("should_refuse"), F.col("should_refuse")).alias("refusal_recall"),
        share(F.col("refused") & ~F.col("should_refuse"), ~F.col("should_refuse")).alias("false_refusals"),
    )


def path_cases(paths: DataFrame, true_edges: DataFrame, gold: DataFrame) -> DataFrame:
    """(case, hit, invalid, passed): whether a gold path (case, path) is among paths (case, path), and steps that are no true edges."""
    steps = paths.select("case", F.posexplode("path").alias("k", "a"), "path").withColumn("b", F.get("path", F.col("k") + 1)).where("b IS NOT NULL")
    bad = steps.join(true_edges.select(F.col("src").alias("a"), F.col("dst").alias("b")).distinct(), ["a", "b"], "left_anti").groupBy("case").agg(F.count("*").alias("invalid"))
    hit = gold.join(paths, ["case", "path"], "left_semi").select("case").distinct().withColumn("hit", F.lit(True))
    j = gold.select("case").distinct().join(hit, "case", "left").join(bad, "case", "left")
    return j.select("case", F.coalesce("hit", F.lit(False)).alias("hit"), F.coalesce("invalid", F.lit(0)).alias("invalid"), (F.coalesce("hit", F.lit(False)) & (F.coalesce("invalid", F.lit(0)) == 0)).alias("passed"))


def graph_checks(checks: DataFrame, edges: DataFrame) -> DataFrame:
    """(check, passed) of checks (check, kind, src, target) over edges (src, dst, target, ambiguity_group, resolved).

    resolved: an edge to the target is; unresolved: one that names it is not; ambiguous: two or more of one group name it;
    no_resolved_calls: none of the source's is.
    """
    j = checks.withColumnRenamed("target", "wanted").join(edges, "src", "left")
    names = (F.col("target") == F.col("wanted")) & ~F.col("resolved")
    n = lambda c: F.count(F.when(c, 1))
    a = j.groupBy("check", "kind").agg(
        n(F.col("resolved") & (F.col("dst").cast("string") == F.col("wanted"))).alias("r"), n(names).alias("u"), n(names & F.col("ambiguity_group").isNotNull()).alias("m"),
        F.countDistinct(F.when(names, F.col("ambiguity_group"))).alias("g"), n(F.col("resolved")).alias("c"),
    )
    ok = F.when(F.col("kind") == "resolved", F.col("r") > 0).when(F.col("kind") == "unresolved", F.col("u") > 0).when(F.col("kind") == "ambiguous", (F.col("m") >= 2) & (F.col("g") == 1)).when(F.col("kind") == "no_resolved_calls", F.col("c") == 0).otherwise(False)
    return a.select("check", ok.alias("passed"))


def layered(retrieval: Column, evidence: Column, answer: Column) -> Column:
    return F.round(0.3 * retrieval + 0.3 * evidence + 0.4 * answer, 6)


def code_hit(file_hit: Column, symbol_hit: Column, line_distance: Column, near: int = 10) -> Column:
    """0.4 for the file, 0.4 for the symbol in it, 0.2 for a line near enough."""
    return F.round(F.when(file_hit, 0.4 + F.when(symbol_hit, 0.4).otherwise(0.0) + F.when(line_distance <= near, 0.2).otherwise(0.0)).otherwise(0.0), 6)


def question_rows(facts: DataFrame) -> DataFrame:
    """(fact, kind, question): each fact (fact, name, value, note) as the questions that ask for it."""
    q = F.array(
        F.struct(F.lit("value").alias("kind"), F.concat(F.lit("what is "), "name").alias("question")), F.struct(F.lit("reverse").alias("kind"), F.concat(F.lit("what has "), F.col("value").cast("string")).alias("question")),
        F.struct(F.lit("limit").alias("kind"), F.concat(F.lit("the limit of "), "name").alias("question")), F.struct(F.when(F.col("note").isNotNull(), "note").alias("kind"), F.concat(F.lit("why "), "note").alias("question")),
    )
    return facts.select("fact", F.inline(F.filter(q, lambda x: x["kind"].isNotNull())))


def side_by_side(left: DataFrame, right: DataFrame, keys: list[str], fields: list[str]) -> DataFrame:
    """(keys, fields of both, same): two runs over the same questions."""
    a = left.select(*keys, *[F.col(c).alias(f"a_{c}") for c in fields])
    b = right.select(*keys, *[F.col(c).alias(f"b_{c}") for c in fields])
    same = F.lit(True)
    for c in fields:
        same = same & F.col(f"a_{c}").eqNullSafe(F.col(f"b_{c}"))
    return a.join(b, keys, "full_outer").withColumn("same", same)


def total_order(ranked: DataFrame) -> DataFrame:
    """ranked (query, score, repo, path, line, doc) with place: by score, ties by place in the corpus, so runs agree."""
    return ranked.withColumn("place", F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), "repo", "path", "line", "doc")))
