"""Evidence for code questions: candidates from symbols, lines, files and graph neighbours, and what is said of gaps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quarry.functions import text

#: Lines of a symbol's window, of a file without symbols, and around a line hit.
SYMBOL_LINES, FILE_LINES, RADIUS = 80, 60, 8
#: Most index candidates of a query.
MOST = 24
# File endings of headers and of configuration.
HEADERS = [".h", ".hpp", ".hh", ".hxx"]
CONFIGS = [".cfg", ".ini", ".conf", ".toml", ".yaml", ".yml", ".json"]
# Priorities of related code, confirmed and by name alone.
PRIORITY = {"confirmed callee": 88.0, "confirmed caller": 86.0, "heuristic callee candidate": 64.0, "heuristic caller candidate": 62.0, "confirmed include": 73.0, "confirmed includer": 70.0}


def path_reason(path: str | Column) -> Column:
    """What a path says of a lexical hit: test, header, config or plain."""
    p = F.lower(F.col(path) if isinstance(path, str) else path)
    parts = F.split(p, "/")
    name = F.element_at(parts, -1)
    ending = lambda ends: name.rlike(r".(" + "|".join(e.replace(".", r"\.") for e in ends) + ")$")
    test = F.array_contains(parts, "test") | F.array_contains(parts, "tests") | name.startswith("test") | name.endswith("_test.c")
    return F.when(test, "lexical test candidate").when(ending(HEADERS), "lexical header candidate").when(ending(CONFIGS), "lexical config candidate").otherwise("lexical match")


def symbol_window(line: Column, end: Column) -> Column:
    """(start, end): some lines around a symbol, cut to a window's length."""
    start = F.greatest(F.lit(1), line - 4)
    return F.struct(start.cast("long").alias("start"), F.greatest(start, F.least(end + 4, start + SYMBOL_LINES - 1)).cast("long").alias("end"))


def shrink(start: Column, end: Column, anchor: Column, lines: Column) -> Column:
    """(start, end): a range cut to so many lines around its anchor."""
    n = F.greatest(F.lit(1), lines)
    first = F.greatest(start, anchor - F.floor(n / 2))
    last = F.least(end, first + n - 1)
    return F.struct(F.greatest(start, last - n + 1).cast("long").alias("start"), last.cast("long").alias("end"))


#: Characters of a gram by which terms meet the texts that hold them.
GRAM = 3


def _grams(c: str, n: int) -> Column:
    """Distinct runs of n characters of c, null where it is shorter."""
    return F.when(F.length(c) >= n, F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(c) - n + 1), lambda k: F.substring(F.col(c), k, n))))


def containing(terms: DataFrame, texts: DataFrame) -> DataFrame:
    """(term, text) of distinct terms (term) and distinct texts (text) that hold them, anywhere; the empty term is in each text.

    A term meets texts by the gram of it that the fewest texts hold, so one with a gram that no text has meets none; terms
    shorter than a gram are grams of their own length.
    """
    size = F.least(F.length("term"), F.lit(GRAM))
    grams = lambda c: F.concat(*[F.coalesce(_grams(c, n), F.array().cast("array<string>")) for n in range(1, GRAM + 1)])
    held = texts.select("text", F.explode(grams("text")).alias("gram"))
    df = held.groupBy("gram").agg(F.count("*").alias("df"))
    of = terms.where("term <> ''").select("term", F.explode(F.filter(grams("term"), lambda g: F.length(g) == size)).alias("gram"))
    rarest = of.join(df, "gram", "left").groupBy("term").agg(F.min(F.struct(F.coalesce("df", F.lit(0)).alias("df"), "gram")).alias("g")).where("g.df > 0").select("term", F.col("g.gram").alias("gram"))
    met = rarest.join(held, "gram").where(F.contains("text", F.col("term"))).select("term", "text")
    return met.union(terms.where("term = ''").join(texts.where("text IS NOT NULL"), how="cross").select("term", "text"))


#: Order of symbols that match a question alike.
ALIKE = ["path", "line", "symbol", "end_line"]


def _priority() -> Column:
    return F.lit(64.0) + F.least(F.lit(21.0), F.col("hits") * 3.0) + F.when(F.col("phrase"), 6.0).otherwise(0.0)


def lexical_hits(terms: DataFrame, symbols: DataFrame, most: int | None = None, per: str | None = None) -> DataFrame:
    """(query, symbol columns, hits, phrase): symbols (with column searchable, lower-cased) that contain terms (query, term, phrase).

    Distinct terms meet distinct texts by grams; hits are counted for each text, and symbols with that text share them. With
    most, symbols that cannot be among so many of a query, or of a query and a value of column per, are left out: beyond so
    many of one text, and without per those of a text that so many texts come before.
    """
    keys = [c for c in symbols.columns if c != "searchable"]
    symbols = symbols.dropDuplicates()
    if most is not None:
        same = Window.partitionBy("searchable", *([per] if per else [])).orderBy(*[c for c in ALIKE if c != per])
        symbols = symbols.withColumn("_n", F.row_number().over(same)).where(F.col("_n") <= most).drop("_n")
    texts = symbols.groupBy(F.col("searchable").alias("text")).agg(F.min(F.struct(*[c for c in ALIKE if c in keys])).alias("_first"))
    lowered = terms.withColumn("_t", F.lower("term"))
    met = containing(lowered.select(F.col("_t").alias("term")).where("term IS NOT NULL").distinct(), texts)
    flat = F.trim(F.regexp_replace("text", r"\s+", " "))
    found = lowered.join(met.withColumnRenamed("term", "_t"), "_t").groupBy("query", "text").agg(F.countDistinct("term").alias("hits"), F.collect_set("phrase").alias("_p"))
    scored = found.select("query", "text", "hits", F.exists("_p", lambda p: (p != "") & F.contains(flat, p)).alias("phrase"))
    if most is not None and per is None:
        first = Window.partitionBy("query").orderBy(_priority().desc(), "_first")
        scored = scored.join(texts, "text").withColumn("_n", F.row_number().over(first)).where(F.col("_n") <= most).select("query", "text", "hits", "phrase")
    return symbols.join(scored, F.col("searchable") == F.col("text")).select("query", *keys, "hits", "phrase")


def index_candidates(hits: DataFrame, most: int = MOST) -> DataFrame:
    """(query, path, start, end, symbol, reason, priority) of lexical_hits(), the best of each query."""
    w = Window.partitionBy("query").orderBy(F.desc("priority"), *ALIKE)
    top = hits.withColumn("priority", _priority()).withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= most).withColumn("w", symbol_window(F.col("line"), F.col("end_line")))
    return top.select("query", "path", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "symbol", path_reason("path").alias("reason"), "priority")


def line_candidates(lines: DataFrame) -> DataFrame:
    """(path, line, start, end, reason, priority) of hits (path, line, terms)."""
    line = F.greatest(F.lit(1), F.col("line"))
    return lines.select("path", "line", F.greatest(F.lit(1), line - RADIUS).cast("long").alias("start"), (line + RADIUS).cast("long").alias("end"), path_reason("path").alias("reason"), (F.lit(68.0) + F.least(F.lit(18.0), F.size(F.array_distinct("terms")) * 3.0)).alias("priority"))


def file_candidates(files: DataFrame, hits: DataFrame) -> DataFrame:
    """(query, path, start, end, symbol): of files (query, path) the symbol with the most hits, else the file's head."""
    w = Window.partitionBy("query", "path").orderBy(F.desc("hits"), "line", "symbol", "end_line")
    best = hits.withColumn("_n", F.row_number().over(w)).where("_n = 1").withColumn("w", symbol_window(F.col("line"), F.col("end_line")))
    j = files.join(best.select("query", "path", "symbol", "w"), ["query", "path"], "left")
    return j.select("query", "path", F.coalesce("w.start", F.lit(1)).alias("start"), F.coalesce("w.end", F.lit(FILE_LINES)).alias("end"), F.coalesce("symbol", F.lit("")).alias("symbol"))


def related(seeds: DataFrame, edges: DataFrame) -> DataFrame:
    """(seed, node, reason, priority) of the callers and callees of seeds (seed); edges: src, dst, confidence, resolved.

    Only resolved edges count; without exact or resolved confidence they are by name alone.
    """
    sure = F.col("confidence").isin("exact", "resolved")
    out = seeds.join(edges.where("resolved"), F.col("seed") == F.col("src")).select("seed", F.col("dst").alias("node"), F.when(sure, "confirmed callee").otherwise("heuristic callee candidate").alias("reason"))
    back = seeds.join(edges.where("resolved"), F.col("seed") == F.col("dst")).where("src <> dst").select("seed", F.col("src").alias("node"), F.when(sure, "confirmed caller").otherwise("heuristic caller candidate").alias("reason"))
    table = F.create_map(*[F.lit(x) for kv in PRIORITY.items() for x in kv])
    return out.union(back).distinct().withColumn("priority", F.element_at(table, F.col("reason")))


def gaps(edges: DataFrame, most: int = 64) -> DataFrame:
    """(seed, target, reason): why targets of a seed's edges are no evidence, each once; beyond most rows the last tells how many more."""
    why = F.when(F.col("ambiguity_group").isNotNull(), "ambiguous call target; excluded from confirmed evidence").otherwise("call target unresolved")
    rows = edges.where("NOT resolved").select("seed", F.coalesce("target", F.lit("?")).alias("target"), why.alias("reason")).distinct()
    w = Window.partitionBy("seed")
    n = rows.withColumn("_n", F.row_number().over(w.orderBy("target", "reason"))).withColumn("_all", F.count("*").over(w))
    shown = F.when(F.col("_all") > most, most - 1).otherwise(most)
    rest = n.where(F.col("_all") > most).groupBy("seed").agg(F.max("_all").alias("_all")).select("seed", F.concat((F.col("_all") - (most - 1)).cast("string"), F.lit(" additional uncertainties")).alias("target"), F.lit("uncertainty limit reached; additional unique items omitted").alias("reason"))
    return n.where(F.col("_n") <= shown).select("seed", "target", "reason").union(rest)


def select_scored(scored: DataFrame, threshold: float, short: str = "short", explicit: str = "explicit", pool: int = 100) -> DataFrame:
    """(…, place): by score those over the threshold, in short queries also those named, in others those of lexical score 0.85, pool at most."""
    keep = (F.col("score") >= threshold) | F.when(F.col(short), F.col(explicit)).otherwise(F.col("kw") >= 0.85)
    w = Window.partitionBy("query").orderBy(F.desc("score"), "path", "line", "id")
    return scored.where(keep).withColumn("place", F.row_number().over(w)).where(F.col("place") <= pool)


def capped(items: DataFrame, group: str, order: list, body: str, limit: int) -> DataFrame:
    """(group, kept, dropped, chars): how many items of a response fit a number of characters, in order, and how many do not."""
    w = Window.partitionBy(group).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    r = items.withColumn("_s", F.sum(F.length(body)).over(w))
    fits = F.col("_s") <= limit
    return r.groupBy(group).agg(F.count(F.when(fits, 1)).alias("kept"), F.count(F.when(~fits, 1)).alias("dropped"), F.coalesce(F.max(F.when(fits, F.col("_s"))), F.lit(0)).alias("chars"))


def question_terms(questions: DataFrame) -> DataFrame:
    """(query, term, phrase): the keywords of questions, and their words as one phrase."""
    phrase = F.trim(F.regexp_replace(F.lower("question"), r"\s+", " "))
    return questions.select("query", F.explode(text.keywords("question")).alias("term"), phrase.alias("phrase"))
