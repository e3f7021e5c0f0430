"""Source files made from documents: the driver's tables hold no code, so each document becomes a small file.

A file defines up to three functions, named by the document's first words, that call functions named by its next words;
the third one calls the first. Documents in English become Python, the others JavaScript.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.functions import text
from quarry.plans.registry import t

#: Words of a file, of the document's first FIRST ones; lines of a function.
WORDS, FIRST, LINES = 9, 40, 6


def _word(k: Column | int) -> Column:
    return F.get("w", F.lit(k) if isinstance(k, int) else k)


def _function(k: Column) -> Column:
    """The LINES lines of a document's function k, from 0."""
    python = F.col("python")
    name, then = F.concat(F.lit("f_"), F.get("w", k)), F.concat(F.lit("f_"), F.get("w", F.when(k == 2, 0).otherwise(k + 3)))
    last = F.concat(F.lit("f_"), F.get("w", k + 6))
    call = F.when(then.isNull(), "a").otherwise(F.concat(then, F.lit("(a)")))
    result = F.when(last.isNull(), "b").otherwise(F.concat(F.lit("a."), last, F.lit("(b)")))
    about = F.concat(F.get("w", k), F.lit(" of "), F.coalesce("source", F.lit("")))
    py = F.concat(F.lit("def "), name, F.lit('(a):\n    """'), about, F.lit('"""\n    b = '), call, F.lit("\n    return "), result, F.lit("\n\n\n"))
    js = F.concat(F.lit("function "), name, F.lit("(a) {\n  const b = "), call, F.lit(";\n  return "), result, F.lit(";\n}\n\n\n"))
    return F.when(python, py).otherwise(js)


def files(spark: SparkSession, d: str, order: Column | None = None) -> DataFrame:
    """(path, content, doc_id) of all documents; order: where true, the words are taken from behind."""
    words = F.slice(F.array_distinct(F.slice(text.all_matches(F.lower(F.coalesce("text", F.lit(""))), "[a-z]{4,}"), 1, FIRST)), 1, WORDS)
    docs = t(spark, d, "documents").withColumn("w", words).withColumn("python", F.coalesce(F.col("lang") == "en", F.lit(False)))
    if order is not None:
        docs = docs.withColumn("w", F.when(order, F.reverse("w")).otherwise(F.col("w")))
    some = F.slice(F.sequence(F.lit(0), F.lit(2)), F.lit(1), F.least(F.size("w"), F.lit(3)))
    path = F.concat(F.lit("src/d"), F.col("doc_id").cast("string"), F.when(F.col("python"), ".py").otherwise(".js"))
    return docs.select(path.alias("path"), F.array_join(F.transform(some, _function), "").alias("content"), "doc_id")


def files_sql(order: str = "false") -> str:
    """SQL: d (path, source, python, w), and def (path, k, name) of the functions."""
    return f"""
d0 AS (SELECT doc_id, source, coalesce(lang = 'en', false) AS python, list_filter(regexp_extract_all(lower(coalesce(text, '')), '[a-z]{{4,}}')[1:{FIRST}], lambda x: true) AS f FROM documents),
d AS (SELECT 'src/d' || doc_id || CASE WHEN python THEN '.py' ELSE '.js' END AS path, source, python, CASE WHEN {order} THEN list_reverse(u) ELSE u END AS w FROM (SELECT *, list_filter(f, lambda x, i: list_position(f, x) = i)[1:{WORDS}] AS u FROM d0)),
def AS (SELECT path, source, python, k, 'f_' || w[k + 1] AS name, {LINES} * k + 1 AS line, w FROM d, (SELECT unnest([0, 1, 2]) AS k) WHERE len(w) > k)"""


#: SQL: call (src, callee, path, line, attribute) of files_sql()'s Python functions.
CALLS_SQL = """
call AS (SELECT path || '::' || name AS src, 'f_' || w[CASE k WHEN 2 THEN 1 ELSE k + 4 END] AS callee, path, line + 2 AS line, false AS attribute FROM def WHERE python AND len(w) >= CASE k WHEN 2 THEN 1 ELSE k + 4 END
UNION ALL SELECT path || '::' || name, 'f_' || w[k + 7], path, line + 3, true FROM def WHERE python AND len(w) >= k + 7)"""
#: SQL: the rows of graph.resolve_placed().
RESOLVED_SQL = """
own AS (SELECT name, path, count(*) AS n, min(path || '::' || name) AS dst FROM def GROUP BY ALL), every AS (SELECT name, sum(n) AS n, min(dst) AS dst FROM own GROUP BY name),
r AS (SELECT src, callee, c.path, c.line, attribute, coalesce(o.n, e.n, 0)::BIGINT AS candidates, coalesce(o.dst, e.dst) AS one FROM call c LEFT JOIN own o ON o.name = callee AND o.path = c.path LEFT JOIN every e ON e.name = callee)
SELECT src, CASE WHEN candidates = 1 THEN one END AS dst, callee, path, line::INT AS line, CASE WHEN candidates = 0 THEN 'unresolved' WHEN candidates > 1 THEN 'ambiguous' WHEN attribute THEN 'heuristic' ELSE 'resolved' END AS confidence, candidates FROM r"""
