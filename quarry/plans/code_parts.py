"""Queries of expressions over questions, signatures, sources and small records."""

from __future__ import annotations

from pyspark.sql import functions as F

from quarry import config
from quarry.functions import code
from quarry.operators import payloads, scope
from quarry.plans.catalog import _list
from quarry.plans.registry import query, t
from quarry.sources import readers


@query(f"""
WITH x AS (SELECT conv_id, turn, list_filter(list_transform(regexp_extract_all(text, '[A-Za-z_][A-Za-z0-9_]*|[\\x{{3400}}-\\x{{9fff}}]{{2,}}'), lambda w: lower(w)), lambda w: (regexp_matches(w, '^[\\x{{3400}}-\\x{{9fff}}]') OR length(w) >= 3) AND NOT list_contains({_list(config.CODE_STOPWORDS)}, w)) AS w FROM conversations)
SELECT conv_id, turn, array_to_string(list_filter(w, lambda v, i: list_position(w, v) = i)[1:12], ' ') AS terms FROM x""")
def question_terms(spark, d):
    return t(spark, d, "conversations").select("conv_id", "turn", F.array_join(code.query_terms(F.col("text")), " ").alias("terms"))


@query("""
WITH x AS (SELECT p_partkey, p_name AS a, CASE p_partkey % 4 WHEN 0 THEN '  ' || replace(p_name, ' ', '   ') WHEN 1 THEN replace(p_name, 'e', 'o') WHEN 2 THEN p_name || ' x' ELSE '' END AS b FROM part)
SELECT p_partkey, CASE WHEN p_partkey % 4 = 3 THEN 'unmappable' WHEN p_partkey % 4 = 0 OR a = b THEN 'match' WHEN p_partkey % 4 = 1 THEN 'glyph' ELSE 'structural' END AS verdict,
CASE WHEN length(a) = length(b) THEN array_to_string(list_filter(range(length(a)), lambda k: substr(a, k + 1, 1) <> substr(b, k + 1, 1)), ',') END AS differ FROM x""")
def compared_atoms(spark, d):
    k, a = F.col("p_partkey") % 4, F.col("p_name")
    b = F.when(k == 0, F.concat(F.lit("  "), F.replace(a, F.lit(" "), F.lit("   ")))).when(k == 1, F.replace(a, F.lit("e"), F.lit("o"))).when(k == 2, F.concat(a, F.lit(" x"))).otherwise("")
    rows = t(spark, d, "part").select("p_partkey", a.alias("a"), b.alias("b"))
    return rows.select("p_partkey", code.compare_text(F.col("a"), F.col("b")).alias("verdict"), F.array_join(F.transform(code.diff_positions(F.col("a"), F.col("b")), lambda x: x.cast("string")), ",").alias("differ"))


@query("SELECT p_partkey, CASE WHEN p_size % 5 = 0 THEN '' ELSE 'int,constchar*,T_' || p_size || '&' END AS types FROM part")
def signature_types(spark, d):
    name = F.replace("p_name", F.lit(" "), F.lit("_"))
    inner = F.when(F.col("p_size") % 5 == 0, " void ").otherwise(F.concat(F.lit("int  n, const char *"), name, F.lit(", T_"), F.col("p_size").cast("string"), F.lit(" &x")))
    return t(spark, d, "part").select("p_partkey", code.signature_types(F.concat(F.lit("static int "), name, F.lit("("), inner, F.lit(")"))).alias("types"))


@query("""
WITH x AS (SELECT doc_id, replace(coalesce(text, ''), '*/', '') AS t, coalesce(source, '') AS s FROM documents)
SELECT doc_id, md5(CASE WHEN contains(t, chr(10)) THEN repeat(chr(10), length(t) - length(replace(t, chr(10), ''))) ELSE ' ' END || ' x = "// kept"; ' || ' ' || chr(10) || 'y = 1 / 2;') AS digest FROM x""")
def stripped_comments(spark, d):
    """A source file for each document, whose text is a comment of it."""
    body = F.concat(F.lit("/* "), F.replace(F.coalesce("text", F.lit("")), F.lit("*/"), F.lit("")), F.lit(' */ x = "// kept"; // '), F.coalesce("source", F.lit("")), F.lit("\ny = 1 / 2;"))
    return t(spark, d, "documents").select("doc_id", F.md5(code.without_c_comments(body).cast("binary")).alias("digest"))


_PAIR = "('0x' || substr(h, {0} + 7, 2) || substr(h, {0} + 5, 2) || substr(h, {0} + 3, 2) || substr(h, {0} + 1, 2))::BIGINT / 2147483648.0 - 1"


@query(f"""
WITH h AS (SELECT doc_id, k, sha256(k || ':' || coalesce(text, '')) AS h FROM documents, (SELECT unnest([0, 1]) AS k)), v AS (SELECT doc_id, 8 * k + n AS n, {_PAIR.format('n * 8')} AS x FROM h, (SELECT unnest(range(8)) AS n))
SELECT doc_id, round(max(x) FILTER (n = 0), 6) AS first, round(max(x) FILTER (n = 11), 6) AS last, round(sum(x) FILTER (n < 12), 6) AS total FROM v GROUP BY doc_id""")
def pseudo_vectors(spark, d):
    v = t(spark, d, "documents").select("doc_id", code.pseudo_vector(F.col("text"), 12).alias("v"))
    return v.select("doc_id", F.round(F.get("v", F.lit(0)), 6).alias("first"), F.round(F.element_at("v", -1), 6).alias("last"), F.round(F.aggregate("v", F.lit(0.0), lambda a, x: a + x), 6).alias("total"))


@query("SELECT p_partkey, (ceil(p_size * 37 / 28.0) * ceil((p_partkey % 2000 + 1) / 28.0))::BIGINT AS image, floor(p_size * 4096 * 0.8)::BIGINT - p_partkey % 500 - length(p_name) - 4096 AS window FROM part")
def token_budgets(spark, d):
    size, k = F.col("p_size"), F.col("p_partkey")
    return t(spark, d, "part").select(k, code.image_tokens(size * 37, k % 2000 + 1).cast("long").alias("image"), code.window_tokens(size * 4096, k % 500, F.length("p_name")).alias("window"))


@query("""
WITH l AS (SELECT l_orderkey AS o, max(l_linenumber) AS n FROM lineitem GROUP BY l_orderkey)
SELECT o_orderkey, CASE o_orderkey % 3 WHEN 0 THEN coalesce(n, 0) END AS rows, CASE o_orderkey % 3 WHEN 1 THEN coalesce(n, 0) END AS lines FROM orders LEFT JOIN l ON o = o_orderkey""")
def payload_totals(spark, d):
    items = t(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.array_sort(F.collect_list(F.struct(F.col("l_linenumber").alias("row_index"), F.col("l_linenumber").alias("line_index")))).alias("items"))
    o = t(spark, d, "orders").select("o_orderkey").join(items, "o_orderkey", "left").withColumn("items", F.coalesce("items", F.array().cast("array<struct<row_index:int,line_index:int>>")))
    kind = F.when(F.col("o_orderkey") % 3 == 0, "table").when(F.col("o_orderkey") % 3 == 1, "terminal").otherwise("diagram")
    n = payloads.totals(kind, F.col("items"), F.col("items"))
    return o.select("o_orderkey", n["rows"].alias("rows"), n["lines"].alias("lines"))


@query()
def string_report(spark, d):
    """Strings of the tables' own files, as bytes."""
    f = readers.binary_files(spark, d, "*.parquet").select("path", "length", "content")
    return scope.string_report(f).withColumn("name", F.regexp_extract("path", r"([^/]+)$", 1)).drop("path")
