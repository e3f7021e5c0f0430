"""Queries of steps that models do, with deterministic stand-ins for the models, and of binaries and routes."""

from __future__ import annotations

from pyspark.sql import functions as F

from quarry.operators import evalm, ingest, providers
from quarry.plans.registry import query, t
from quarry.sources import elf


def _lengths(texts: list[str]) -> list[list[float]]:
    return [[float(len(s) + 1), 1.0] for s in texts]


def _head(prompt: str) -> str:
    return prompt[:40]


@query("SELECT doc_id, (length(text) + 1)::DOUBLE AS x, 1.0::DOUBLE AS y, doc_id % 3 = 0 AS cached FROM documents WHERE doc_id IS NOT NULL")
def vectors_with_cache(spark, d):
    """Every document's vector; a third of the texts are in the cache."""
    docs = t(spark, d, "documents")
    md5 = F.md5(F.col("text").cast("binary")).alias("md5")
    cache = docs.where("doc_id % 3 = 0").select(md5, F.array((F.length("text") + 1).cast("double"), F.lit(1.0)).alias("vector")).dropDuplicates(["md5"])
    return providers.with_vectors(docs, _lengths, cache).select("doc_id", F.col("vector")[0].alias("x"), F.col("vector")[1].alias("y"), (F.col("doc_id") % 3 == 0).alias("cached"))


@query("""
WITH c AS (SELECT doc_id % 20 AS query, doc_id AS id, row_number() OVER (PARTITION BY doc_id % 20 ORDER BY length(text) DESC, doc_id) - 1 AS k, count(*) OVER (PARTITION BY doc_id % 20) AS n FROM documents)
SELECT query, id, CASE WHEN n > 2 THEN CASE k WHEN 2 THEN 1 ELSE 2 END ELSE k + 1 END::INT AS place FROM c WHERE CASE WHEN n > 2 THEN k IN (0, 2) ELSE k < 3 END""")
def ranked_by_model(spark, d):
    """The stand-in always answers with the third and the first document."""
    c = t(spark, d, "documents").select((F.col("doc_id") % 20).alias("query"), F.lit("q").alias("question"), F.col("doc_id").alias("id"), "source", F.col("text").alias("content"), F.length("text").alias("score"))
    return providers.rank_by_model(c, lambda _: "DOC_2, DOC_0, DOC_99, DOC_2", 3).select("query", "id", F.col("place").cast("int").alias("place"))


@query("SELECT o_orderkey, CASE WHEN o_custkey % 4 = 0 THEN o_totalprice ELSE o_custkey::DOUBLE END AS final, CASE WHEN o_custkey % 4 = 0 THEN 'fusion' ELSE 'rerank' END AS score_source FROM orders")
def rerank_fallback(spark, d):
    o = t(spark, d, "orders").select("o_orderkey", F.col("o_totalprice").alias("score"), F.when(F.col("o_custkey") % 4 != 0, F.col("o_custkey").cast("double")).alias("rerank_score"))
    return providers.rerank_or_fall_back(o, "embedding").select("o_orderkey", "final", "score_source")


@query("SELECT conv_id, turn, CASE WHEN role <> 'tool' THEN trim(left('ctx ' || text, 40)) END AS ctx, CASE WHEN role = 'tool' THEN 'generative' END AS absent_reason FROM conversations")
def generated_contexts(spark, d):
    c = t(spark, d, "conversations").withColumn("generative", F.col("role") == "tool")
    cache = spark.createDataFrame([], "fingerprint string, ctx string")
    return providers.generated_contexts(c, _head, cache, F.concat(F.lit("ctx "), "text")).select("conv_id", "turn", "ctx", "absent_reason")


@query()
def document_summaries(spark, d):
    """Every document, level by level, until it fits."""
    return providers.summaries(t(spark, d, "documents"), _head, 400)


@query("SELECT page_id, 'markup' AS route, array_to_string(['/a b.pdf', 'x.so'], '|') AS refs FROM pages")
def routes_and_references(spark, d):
    p = t(spark, d, "pages")
    text = F.concat(F.lit("see file:'/a b.pdf' and FILE:x.so, file:x.so"), F.lit(""))
    return p.select("page_id", providers.route(F.concat(F.col("page_id").cast("string"), F.lit(".html"))).alias("route"), F.array_join(F.transform(providers.file_references(text), lambda x: F.regexp_replace(x, ",$", "")), "|").alias("refs")).withColumn("refs", F.array_join(F.array_distinct(F.split("refs", r"\|")), "|"))


@query("""
WITH f AS (SELECT p_partkey, 'in/' || p_partkey || '/' || replace(p_name, ' ', '_') || CASE p_size % 3 WHEN 0 THEN '.pdf' WHEN 1 THEN '.md' ELSE '.exe' END AS path, replace(p_name, ' ', '_') AS stem, CASE p_size % 3 WHEN 0 THEN '.pdf' WHEN 1 THEN '.md' ELSE '.exe' END AS ext, p_size AS len FROM part),
r AS (SELECT *, CASE WHEN ext = '.exe' THEN 'suffix' WHEN len > 40 THEN 'size' ELSE '' END AS refused FROM f), n AS (SELECT *, row_number() OVER (PARTITION BY stem, ext, refused ORDER BY path) + (stem || ext = 'cold_widget.md')::INT AS n FROM r)
SELECT path, CASE WHEN refused = '' THEN CASE WHEN n = 1 THEN stem || ext ELSE stem || '_' || n || ext END END AS name, refused FROM n""")
def staged_files(spark, d):
    f = t(spark, d, "part").selectExpr("'in/' || p_partkey || '/' || replace(p_name, ' ', '_') || CASE p_size % 3 WHEN 0 THEN '.pdf' WHEN 1 THEN '.md' ELSE '.exe' END AS path", "p_size AS length")
    return providers.staged(f, ["pdf", "md"], 40, spark.createDataFrame([("cold_widget.md",)], "name string"))


@query("SELECT l_orderkey, l_linenumber, CASE l_partkey % 6 WHEN 0 THEN 'exec/process' WHEN 1 THEN 'crypto' WHEN 2 THEN 'threading' WHEN 3 THEN 'memory' WHEN 4 THEN 'printf/str' ELSE 'other' END AS family FROM lineitem")
def import_families(spark, d):
    names = F.array(*map(F.lit, ["execve", "EVP_Digest", "pthread_create", "memcpy", "__snprintf_chk", "my_init"]))
    return t(spark, d, "lineitem").select("l_orderkey", "l_linenumber", elf.family(F.get(names, (F.col("l_partkey") % 6).cast("int"))).alias("family"))


@query("SELECT o_custkey AS path, CASE WHEN o_orderkey % 2 = 0 THEN '.dynsym' ELSE '.symtab' END AS \"table\", o_orderkey AS value, o_custkey AS size, 'f' || o_orderkey AS name FROM orders")
def symbol_listings(spark, d):
    """A listing with two tables for each customer, read back."""
    row = F.format_string("   %d: %016x  %d FUNC    GLOBAL DEFAULT   12 f%d", F.col("o_orderkey"), F.col("o_orderkey"), F.col("o_custkey"), F.col("o_orderkey"))
    o = t(spark, d, "orders").select(F.col("o_custkey").alias("path"), (F.col("o_orderkey") % 2).alias("k"), F.col("o_orderkey").alias("n"), row.alias("line"))
    heads = o.select("path", "k").distinct().select("path", "k", F.lit(-1).cast("long").alias("n"), F.when(F.col("k") == 0, "Symbol table '.dynsym' contains 3 entries:").otherwise("Symbol table '.symtab' contains 9 entries:").alias("line"))
    every = o.unionByName(heads).select("path", (F.col("k") * 1_000_000_000 + F.col("n")).alias("n"), "line")
    return elf.symbol_listing(every).select("path", "table", "value", "size", "name")


@query("SELECT count(DISTINCT source) AS files, count(*) AS symbols FROM documents")
def index_counts(spark, d):
    return t(spark, d, "documents").agg(F.countDistinct("source").alias("files"), F.count("*").alias("symbols"))


@query("SELECT doc_id, '## Answer' || chr(10) || 'a' || chr(10) || chr(10) || '## Evidence' || chr(10) || '- REF1: ' || source || ' p.2 (' || lang || ')' || chr(10) || chr(10) || '---' || chr(10) || '*Coverage: 50%*' AS report FROM documents")
def evidence_reports(spark, d):
    refs = F.array(F.struct("source", F.lit(2).alias("page"), F.col("lang").alias("section")))
    return t(spark, d, "documents").select("doc_id", providers.evidence_report(F.lit("a"), refs, F.array().cast("array<string>"), F.lit(0.5)).alias("report"))


@query()
def chunk_documents(spark, d):
    """Pages as web chunks and conversations as chat chunks, all shaped in one place."""
    c = t(spark, d, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("doc_id"), "text", F.lit("chat").alias("source"))
    return ingest.build_chunks(c, "chat", 300, 50, at=F.current_date().isNotNull()).select("doc_id", "chunk_index", "type", F.length("content").alias("chars"))


@query("SELECT l_orderkey % 50 AS query, l_suppkey AS repo, 'p' || l_partkey % 30 AS path, row_number() OVER (PARTITION BY l_orderkey % 50 ORDER BY l_extendedprice DESC, l_suppkey, 'p' || l_partkey % 30, l_linenumber, l_partkey)::INT AS place FROM lineitem")
def total_order(spark, d):
    r = t(spark, d, "lineitem").selectExpr("l_orderkey % 50 AS query", "l_suppkey AS repo", "'p' || l_partkey % 30 AS path", "l_linenumber AS line", "l_partkey AS doc", "l_extendedprice AS score")
    return evalm.total_order(r).select("query", "repo", "path", "place")
