"""Queries of the code graph, of evaluation and of windows: parts stand for symbols, line items for their relations."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quarry.operators import evalm, graph, ingest, patches
from quarry.plans.registry import query, t
from quarry.plans.retrieval import EDGES, edges

NODE = ["p_partkey AS id", "p_name AS name", "p_brand || '::' || p_name AS qualified_name", "lower(p_type) || '/' || p_brand AS path", "p_size AS line"]
NODES = f"nd AS (SELECT {', '.join(NODE)} FROM part)"
_ASKED = "asked AS (SELECT DISTINCT p_name AS asked FROM part WHERE p_partkey % 100 = 0 UNION SELECT DISTINCT p_brand || '::' || p_name FROM part WHERE p_partkey % 100 = 0)"


def _nodes(spark, d):
    return t(spark, d, "part").selectExpr(*NODE)


def _asked(spark, d):
    p = t(spark, d, "part").where("p_partkey % 100 = 0")
    return p.select(F.col("p_name").alias("asked")).union(p.select(F.concat_ws("::", "p_brand", "p_name"))).distinct()


_HITN = f"{NODES}, {_ASKED}, hn AS (SELECT asked, id, path, line FROM asked JOIN nd ON asked = name OR asked = qualified_name)"


@query(f"WITH {_HITN} SELECT asked, id, path, line FROM hn QUALIFY row_number() OVER (PARTITION BY asked ORDER BY path, line, id) <= 20")
def graph_nodes(spark, d):
    return graph.find_nodes(_nodes(spark, d), _asked(spark, d))


@query("SELECT DISTINCT p_name AS name FROM part WHERE contains(p_name, 'wid') ORDER BY name LIMIT 5")
def suggested_names(spark, d):
    return graph.suggest_names(_nodes(spark, d), "wid")


@query(f"WITH {NODES}, {EDGES} SELECT ed.src, ed.dst, ed.line, a.name AS src_name, b.name AS dst_name, resolved FROM ed LEFT JOIN nd a ON a.id = ed.src LEFT JOIN nd b ON b.id = ed.dst WHERE type = 'calls'")
def named_edges(spark, d):
    return graph.named_edges(edges(spark, d).where("type = 'calls'"), _nodes(spark, d)).select("src", "dst", "line", "src_name", "dst_name", "resolved")


@query(f"WITH {_HITN}, {EDGES} SELECT asked, 'callers' AS side, count(*) AS edges FROM ed JOIN hn ON hn.id = ed.dst WHERE type = 'calls' GROUP BY asked UNION ALL SELECT asked, 'callees', count(*) FROM ed JOIN hn ON hn.id = ed.src WHERE type = 'calls' GROUP BY asked")
def callers_and_callees(spark, d):
    e, n, a = edges(spark, d), _nodes(spark, d), _asked(spark, d)
    side = lambda s, name: graph.edges_of(e, n, a, s).groupBy("asked").agg(F.count("*").alias("edges")).withColumn("side", F.lit(name))
    return side("dst", "callers").unionByName(side("src", "callees"))


@query(f"""
WITH {_HITN}, {EDGES}, r AS (SELECT asked, 0 AS d, src, dst, ed.line, target FROM ed JOIN hn ON hn.id = ed.src WHERE type = 'calls' UNION ALL SELECT asked, 1, src, dst, ed.line, target FROM ed JOIN hn ON hn.id = ed.dst WHERE type = 'calls')
SELECT asked, CASE d WHEN 0 THEN 'out' ELSE 'in' END AS direction, src, dst, line FROM r QUALIFY row_number() OVER (PARTITION BY asked ORDER BY d, src, dst NULLS FIRST, line, target) <= 5""")
def symbol_relations(spark, d):
    return graph.relations(edges(spark, d), _nodes(spark, d), _asked(spark, d))


@query(f"WITH {EDGES} SELECT src, array_to_string(list_sort(list_distinct(list(dst))), ',') AS targets FROM ed WHERE type = 'includes' AND resolved GROUP BY src")
def file_targets(spark, d):
    return graph.file_targets(edges(spark, d)).select("src", F.array_join(F.transform("targets", lambda x: x.cast("string")), ",").alias("targets"))


@query(f"""
WITH {EDGES}, u AS (SELECT src AS a, dst AS b FROM ed WHERE type = 'includes' AND resolved UNION SELECT dst, src FROM ed WHERE type = 'includes' AND resolved), s AS (SELECT p_partkey AS seed FROM part WHERE p_partkey % 100 = 0),
n1 AS (SELECT DISTINCT seed, b AS node FROM s JOIN u ON seed = a), n2 AS (SELECT DISTINCT seed, b AS node FROM n1 JOIN u ON node = a), x AS (SELECT seed, node, min(hop) AS hop FROM (SELECT seed, node, 1 AS hop FROM n1 UNION ALL SELECT seed, node, 2 FROM n2 UNION ALL SELECT seed, seed, 0 FROM s) GROUP BY ALL)
SELECT seed, node, hop::INT AS hop, count(*) OVER (PARTITION BY seed) > 10 AS truncated FROM x WHERE hop > 0 QUALIFY row_number() OVER (PARTITION BY seed ORDER BY hop, node) <= 10""")
def file_neighbors(spark, d):
    seeds = t(spark, d, "part").where("p_partkey % 100 = 0").select(F.col("p_partkey").alias("seed"), F.col("p_partkey").alias("node"))
    return graph.file_neighbors(edges(spark, d), seeds, 2, 10)


@query(f"WITH {EDGES} SELECT count(*) AS edges FROM ed JOIN (SELECT DISTINCT p_partkey AS k FROM part WHERE p_size % 2 = 0) ON k = src")
def edges_in_scope(spark, d):
    scoped = graph.in_scope(edges(spark, d).withColumn("path", F.col("src")), t(spark, d, "part").where("p_size % 2 = 0").select(F.col("p_partkey").alias("path")))
    return scoped.agg(F.count("*").alias("edges"))


_CFILES = "cf AS (SELECT DISTINCT lower(p_type) || '/' || p_size % 10 || '.h' AS path FROM part)"
_INCS = "ic AS (SELECT o_orderkey AS path, CASE o_orderkey % 4 WHEN 0 THEN 'economy/' || o_custkey % 10 || '.h' WHEN 1 THEN o_custkey % 12 || '.h' WHEN 2 THEN 'x\\' || o_custkey % 10 || '.h' ELSE 'none.h' END AS raw FROM orders)"


@query(f"""
WITH {_CFILES}, {_INCS}, r AS (SELECT path, replace(raw, '\\', '/') AS raw FROM ic), b AS (SELECT path AS target, regexp_extract(path, '[^/]*$') AS base FROM cf), n AS (SELECT base, count(*) AS n FROM b GROUP BY base)
SELECT r.path, r.raw, cf.path AS target, 1 AS candidates FROM r JOIN cf ON cf.path = r.raw UNION ALL SELECT r.path, r.raw, b.target, coalesce(n.n, 0) FROM r LEFT JOIN b ON b.base = regexp_extract(r.raw, '[^/]*$') LEFT JOIN n ON n.base = regexp_extract(r.raw, '[^/]*$') WHERE r.raw NOT IN (SELECT path FROM cf)""")
def resolved_includes(spark, d):
    files = t(spark, d, "part").selectExpr("lower(p_type) || '/' || p_size % 10 || '.h' AS path").distinct()
    inc = t(spark, d, "orders").selectExpr("o_orderkey AS path", r"CASE o_orderkey % 4 WHEN 0 THEN 'economy/' || o_custkey % 10 || '.h' WHEN 1 THEN o_custkey % 12 || '.h' WHEN 2 THEN 'x\\' || o_custkey % 10 || '.h' ELSE 'none.h' END AS raw")
    return graph.resolve_includes(inc, files)


@query("""
WITH f AS (SELECT DISTINCT 'pkg/m' || p_size % 10 || CASE WHEN p_size % 20 < 10 THEN '.py' ELSE '/__init__.py' END AS path FROM part UNION SELECT 'pkg/__init__.py'),
i AS (SELECT DISTINCT 'pkg/sub/f' || c_custkey % 7 || '.py' AS path, CASE c_custkey % 4 WHEN 0 THEN 'm' || c_custkey % 12 || '.name' WHEN 1 THEN 'pkg.m' || c_custkey % 12 ELSE 'other.x' END AS module, CASE c_custkey % 4 WHEN 0 THEN 2 ELSE 0 END AS level FROM customer),
p AS (SELECT *, string_split(CASE WHEN level = 2 THEN 'pkg.' ELSE '' END || module, '.') AS parts FROM i), k AS (SELECT *, unnest(generate_series(1, len(parts))) AS n FROM p),
c AS (SELECT path, module, level, n * 2 AS r, array_to_string(parts[1:n], '/') || '.py' AS f FROM k UNION ALL SELECT path, module, level, n * 2 - 1, array_to_string(parts[1:n], '/') || '/__init__.py' FROM k)
SELECT c.path, module, level, arg_max(f.path, CASE WHEN f.path IS NOT NULL THEN r END) AS target FROM c LEFT JOIN f ON f.path = c.f GROUP BY ALL""")
def resolved_imports(spark, d):
    files = t(spark, d, "part").selectExpr("'pkg/m' || p_size % 10 || CASE WHEN p_size % 20 < 10 THEN '.py' ELSE '/__init__.py' END AS path").union(spark.sql("SELECT 'pkg/__init__.py'")).distinct()
    i = t(spark, d, "customer").selectExpr("'pkg/sub/f' || c_custkey % 7 || '.py' AS path", "CASE c_custkey % 4 WHEN 0 THEN 'm' || c_custkey % 12 || '.name' WHEN 1 THEN 'pkg.m' || c_custkey % 12 ELSE 'other.x' END AS module", "CASE c_custkey % 4 WHEN 0 THEN 2 ELSE 0 END AS level").distinct()
    return graph.resolve_imports(i, files)


@query("""
WITH s AS (SELECT p_partkey, p_brand AS path, p_type AS kind, p_name AS q, 'f( ' || p_size % 3 || ')' AS sig, p_partkey AS line FROM part), n AS (SELECT *, count(*) OVER (PARTITION BY path, kind, q) AS n, row_number() OVER (PARTITION BY path, kind, q, sig ORDER BY line) - 1 AS k FROM s)
SELECT p_partkey, substr(sha1(path || chr(31) || 'c' || chr(31) || kind || chr(31) || q || chr(31) || CASE WHEN n = 1 THEN '' WHEN k = 0 THEN 'sig:' || sig ELSE 'sig:' || sig || '#' || k END), 1, 24) AS id FROM n""")
def symbol_ids(spark, d):
    s = t(spark, d, "part").select("p_partkey", F.col("p_brand").alias("path"), F.lit("c").alias("lang"), F.col("p_type").alias("kind"), F.col("p_name").alias("qualified_name"), F.concat(F.lit("f( "), (F.col("p_size") % 3).cast("string"), F.lit(")")).alias("signature"), F.col("p_partkey").alias("line"))
    return graph.assign_ids(s).select("p_partkey", "id")


CONDITIONS = ["", "#ifdef A", "#ifdef A > #else", "#ifdef A > #ifdef B", "#ifdef B", "#ifdef A > #elif C", "#ifdef B > #ifdef A"]


@query()
def condition_relations(spark, d):
    """Every pair of conditions that two line items of an order stand under."""
    arr = F.array(*[F.when(F.lit(c) != "", F.lit(c)) for c in CONDITIONS])
    li = t(spark, d, "lineitem").select("l_orderkey", F.get(arr, (F.col("l_partkey") % 7).cast("int")).alias("condition"), F.get(arr, (F.col("l_suppkey") % 7).cast("int")).alias("call"))
    return li.groupBy("condition", "call").agg(F.count("*").alias("n")).withColumn("relation", graph.condition_relation(F.col("condition"), F.col("call")))


@query("""
WITH RECURSIVE e AS (SELECT DISTINCT l_orderkey % 200 AS src, l_partkey AS dst, l_returnflag = 'R' AS cond FROM lineitem), a AS (SELECT p_partkey AS seed, p_partkey AS node FROM part WHERE p_partkey % 100 = 0 UNION SELECT seed, dst FROM a JOIN e ON node = src AND NOT cond),
r AS (SELECT p_partkey AS seed, p_partkey AS node FROM part WHERE p_partkey % 100 = 0 UNION SELECT seed, dst FROM r JOIN e ON node = src), x AS (SELECT DISTINCT seed, dst AS node FROM r JOIN e ON node = src), y AS (SELECT DISTINCT seed, dst AS node FROM a JOIN e ON node = src AND NOT cond)
SELECT x.seed, x.node, CASE WHEN y.node IS NOT NULL THEN 'active' ELSE 'possible' END AS state FROM x LEFT JOIN y ON x.seed = y.seed AND x.node = y.node""")
def conditional_closure(spark, d):
    """All line items as includes; those returned stand under a condition that the call does not have."""
    inc = t(spark, d, "lineitem").select((F.col("l_orderkey") % 200).alias("src"), F.col("l_partkey").alias("dst"), F.when(F.col("l_returnflag") == "R", "#ifdef A").alias("condition")).distinct()
    starts = t(spark, d, "part").where("p_partkey % 100 = 0").select(F.col("p_partkey").alias("seed"), F.col("p_partkey").alias("node"), F.lit(None).cast("string").alias("call"))
    return graph.include_closure(inc, starts)


# --- evaluation

_RANKED = "rk AS (SELECT l_orderkey % 50 AS query, 'f' || l_partkey % 40 AS file, 's' || l_suppkey AS symbol, l_returnflag AS kind, l_extendedprice AS score, l_partkey * 100 + l_linenumber AS ord FROM lineitem)"
_GOLDF = "gf AS (SELECT DISTINCT o_orderkey % 50 AS query, 'f' || o_custkey % 60 AS file FROM orders WHERE o_custkey % 10 = 0)"


def _ranked(spark, d):
    return t(spark, d, "lineitem").selectExpr("l_orderkey % 50 AS query", "'f' || l_partkey % 40 AS file", "'s' || l_suppkey AS symbol", "l_returnflag AS kind", "l_extendedprice AS score", "l_partkey * 100 + l_linenumber AS ord")


def _gold(spark, d):
    return t(spark, d, "orders").where("o_custkey % 10 = 0").selectExpr("o_orderkey % 50 AS query", "'f' || o_custkey % 60 AS file").distinct()


_BESTF = f"{_RANKED}, bf AS (SELECT query, file, max(score) AS score FROM rk GROUP BY ALL), fr AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY score DESC, file)::INT AS rank FROM bf)"


@query(f"WITH {_BESTF} SELECT query, file, score, rank FROM fr")
def files_by_best_document(spark, d):
    return evalm.best_per_file(_ranked(spark, d)).select("query", "file", "score", "rank")


@query(f"WITH {_BESTF}, {_GOLDF}, j AS (SELECT gf.query, gf.file, rank FROM gf LEFT JOIN (SELECT * FROM fr WHERE rank <= 10) r USING (query, file)) SELECT query, round(count(rank) / count(*), 6) AS recall, round(coalesce(1 / min(rank), 0), 6) AS mrr, coalesce(string_agg(file, ',' ORDER BY file) FILTER (rank IS NOT NULL), '') AS hits, coalesce(string_agg(file, ',' ORDER BY file) FILTER (rank IS NULL), '') AS misses FROM j GROUP BY query")
def file_metrics(spark, d):
    return evalm.file_metrics(evalm.best_per_file(_ranked(spark, d)), _gold(spark, d), 10)


@query(f"""
WITH {_RANKED}, o AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY score DESC, ord)::INT AS rank FROM rk), g AS (SELECT DISTINCT o_orderkey % 50 AS query, 's' || o_custkey % 15 AS symbol FROM orders WHERE o_custkey % 20 < 3), tp AS (SELECT o.* FROM o JOIN g USING (query, symbol) WHERE rank <= 10),
k AS (SELECT query, string_agg(kind || ':' || n, ',' ORDER BY kind || ':' || n) AS kinds FROM (SELECT query, kind, count(*) AS n FROM tp GROUP BY ALL) GROUP BY query), j AS (SELECT g.*, t.symbol IS NOT NULL AS hit FROM g LEFT JOIN (SELECT DISTINCT query, symbol FROM tp) t USING (query, symbol))
SELECT query, round(count(*) FILTER (hit) / count(*), 6) AS recall, coalesce(string_agg(symbol, ',' ORDER BY symbol) FILTER (hit), '') AS found, coalesce(string_agg(symbol, ',' ORDER BY symbol) FILTER (NOT hit), '') AS missing, coalesce(any_value(kinds), '') AS kinds FROM j LEFT JOIN k USING (query) GROUP BY query""")
def symbol_metrics(spark, d):
    ranked = _ranked(spark, d).withColumn("rank", F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), "ord")))
    gold = t(spark, d, "orders").where("o_custkey % 20 < 3").selectExpr("o_orderkey % 50 AS query", "'s' || o_custkey % 15 AS symbol").distinct()
    return evalm.symbol_metrics(ranked, gold, 10)


@query("WITH r AS (SELECT o_totalprice / 500000 AS m, unnest([o_orderpriority, o_orderstatus]) AS tag FROM orders) SELECT tag, count(*) AS cases, round(avg(m), 6) AS m FROM r GROUP BY tag UNION ALL SELECT 'all', count(*), round(avg(o_totalprice / 500000), 6) FROM orders")
def macro_means(spark, d):
    o = t(spark, d, "orders").select((F.col("o_totalprice") / 500000).alias("m"), F.array("o_orderpriority", "o_orderstatus").alias("tags"))
    return evalm.macro(o, ["m"], "tags").unionByName(evalm.macro(o, ["m"]).withColumn("tag", F.lit("all")))


@query("SELECT conv_id, turn, round(0.6 * (turn % 5) / 4 + 0.4 * (contains(lower(text), 'the')::INT + contains(lower(text), 'zzz')::INT) / 2, 6) AS score FROM conversations")
def evidence_correctness(spark, d):
    return t(spark, d, "conversations").select("conv_id", "turn", evalm.evidence_correctness(F.col("turn") % 5 / 4, F.array(F.lit("The"), F.lit("ZZZ")), F.col("text")).alias("score"))


@query("""
WITH e AS (SELECT conv_id AS query, role AS path, text FROM conversations), a AS (SELECT query, sum(length(text)) AS used, count(DISTINCT path) AS files FROM e GROUP BY query), g AS (SELECT DISTINCT conv_id AS query, unnest(['user', 'tool', 'nobody']) AS path FROM conversations WHERE conv_id % 4 > 0),
h AS (SELECT query, count(*) AS hits FROM g WHERE (query, path) IN (SELECT query, path FROM e) GROUP BY query), n AS (SELECT query, count(*) AS gold FROM g GROUP BY query)
SELECT query, used::BIGINT AS used, used <= 2000 AS within, round(CASE WHEN gold > 0 THEN coalesce(hits, 0) / gold ELSE 1.0 END, 6) AS coverage, round(coalesce(hits, 0) / files, 6) AS precision FROM a LEFT JOIN n USING (query) LEFT JOIN h USING (query)""")
def context_metrics(spark, d):
    c = t(spark, d, "conversations").select(F.col("conv_id").alias("query"), F.col("role").alias("path"), "text")
    gold = c.where("query % 4 > 0").select("query", F.explode(F.array(F.lit("user"), F.lit("tool"), F.lit("nobody"))).alias("path"))
    return evalm.context_metrics(c, c.select("query").distinct().withColumn("budget", F.lit(2000)).withColumn("declared", F.lit(None).cast("long")), gold)


@query("WITH f AS (SELECT DISTINCT l_partkey AS src, l_suppkey AS dst FROM lineitem WHERE l_discount < 0.05), g AS (SELECT DISTINCT l_partkey AS src, l_suppkey AS dst FROM lineitem WHERE l_tax < 0.04) SELECT 'false' AS kind, * FROM (SELECT * FROM f EXCEPT SELECT * FROM g) UNION ALL SELECT 'missing', * FROM (SELECT * FROM g EXCEPT SELECT * FROM f)")
def edge_lists(spark, d):
    e = t(spark, d, "lineitem").withColumnsRenamed({"l_partkey": "src", "l_suppkey": "dst"})
    return evalm.edge_lists(e.where("l_discount < 0.05"), e.where("l_tax < 0.04"))


@query("""
WITH j AS (SELECT o_orderkey, o_orderkey % 5 = 0 AS s, o_orderkey % 7 = 0 AS r, (o_custkey % 4) < 3 AND o_custkey % 3 > 0 AS ok, o_custkey % 2 = 0 AS asked, o_custkey % 8 = 0 AS exact FROM orders),
k AS (SELECT *, CASE WHEN NOT r THEN ok::INT WHEN NOT s THEN 0 END AS c, CASE WHEN asked AND NOT r THEN exact::INT WHEN asked AND NOT s THEN 0 END AS n FROM j)
SELECT round(avg(c), 6) AS citation, round(avg(n), 6) AS numeric, round(avg(r::INT), 6) AS refusal_rate, round(avg((r = s)::INT), 6) AS refusal_accuracy, round(count(*) FILTER (r AND s) / count(*) FILTER (s), 6) AS refusal_recall, round(count(*) FILTER (r AND NOT s) / count(*) FILTER (NOT s), 6) AS false_refusals FROM k""")
def answer_scores(spark, d):
    o = t(spark, d, "orders")
    none = "CAST(array() AS array<string>)"
    cases = o.selectExpr("o_orderkey AS case", "o_orderkey % 5 = 0 AS should_refuse", "array('a', 'b', 'c') AS relevant", f"IF(o_custkey % 2 = 0, array('7'), {none}) AS values")
    made = o.selectExpr("o_orderkey AS case", "o_orderkey % 7 = 0 AS refused", f"CASE WHEN o_custkey % 3 = 0 THEN {none} WHEN o_custkey % 4 = 3 THEN array('a', 'z') ELSE array('a') END AS cited", f"IF(o_custkey % 8 = 0, array('7'), {none}) AS answer_values", f"IF(o_custkey % 8 = 0, array('7', '8'), {none}) AS cited_values")
    return evalm.answer_scores(cases, made)


@query(f"""
WITH {EDGES}, c AS (SELECT p_partkey AS ck, CASE p_partkey % 4 WHEN 0 THEN 'resolved' WHEN 1 THEN 'unresolved' WHEN 2 THEN 'ambiguous' ELSE 'no_resolved_calls' END AS kind, CASE WHEN p_partkey % 4 = 0 THEN (p_partkey * 3 % 200)::VARCHAR ELSE 'f' || p_partkey % 50 END AS wanted FROM part),
a AS (SELECT ck, kind, count(*) FILTER (resolved AND dst::VARCHAR = wanted) AS r, count(*) FILTER (target = wanted AND NOT resolved) AS u, count(*) FILTER (target = wanted AND NOT resolved AND ambiguity_group IS NOT NULL) AS m, count(DISTINCT CASE WHEN target = wanted AND NOT resolved THEN ambiguity_group END) AS g, count(*) FILTER (resolved) AS n FROM c LEFT JOIN ed ON src = ck GROUP BY ALL)
SELECT ck AS "check", CASE kind WHEN 'resolved' THEN r > 0 WHEN 'unresolved' THEN u > 0 WHEN 'ambiguous' THEN m >= 2 AND g = 1 ELSE n = 0 END AS passed FROM a""")
def graph_checks(spark, d):
    c = t(spark, d, "part").selectExpr("p_partkey AS check", "p_partkey AS src", "CASE p_partkey % 4 WHEN 0 THEN 'resolved' WHEN 1 THEN 'unresolved' WHEN 2 THEN 'ambiguous' ELSE 'no_resolved_calls' END AS kind", "CASE WHEN p_partkey % 4 = 0 THEN CAST(p_partkey * 3 % 200 AS STRING) ELSE 'f' || p_partkey % 50 END AS target")
    return evalm.graph_checks(c, edges(spark, d))


@query("SELECT o_orderkey, round(0.3 * (o_orderkey % 4) / 3 + 0.3 * (o_orderkey % 3) / 2 + 0.4 * (o_orderkey % 2), 6) AS spec, round(CASE WHEN o_custkey % 3 > 0 THEN 0.4 + CASE WHEN o_custkey % 2 = 0 THEN 0.4 ELSE 0 END + CASE WHEN o_orderkey % 20 <= 10 THEN 0.2 ELSE 0 END ELSE 0 END, 6)::DOUBLE AS code FROM orders")
def layered_scores(spark, d):
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    return t(spark, d, "orders").select("o_orderkey", evalm.layered(k % 4 / 3, k % 3 / 2, (k % 2).cast("double")).alias("spec"), evalm.code_hit(c % 3 > 0, c % 2 == 0, k % 20).alias("code"))


@query("SELECT p_partkey AS fact, unnest(['value', 'reverse', 'limit']) AS kind, unnest(['what is ' || p_name, 'what has ' || p_size, 'the limit of ' || p_name]) AS question FROM part UNION ALL SELECT p_partkey, 'note', 'why ' || p_brand FROM part WHERE p_size % 2 = 0")
def question_rows(spark, d):
    f = t(spark, d, "part").select(F.col("p_partkey").alias("fact"), F.col("p_name").alias("name"), F.col("p_size").alias("value"), F.when(F.col("p_size") % 2 == 0, F.col("p_brand")).alias("note"))
    return evalm.question_rows(f)


@query("SELECT coalesce(a.id, b.id) AS id, a.s AS a_s, b.s AS b_s, a.s IS NOT DISTINCT FROM b.s AS same FROM (SELECT o_orderkey AS id, o_orderstatus AS s FROM orders WHERE o_orderkey % 5 > 0) a FULL JOIN (SELECT o_orderkey AS id, CASE WHEN o_orderkey % 9 = 0 THEN 'X' ELSE o_orderstatus END AS s FROM orders WHERE o_orderkey % 7 > 0) b ON a.id = b.id")
def runs_side_by_side(spark, d):
    o = t(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderstatus").alias("s"))
    return evalm.side_by_side(o.where("id % 5 > 0"), o.where("id % 7 > 0").withColumn("s", F.when(F.col("id") % 9 == 0, "X").otherwise(F.col("s"))), ["id"], ["s"])


# --- headings, windows and page geometry


@query("""
WITH h AS (SELECT p_size AS page, p_partkey AS o, (1 + p_partkey % 4)::INT AS level, p_name || p_partkey AS title FROM part),
l AS (SELECT *, last_value(CASE WHEN level <= 1 THEN level || title END IGNORE NULLS) OVER w AS a, last_value(CASE WHEN level <= 2 THEN level || title END IGNORE NULLS) OVER w AS b, last_value(CASE WHEN level <= 3 THEN level || title END IGNORE NULLS) OVER w AS c, last_value(CASE WHEN level <= 4 THEN level || title END IGNORE NULLS) OVER w AS d FROM h WINDOW w AS (PARTITION BY page ORDER BY o ROWS UNBOUNDED PRECEDING))
SELECT o AS id, concat_ws(' > ', CASE WHEN a[1] = '1' THEN a[2:] END, CASE WHEN b[1] = '2' AND level >= 2 THEN b[2:] END, CASE WHEN c[1] = '3' AND level >= 3 THEN c[2:] END, CASE WHEN d[1] = '4' AND level >= 4 THEN d[2:] END) AS path FROM l""")
def heading_paths(spark, d):
    h = t(spark, d, "part").select(F.col("p_size").alias("page"), F.col("p_partkey").alias("id"), (1 + F.col("p_partkey") % 4).cast("int").alias("level"), F.concat("p_name", F.col("p_partkey").cast("string")).alias("title"))
    return ingest.heading_paths(h, "page", "id").select("id", "path")


@query("""
WITH s AS (SELECT doc_id, doc_id % 50 AS start, doc_id % 50 + 100 + doc_id % 700 AS "end" FROM documents), p AS (SELECT doc_id, k AS page, (k - 1) * 200 AS a, k * 200 AS b FROM documents, generate_series(1, 10) g(k) WHERE doc_id % 8 > 0)
SELECT s.doc_id, start, "end", coalesce(min(page), 1) AS first_page, coalesce(max(page), 1) AS last_page FROM s LEFT JOIN p ON s.doc_id = p.doc_id AND a < "end" AND start < b GROUP BY ALL""")
def span_pages(spark, d):
    docs = t(spark, d, "documents")
    s = docs.select("doc_id", (F.col("doc_id") % 50).alias("start"), (F.col("doc_id") % 50 + 100 + F.col("doc_id") % 700).alias("end"))
    p = docs.where("doc_id % 8 > 0").select("doc_id", F.explode(F.sequence(F.lit(1), F.lit(10))).alias("page")).select("doc_id", F.col("page").cast("long").alias("page"), ((F.col("page") - 1) * 200).alias("page_start"), (F.col("page") * 200).alias("page_end"))
    return ingest.pages_of_spans(s, p, "doc_id")


@query()
def section_windows(spark, d):
    """Lines of a document as sections, a window around each third one."""
    lines = t(spark, d, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("k", "line"))
    end = F.sum(F.length("line") + 1).over(Window.partitionBy("doc_id").orderBy("k")).cast("int")
    spans = lines.select("doc_id", "k", (end - F.length("line") - 1).alias("start"), end.alias("end"))
    s = spans.groupBy("doc_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("k", "start", "end"))), lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"))).alias("s"))
    k = s.select("doc_id", "s", F.explode(F.expr("filter(sequence(0, size(s) - 1), k -> k % 3 = 0)")).alias("k"))
    w = ingest.section_window(F.col("s"), F.col("k"), F.lit(600))
    return k.select("doc_id", "k", w["start"].alias("start"), w["end"].alias("end"))


@query("SELECT o_orderkey, coalesce(CASE WHEN o_custkey % 3 > 0 THEN 'T' || o_custkey % 10 END, o_orderstatus) AS section, o_orderstatus IS DISTINCT FROM coalesce(CASE WHEN o_custkey % 3 > 0 THEN 'T' || o_custkey % 10 END, o_orderstatus) AS changed FROM orders")
def section_titles(spark, d):
    o = t(spark, d, "orders").select("o_orderkey", F.lit(1).alias("doc"), F.col("o_custkey").alias("section_index"), F.col("o_orderstatus").alias("section"))
    s = t(spark, d, "customer").where("c_custkey % 3 > 0").select(F.lit(1).alias("doc"), F.col("c_custkey").alias("section_index"), F.concat(F.lit("T"), (F.col("c_custkey") % 10).cast("string")).alias("title"))
    return ingest.apply_section_titles(o, s, "doc").select("o_orderkey", "section", "changed")


@query("""
WITH c AS (SELECT l_orderkey AS id, l_linenumber AS row, CASE WHEN l_quantity < 25 THEN '' ELSE l_returnflag END AS text, l_discount < 0.06 AND row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber) > 1 AS spans FROM lineitem QUALIFY count(*) OVER (PARTITION BY l_orderkey, l_linenumber) = 1),
r AS (SELECT *, sum((NOT spans)::INT) OVER (PARTITION BY id ORDER BY row) AS run FROM c), f AS (SELECT *, first_value(text) OVER w AS ft, first_value(row) OVER w AS fr FROM r WINDOW w AS (PARTITION BY id, run ORDER BY row ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING))
SELECT id, row, CASE WHEN text = '' AND ft <> '' AND row > fr THEN ft ELSE text END AS filled, CASE WHEN text = '' AND ft <> '' AND row > fr THEN fr END AS from_row, text <> '' AND row > fr AND ft <> '' AND text <> ft AS conflict FROM f""")
def filled_cells(spark, d):
    w, one = Window.partitionBy("l_orderkey").orderBy("l_linenumber"), Window.partitionBy("l_orderkey", "l_linenumber")
    li = t(spark, d, "lineitem").withColumn("_n", F.count("*").over(one)).withColumn("k", F.row_number().over(w)).where("_n = 1")
    c = li.select(F.col("l_orderkey").alias("id"), F.lit(1).alias("col"), F.col("l_linenumber").alias("row"), F.when(F.col("l_quantity") < 25, "").otherwise(F.col("l_returnflag")).alias("text"), ((F.col("l_discount") < 0.06) & (F.col("k") > 1)).alias("spans"))
    return ingest.fill_down(c, "id").select("id", "row", "filled", "from_row", "conflict")


def _words(spark, d):
    return t(spark, d, "part").selectExpr("CAST(p_size AS BIGINT) AS page", "p_partkey AS id", "p_name AS text", "CAST(p_partkey * 37 % 500 AS DOUBLE) AS x0", "CAST(p_partkey * 53 % 90 AS DOUBLE) AS y0", "p_partkey * 37 % 500 + 40.0D AS x1", "p_partkey * 53 % 90 + 8.0D + p_partkey % 5 AS y1")


@query()
def word_bands(spark, d):
    return ingest.bands(_words(spark, d), "page")


@query()
def word_rows(spark, d):
    return ingest.overlap_rows(_words(spark, d), "page")


@query("SELECT doc_id AS patch, 'src/f' || doc_id || '.txt' AS file, unnest([0, 1, 2]) AS ord, unnest([' ', '-', '+']) AS op, 2 AS start FROM documents")
def patch_lines(spark, d):
    """A patch for every document, parsed."""
    body = F.format_string("--- a/src/f%s.txt\n+++ b/src/f%s.txt\n@@ -2,2 +2,2 @@ x\n keep\n-old\n+new\n\\ No newline", "doc_id", "doc_id")
    return patches.hunks(t(spark, d, "documents").select(F.col("doc_id").alias("patch"), body.alias("content"))).select("patch", "file", "ord", "op", "start")


@query("SELECT 'f' || doc_id AS file, CASE WHEN doc_id % 3 = 0 THEN 'a' || chr(10) || 'keep' || chr(10) || 'new' || chr(10) || 'z' ELSE 'a' || chr(10) || 'z' END AS content, doc_id % 3 = 0 AS applied FROM documents")
def patched_files(spark, d):
    docs = t(spark, d, "documents")
    files = docs.select(F.concat(F.lit("f"), F.col("doc_id").cast("string")).alias("file"), F.when(F.col("doc_id") % 3 == 0, "a\nkeep\nold\nz").otherwise("a\nz").alias("content"))
    body = F.format_string("+++ b/f%s\n@@ -9,2 +9,2 @@\n keep\n-old\n+new", "doc_id")
    return patches.patched(files, patches.hunks(docs.select(F.col("doc_id").alias("patch"), body.alias("content"))))
