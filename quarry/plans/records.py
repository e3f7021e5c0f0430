"""More catalogue queries: layout, checks and updates of records."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quarry.functions import text
from quarry.operators import alignment, conversations, evalm, figures, layout, payloads, records, scope, store, trimming
from quarry.plans.registry import query, t

BOXES = "b AS (SELECT p_size AS page, p_partkey AS id, (p_partkey * 37 % 500)::DOUBLE AS x0, (p_partkey * 53 % 700)::DOUBLE AS y0, p_partkey * 37 % 500 + 40.0 + p_partkey % 90 AS x1, p_partkey * 53 % 700 + 30.0 + p_partkey % 70 AS y1 FROM part)"
IOU = "greatest(least(a.x1, c.x1) - greatest(a.x0, c.x0), 0) * greatest(least(a.y1, c.y1) - greatest(a.y0, c.y0), 0) AS o, (a.x1 - a.x0) * (a.y1 - a.y0) AS sa, (c.x1 - c.x0) * (c.y1 - c.y0) AS sc"


def _boxes(spark, d):
    k = F.col("p_partkey")
    return t(spark, d, "part").select(F.col("p_size").alias("page"), k.alias("id"), (k * 37 % 500).cast("double").alias("x0"), (k * 53 % 700).cast("double").alias("y0"), (k * 37 % 500 + 40.0 + k % 90).alias("x1"), (k * 53 % 700 + 30.0 + k % 70).alias("y1"))


@query(f"""
WITH RECURSIVE {BOXES}, e AS (SELECT page, x, y FROM (SELECT a.page, a.id AS x, c.id AS y, {IOU} FROM b a JOIN b c ON a.page = c.page AND a.id <> c.id) WHERE o / (sa + sc - o) >= 0.2),
r AS (SELECT page, id, id AS root FROM b UNION SELECT e.page, e.y, r.root FROM r JOIN e ON r.page = e.page AND r.id = e.x)
SELECT page, id, min(root) AS part FROM r GROUP BY page, id""")
def iou_components(spark, d):
    b = _boxes(spark, d)
    return layout.components(b, figures.iou_pairs(b, 0.2))


@query(f"""
WITH RECURSIVE {BOXES}, e AS MATERIALIZED (SELECT page, x AS a, y AS b, round(o / (sa + sc - o), 6) AS iou FROM (SELECT a.page, a.id AS x, c.id AS y, {IOU} FROM b a JOIN b c ON a.page = c.page AND a.id < c.id) WHERE o / (sa + sc - o) >= 0.1),
k AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY page ORDER BY iou DESC, a, b) AS r FROM e),
m AS (SELECT page, a, b, iou, r, [a] AS ua, [b] AS ub, true AS ok FROM k WHERE r = 1 UNION ALL SELECT k.page, k.a, k.b, k.iou, k.r, CASE WHEN NOT list_contains(ua, k.a) AND NOT list_contains(ub, k.b) THEN list_append(ua, k.a) ELSE ua END, CASE WHEN NOT list_contains(ua, k.a) AND NOT list_contains(ub, k.b) THEN list_append(ub, k.b) ELSE ub END, NOT list_contains(ua, k.a) AND NOT list_contains(ub, k.b) FROM m JOIN k ON k.page = m.page AND k.r = m.r + 1)
SELECT page, a, b, iou FROM m WHERE ok""")
def box_matching(spark, d):
    return layout.matching(_boxes(spark, d), 0.1)


@query(f"""
WITH {BOXES}, m AS (SELECT page, x, y, round(greatest(o / (sa + sc - o), o / sa), 6) AS s FROM (SELECT a.page, a.id AS x, c.id AS y, {IOU} FROM b a JOIN b c ON a.page = c.page AND a.id % 2 = 1 AND c.id % 2 = 0) WHERE o > 0),
k AS (SELECT page, x, y FROM m WHERE s >= 0.3 QUALIFY row_number() OVER (PARTITION BY page, x ORDER BY s DESC, y) = 1)
SELECT b.page, b.id, coalesce(y, -1) AS part FROM b LEFT JOIN k ON b.page = k.page AND b.id = k.x WHERE b.id % 2 = 1""")
def box_attachment(spark, d):
    b = _boxes(spark, d)
    return layout.attach(b.where("id % 2 = 1"), b.where("id % 2 = 0"), 0.3).withColumn("part", F.coalesce("part", F.lit(-1).cast("long")))


@query("WITH a AS (SELECT user_id, event_id, value, CASE WHEN value - lag(value) OVER (PARTITION BY user_id ORDER BY value) > 2 THEN 1 ELSE 0 END AS new FROM events), c AS (SELECT user_id, sum(new) OVER (PARTITION BY user_id ORDER BY value) AS cluster, value FROM a) SELECT user_id, cluster::BIGINT AS cluster, count(*) AS n, min(value) AS low, max(value) AS high FROM c GROUP BY user_id, cluster")
def value_linkage(spark, d):
    rows = layout.linkage(t(spark, d, "events").select("user_id", "value"), ["user_id"], "value", 2.0)
    return rows.groupBy("user_id", "cluster").agg(F.count("*").alias("n"), F.min("value").alias("low"), F.max("value").alias("high"))


@query('WITH v AS (SELECT DISTINCT p_brand, p_size AS size FROM part), g AS (SELECT *, size - lag(size) OVER (PARTITION BY p_brand ORDER BY size) AS gap FROM v), k AS (SELECT *, (gap IS NOT NULL AND row_number() OVER (PARTITION BY p_brand ORDER BY gap DESC NULLS LAST, size) < 4)::INT AS cut FROM g) SELECT p_brand, size, (sum(cut) OVER (PARTITION BY p_brand ORDER BY size))::INT AS "column" FROM k')
def column_gaps(spark, d):
    return layout.cut_at_gaps(t(spark, d, "part").withColumnRenamed("p_size", "size"), "p_brand", "size", 4)


@query("SELECT p_brand, round(greatest(0.0, 1 - stddev_pop(p_retailprice) / avg(p_retailprice) / 0.25), 6) AS even, round(median(p_size), 6) AS median_size FROM part GROUP BY p_brand")
def evenness(spark, d):
    return t(spark, d, "part").groupBy("p_brand").agg(layout.evenness(F.col("p_retailprice")).alias("even"), F.round(F.median("p_size"), 6).alias("median_size"))


@query("SELECT source, count(*) AS eligible, count(l.doc_id) AS present, floor(count(l.doc_id) * 100 / count(*))::BIGINT AS percent FROM documents d LEFT JOIN labels l USING (doc_id) GROUP BY source")
def context_status(spark, d):
    rows = t(spark, d, "documents").join(t(spark, d, "labels").select("doc_id", F.lit(True).alias("has")), "doc_id", "left")
    return records.coverage(rows, "source", F.col("has").isNotNull())


@query("WITH f AS (SELECT source, doc_id % 2 AS h, avg(length(text)) AS m FROM documents GROUP BY ALL) SELECT a.source, round(a.m, 4) AS before, round(b.m, 4) AS after FROM (SELECT * FROM f WHERE h = 0) a LEFT JOIN (SELECT * FROM f WHERE h = 1) b USING (source) WHERE b.m IS NULL OR a.m - b.m > 100")
def family_regressions(spark, d):
    f = t(spark, d, "documents").groupBy("source", (F.col("doc_id") % 2).alias("h")).agg(F.avg(F.length("text")).alias("m"))
    return records.regressions(f.where("h = 0"), f.where("h = 1"), "source", "m", 100.0).select("source", F.round("before", 4).alias("before"), F.round("after", 4).alias("after"))


@query("WITH r AS (SELECT l_orderkey, l_linenumber, l_linenumber AS e FROM lineitem WHERE l_returnflag <> 'R'), k AS (SELECT *, l_linenumber = coalesce(lag(e) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber) + 1, 1) AS ok FROM r) SELECT l_orderkey, count(*) AS parts, bool_and(ok) AS whole FROM k GROUP BY l_orderkey")
def part_tiling(spark, d):
    rows = t(spark, d, "lineitem").where("l_returnflag <> 'R'").withColumn("e", F.col("l_linenumber"))
    return records.tiles(rows, "l_orderkey", "l_linenumber", "e")


@query("WITH a AS (SELECT DISTINCT l_suppkey, l_partkey FROM lineitem WHERE l_discount < 0.09), b AS (SELECT DISTINCT l_suppkey, l_partkey FROM lineitem WHERE l_tax < 0.08) SELECT DISTINCT l_suppkey FROM ((SELECT * FROM a EXCEPT SELECT * FROM b) UNION ALL (SELECT * FROM b EXCEPT SELECT * FROM a))")
def catalog_delta(spark, d):
    li = t(spark, d, "lineitem")
    return records.catalog_delta(li.where("l_discount < 0.09"), li.where("l_tax < 0.08"), "l_suppkey", "l_partkey")


@query("WITH RECURSIVE e AS (SELECT DISTINCT o_custkey % 40 AS a, (o_custkey * 7 + o_orderkey % 2) % 60 AS b FROM orders), r AS (SELECT DISTINCT c_custkey % 40 AS seed, c_custkey % 40 AS node FROM customer UNION SELECT r.seed, e.b FROM r JOIN e ON r.node = e.a) SELECT seed, node FROM r")
def include_closure(spark, d):
    edges = t(spark, d, "orders").select((F.col("o_custkey") % 40).alias("a"), ((F.col("o_custkey") * 7 + F.col("o_orderkey") % 2) % 60).alias("b")).distinct()
    seeds = t(spark, d, "customer").select((F.col("c_custkey") % 40).alias("seed"), (F.col("c_custkey") % 40).alias("node")).distinct()
    return records.closure(edges, seeds).select("seed", "node")


@query("SELECT conv_id, turn, round(0.25 * regexp_matches(text, 'REF')::INT + 0.25 * (length(text) > 100)::INT + 0.3 * least(length(text) / 1000, 1) + 0.2 * (turn % 3 = 0)::INT, 6) AS quality FROM conversations WHERE role = 'assistant'")
def answer_quality(spark, d):
    c = t(spark, d, "conversations").where("role = 'assistant'")
    q = records.answer_quality(F.col("text").rlike("REF"), F.length("text") > 100, F.least(F.length("text") / 1000, F.lit(1)), F.when(F.col("turn") % 3 == 0, 1.0).otherwise(0.0))
    return c.select("conv_id", "turn", q.alias("quality"))


@query("WITH g AS (SELECT doc_id, unnest(['the', 'le ', '%%%', '|', 'zzz']) AS gold FROM documents WHERE doc_id % 3 > 0) SELECT doc_id, count(gold) AS gold, count(*) FILTER (contains(text, gold)) AS found, CASE WHEN count(gold) = 0 THEN 1.0 ELSE round(count(*) FILTER (contains(text, gold)) / count(gold), 6) END AS recall FROM documents LEFT JOIN g USING (doc_id) GROUP BY doc_id")
def gold_recall(spark, d):
    docs = t(spark, d, "documents").select("doc_id", "text")
    gold = docs.where("doc_id % 3 > 0").select("doc_id", F.explode(F.array(*map(F.lit, ["the", "le ", "%%%", "|", "zzz"]))).alias("gold"))
    return records.gold_recall(docs, gold, "doc_id")


@query("WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, (generate_subscripts(string_split(text, chr(10)), 1) - 1)::INT AS line_no FROM documents), h AS (SELECT *, list_filter(['error', 'idiot', 'copyright', 'license'], lambda x: contains(lower(line), x)) AS f FROM l) SELECT doc_id, line_no, array_to_string(f, ',') AS terms FROM h WHERE len(f) > 0 QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY len(f) DESC, line_no) <= 3")
def lexical_hits(spark, d):
    lines = t(spark, d, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("line_no", "line"))
    return records.term_hits(lines, ["error", "idiot", "copyright", "license"], 3, "doc_id")


@query("SELECT doc_id, source, (row_number() OVER (PARTITION BY source, lang ORDER BY doc_id) - 1)::INT AS ordinal, sha256(source || ':' || lang || ':' || doc_id) AS corpus_id FROM documents")
def corpus_ordinals(spark, d):
    rows = records.ordinals(t(spark, d, "documents"), ["source", "lang"], ["doc_id"])
    return rows.select("doc_id", "source", F.col("ordinal").cast("int").alias("ordinal"), F.sha2(F.concat_ws(":", "source", "lang", "doc_id"), 256).alias("corpus_id"))


@query("WITH r AS (SELECT user_id AS id, max(ts)::DATE AS review_by FROM events GROUP BY user_id), h AS (SELECT user_id AS id, count(*) AS n FROM events WHERE event_type = 'purchase' AND value > 20 GROUP BY user_id) SELECT id, (CASE WHEN n IS NOT NULL THEN DATE '2024-02-01' + 30 ELSE review_by END)::DATE::VARCHAR AS review_by, coalesce(n, 0)::BIGINT AS hits FROM r LEFT JOIN h USING (id)")
def lesson_renewal(spark, d):
    e = t(spark, d, "events").withColumnRenamed("user_id", "id")
    rules = e.groupBy("id").agg(F.to_date(F.max("ts")).alias("review_by")).withColumn("hits", F.lit(0).cast("long"))
    return records.renew(rules, e.where("event_type = 'purchase' AND value > 20").select("id"), 30, F.to_date(F.lit("2024-02-01"))).select("id", F.col("review_by").cast("string").alias("review_by"), "hits")


@query("SELECT event_id, user_id FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) <= 3")
def prune_old_runs(spark, d):
    return store.newest(t(spark, d, "events"), "user_id", "event_id", 3).select("event_id", "user_id")


@query("SELECT page_id, array_to_string(list_sort(list_distinct(regexp_extract_all(url, '[0-9]+'))), ',') AS numbers, regexp_matches(url, '(?i)^https') AS secure FROM pages WHERE regexp_matches(url, '[0-9]')")
def critical_tokens(spark, d):
    return t(spark, d, "pages").where(F.col("url").rlike("[0-9]")).select("page_id", F.array_join(F.array_sort(F.array_distinct(text.all_matches("url", "[0-9]+"))), ",").alias("numbers"), F.col("url").rlike("(?i)^https").alias("secure"))


@query("""
WITH RECURSIVE c AS (SELECT doc_id, text, length(text) AS n FROM documents),
s AS (SELECT doc_id, text, n, 0::BIGINT AS k, 0::BIGINT AS a, CASE WHEN n <= 2000 THEN n WHEN contains(substr(text, 1001, 1000), chr(10)) THEN 1000 + 1000 - position(chr(10) IN reverse(substr(text, 1001, 1000))) + 1 ELSE 2000 END AS e FROM c WHERE n > 0
UNION ALL SELECT doc_id, text, n, k + 1, e, CASE WHEN n <= e + 2000 THEN n WHEN contains(substr(text, e + 1001, 1000), chr(10)) THEN e + 1000 + 1000 - position(chr(10) IN reverse(substr(text, e + 1001, 1000))) + 1 ELSE e + 2000 END FROM s WHERE e < n)
SELECT doc_id, k::INT AS segment, a AS start, e AS "end" FROM s""")
def segments(spark, d):
    return trimming.segments(t(spark, d, "documents"), 2000)


@query("SELECT doc_id, md5(substr(text, (greatest(least(length(text) // 3 - 250, length(text) - 500), 0) + 1)::BIGINT, 500)) AS digest FROM documents")
def centered_slice(spark, d):
    return t(spark, d, "documents").select("doc_id", F.md5(trimming.centered(F.col("text"), F.floor(F.length("text") / 3).cast("int"), 500).cast("binary")).alias("digest"))


def cut_sql(head: int, tail: int, errors: int, mark: str) -> str:
    a = f"CASE WHEN contains(left(text, {head}), chr(10)) THEN {head} - position(chr(10) IN reverse(left(text, {head}))) ELSE {head} END"
    b = f"CASE WHEN contains(right(text, {tail}), chr(10)) THEN {tail} - position(chr(10) IN right(text, {tail})) ELSE {tail} END"
    found = f"list_filter(string_split(substr(text, {a} + 1, length(text) - ({a}) - ({b})), chr(10)), lambda x: regexp_matches(x, '(?i)error|exception|traceback|fail|fatal|panic'))[1:{errors}]"
    return f"left(text, {a}) || chr(10) || '{mark}' || chr(10) || CASE WHEN len({found}) > 0 THEN array_to_string({found}, chr(10)) || chr(10) || '{mark}' || chr(10) ELSE '' END || CASE WHEN {b} = 0 THEN '' ELSE right(text, {b}) END"


_KEPT = "CASE WHEN contains(left(text, 150), chr(10)) THEN 150 - position(chr(10) IN reverse(left(text, 150))) ELSE 150 END"


@query(f"SELECT conv_id, turn, CASE WHEN length(text) <= 200 THEN text ELSE {cut_sql(100, 100, 8, '[...]')} END AS command, CASE WHEN length(text) <= 150 THEN text ELSE left(text, {_KEPT}) || chr(10) || '[... ' || (length(text) - ({_KEPT})) || ' more characters ...]' END AS file FROM conversations")
def trimmed_outputs(spark, d):
    c = F.col("text")
    return t(spark, d, "conversations").select("conv_id", "turn", trimming.command_output(c, 200).alias("command"), trimming.file_output(c, 150).alias("file"))


@query(r"""
WITH x AS (SELECT conv_id, turn, list_filter(string_split(text, chr(10)), lambda l: trim(l) <> '') AS lines, regexp_extract_all(text, '[\w./-]+\.\w+:\d+') AS found FROM conversations),
y AS (SELECT conv_id, turn, lines, list_filter(found, lambda v, i: list_position(found, v) = i)[1:20] AS places, list_filter(lines, lambda l: regexp_matches(l, '(?i)error|exception|traceback|fail|fatal|panic'))[1:5] AS errors FROM x)
SELECT conv_id, turn, array_to_string(list_concat(places, errors, CASE WHEN len(lines) > 3 THEN lines[-3:] ELSE lines END), chr(10)) AS summary FROM y""")
def old_output_summary(spark, d):
    return t(spark, d, "conversations").select("conv_id", "turn", trimming.summary(F.col("text")).alias("summary"))


@query("""
WITH m AS (SELECT *, row_number() OVER (PARTITION BY conv_id, role ORDER BY turn DESC) AS age FROM conversations WHERE role <> 'tool'), n AS (SELECT conv_id, turn, text, length(text) AS n FROM m),
l AS (SELECT *, greatest(floor((800 - coalesce(sum(n) OVER (PARTITION BY conv_id ORDER BY n, turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) / (count(*) OVER (PARTITION BY conv_id) - row_number() OVER (PARTITION BY conv_id ORDER BY n, turn) + 1)), 0) AS level FROM n),
c AS (SELECT conv_id, arg_min(level, n * 100000 + turn) AS cap FROM l WHERE n > level GROUP BY conv_id) SELECT conv_id, turn, CASE WHEN cap IS NULL THEN text ELSE left(text, cap::BIGINT) END AS fitted FROM n LEFT JOIN c USING (conv_id)""")
def fitted_conversations(spark, d):
    """Conversations without tool outputs under 800 characters each; summaries of tool outputs are those of old_output_summary."""
    return conversations.fit_budget(t(spark, d, "conversations").where("role <> 'tool'"), 800).select("conv_id", "turn", "fitted")


@query("""
WITH c AS (SELECT o_custkey AS document, count(*) AS figures, count(*) FILTER (o_orderstatus = 'F') AS pages FROM orders GROUP BY o_custkey)
SELECT *, array_to_string(list_filter([CASE WHEN figures > 12 THEN 'figures' END, CASE WHEN pages > 6 THEN 'pages' END], lambda x: x IS NOT NULL), ',') AS over FROM c""")
def preflight_counts(spark, d):
    c = t(spark, d, "orders").groupBy(F.col("o_custkey").alias("document")).agg(F.count("*").alias("figures"), F.count(F.when(F.col("o_orderstatus") == "F", 1)).alias("pages"))
    return payloads.over_caps(c, {"figures": 12, "pages": 6}).withColumn("over", F.array_join("over", ","))


@query("SELECT l_orderkey, l_linenumber, l_partkey, coalesce(l_suppkey > 0 AND l_quantity / nullif(l_suppkey * 5, 0) >= 0.6, false) AS ok FROM lineitem")
def column_assignments(spark, d):
    return t(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", payloads.column_assignment_ok(F.col("l_quantity"), F.col("l_suppkey") * 5).alias("ok"))


_CELLS = "a AS (SELECT l_orderkey AS k, l_linenumber AS row, col, CASE col WHEN 1 THEN l_partkey || '-' || l_linenumber ELSE l_returnflag END AS text FROM (SELECT * FROM lineitem QUALIFY count(*) OVER (PARTITION BY l_orderkey, l_linenumber) = 1), (SELECT unnest([1, 2]) AS col)), n AS (SELECT k, count(DISTINCT row) AS a, count(DISTINCT row) FILTER (row <> 5) AS b FROM a GROUP BY k)"


def _lines(spark, d):
    """Cells (k, row, col, text) of orders, and of a channel that lost row 5, moved down by one and has another flag in row 3."""
    # an order's lines meet once: the steps that follow group within orders
    li = t(spark, d, "lineitem").repartition("l_orderkey").withColumn("_n", F.count("*").over(Window.partitionBy("l_orderkey", "l_linenumber"))).where("_n = 1")
    both = F.array(F.concat_ws("-", F.col("l_partkey").cast("string"), F.col("l_linenumber").cast("string")), "l_returnflag")
    a = li.select(F.col("l_orderkey").alias("k"), F.col("l_linenumber").alias("row"), F.posexplode(both).alias("col", "text")).withColumn("col", F.col("col") + 1)
    return a, a.where("row <> 5").withColumn("text", F.when((F.col("row") == 3) & (F.col("col") == 2), "Z").otherwise(F.col("text"))).withColumn("row", F.col("row") + 1)


@query(f"""
WITH {_CELLS} SELECT k, row::BIGINT AS row, col, CASE WHEN n.b = 0 OR n.b < 0.6 * n.a THEN 'none' WHEN row = 5 THEN 'unanchored' WHEN row = 3 AND col = 2 THEN 'differ' ELSE 'match' END AS verdict FROM a JOIN n USING (k)""")
def alignment_verdicts(spark, d):
    return alignment.verdicts(*_lines(spark, d), "k")[0]


@query(f"""
WITH {_CELLS} SELECT k, 'row_alignment_failed' AS blocker, b AS detail FROM n WHERE b = 0 OR b < 0.6 * a UNION ALL SELECT k, 'unanchored_rows', a - b FROM n WHERE b > 0 AND b >= 0.6 * a AND b < a""")
def alignment_blockers(spark, d):
    return alignment.verdicts(*_lines(spark, d), "k")[1]


@query()
def conversation_alignment(spark, d):
    """Turns of each conversation with an even number against those of the next one: pairs in order."""
    c = t(spark, d, "conversations").select(F.floor(F.col("conv_id") / 2).alias("k"), F.col("turn").alias("row"), "text", (F.col("conv_id") % 2).alias("side"))
    found = alignment.align_rows(c.where("side = 0").drop("side"), c.where("side = 1").drop("side"), "k")
    return found.select("k", "strategy", F.inline_outer("pairs"))


@query("SELECT conv_id, array_to_string(list_concat(['a', 'b'], list_transform(list(turn ORDER BY turn), lambda x: 't' || x)), ',') AS lines FROM conversations GROUP BY conv_id")
def stitched_tiles(spark, d):
    """Two tiles of a conversation's turns: the second repeats the end of the first."""
    turns = F.transform(F.array_sort(F.collect_list("turn")), lambda x: F.concat(F.lit("t"), x.cast("string")))
    c = t(spark, d, "conversations").groupBy("conv_id").agg(turns.alias("x"))
    first = F.concat(F.array(F.lit("a"), F.lit("b")), F.slice("x", F.lit(1), F.greatest(F.floor(F.size("x") / 2), F.lit(1)).cast("int")))
    return c.select("conv_id", F.array_join(payloads.stitched(F.array(first, F.col("x"))), ",").alias("lines"))


@query("SELECT p_partkey AS id, CASE WHEN p_partkey % 7 = 0 THEN 'id' WHEN p_partkey % 5 = 0 THEN 'kind' WHEN p_size % 9 = 0 THEN 'size' WHEN p_partkey % 4 = 0 THEN 'digest' WHEN p_partkey % 3 = 0 THEN 'box' ELSE '' END AS refused FROM part")
def refused_variants(spark, d):
    k = F.col("p_partkey")
    v = F.struct(F.when(k % 7 != 0, "v").alias("id"), F.when(k % 5 == 0, "other").otherwise("crop").alias("kind"), F.when(F.col("p_size") % 9 == 0, 0).otherwise(10).alias("width"), F.lit(5).alias("height"), F.when(k % 4 == 0, "x").otherwise(F.repeat(F.lit("a"), 64)).alias("digest"), F.when(k % 3 == 0, F.array(F.lit(5.0), F.lit(0.0), F.lit(1.0), F.lit(2.0))).otherwise(F.array(F.lit(0.0), F.lit(0.0), F.lit(1.0), F.lit(2.0))).alias("box"))
    return t(spark, d, "part").select(k.alias("id"), payloads.valid_variant(v).alias("refused"))


@query("WITH r AS (SELECT c_custkey, '/w/' || c_nationkey || '/' || c_mktsegment || '/x' AS root FROM customer) SELECT DISTINCT root, CASE WHEN contains(root, 'FURNITURE') AND starts_with(root, '/w/3/') THEN 'inner' WHEN starts_with(root, '/w/3/') THEN 'outer' END AS name FROM r")
def scope_configs(spark, d):
    roots = t(spark, d, "customer").select(F.concat(F.lit("/w/"), F.col("c_nationkey").cast("string"), F.lit("/"), "c_mktsegment", F.lit("/x")).alias("root")).distinct()
    return scope.config_for(roots, spark.createDataFrame([("/w/3/", "outer"), ("/w/3/FURNITURE", "inner"), ("/w/33", "none")], "prefix string, name string"))


@query()
def figure_tiles(spark, d):
    b = t(spark, d, "part").select(F.col("p_partkey").alias("id"), F.lit(0.0).alias("x0"), F.lit(0.0).alias("y0"), (F.col("p_size") * 20.0).alias("x1"), (F.col("p_size") * 90.0).alias("y1"))
    return payloads.tiles(b)


@query("WITH g AS (SELECT lang AS family, count(*) AS cases, round(avg(quality), 4) AS quality, sum(toxic)::BIGINT AS toxic FROM documents JOIN labels USING (doc_id) GROUP BY lang) SELECT * FROM g")
def family_hits(spark, d):
    rows = t(spark, d, "documents").join(t(spark, d, "labels"), "doc_id").withColumnRenamed("lang", "family")
    return evalm.family_summary(rows, "family", ["quality"], ["toxic"])


@query(f"SELECT conv_id, turn, CASE WHEN length(text) <= 400 THEN text ELSE {cut_sql(120, 280, 5, '[... cut ...]')} END AS cut FROM conversations")
def smart_truncate(spark, d):
    return t(spark, d, "conversations").select("conv_id", "turn", conversations.truncate_keep_errors("text", 400).alias("cut"))
