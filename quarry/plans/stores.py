"""Queries of file scopes, governed rules, stores and logs."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quarry.operators import conversations, rules, scope, store
from quarry.plans.registry import query, t
from quarry.plans.reuse import scratch

# a tree of files: every part is one
FILE = [
    "p_partkey AS id",
    "CASE p_partkey % 7 WHEN 0 THEN 'src' WHEN 1 THEN '.git/x' WHEN 2 THEN 'lib/python3/site-packages/pkg' WHEN 3 THEN 'src/vendor' WHEN 4 THEN 'tools/demo.egg-info' WHEN 5 THEN '.github/flows' ELSE 'docs/' || lower(p_type) END || '/' || "
    "CASE p_partkey % 11 WHEN 0 THEN 'Makefile' WHEN 1 THEN 'LICENSE' WHEN 2 THEN 'a.min.js' WHEN 3 THEN 'Boot' || p_size || '.S' WHEN 4 THEN 'link.ld' WHEN 5 THEN 'notes.md' WHEN 6 THEN '.hidden.c' WHEN 7 THEN 'Kconfig.debug' WHEN 8 THEN 'x_test.c' WHEN 9 THEN 'blob.bin' ELSE replace(p_name, ' ', '_') || '.c' END AS path",
]
FILES = f"fi AS (SELECT *, regexp_extract(path, '[^/]*$') AS name, regexp_replace(path, '/[^/]*$', '') AS dir, lower(regexp_extract(regexp_extract(path, '[^/]*$'), '.\\.([^.]+)$', 1)) AS suf FROM (SELECT {', '.join(FILE)} FROM part))"


def _files(spark, d):
    return t(spark, d, "part").selectExpr(*FILE)


def _in(words):
    return "(" + ", ".join(f"'{w}'" for w in words) + ")"


_BUILD = f"(name IN {_in(scope.BUILD_NAMES)} OR starts_with(name, 'Makefile.') OR starts_with(name, 'makefile.') OR starts_with(name, 'Kconfig.'))"
_ALL = scope.CODE + scope.FIRMWARE + scope.LINKER + scope.DEVICETREE + scope.CONFIG + scope.DOCS
_IGN = f"(lower(name) IN {_in(scope.IGNORED_FILES)} OR regexp_replace(lower(name), '(.)\\.[^.]+$', '\\1') IN {_in(scope.IGNORED_FILES)} OR regexp_matches(lower(name), '(\\.(bak|orig|swp|tmp)|\\.min\\.(js|css)|\\.map)$'))"
_BADDIR = f"len(list_filter(string_split(dir, '/'), lambda x: lower(x) IN {_in(scope.IGNORED_DIRS)} OR (starts_with(x, '.') AND lower(x) NOT IN {_in(scope.ALLOWED_DOT_DIRS)}))) > 0"


@query(f"WITH {FILES} SELECT id, suf IN {_in(_ALL)} OR {_BUILD} AS indexable, NOT {_BUILD} AND suf NOT IN {_in(scope.DOCS + scope.FIRMWARE + scope.LINKER + scope.DEVICETREE)} AS symbols, {_IGN} AS ignored, regexp_matches(name, '\\.(S|ASM|INC|DEF)$') OR suf = regexp_extract(name, '.\\.([^.]+)$', 1) AND suf IN {_in(_ALL)} OR {_BUILD} AS searched FROM fi")
def file_kinds(spark, d):
    p = F.col("path")
    return _files(spark, d).select("id", scope.is_indexable(p).alias("indexable"), scope.enters_symbol_scan(p).alias("symbols"), scope.is_ignored_file(p).alias("ignored"), scope.matches_globs(p, scope.line_search_globs()).alias("searched"))


_RULE = "CASE WHEN len(list_filter(string_split(dir, '/'), lambda x: ends_with(lower(x), '.egg-info'))) > 0 THEN 'B2' WHEN len(list_filter(string_split(dir, '/'), lambda x: lower(x) IN ('site-packages', 'dist-packages'))) > 0 THEN 'A''' WHEN dir = 'docs/economy' OR starts_with(dir, 'docs/economy/') THEN 'C' END"


@query(f"WITH {FILES}, r AS (SELECT DISTINCT dir AS path, {_BADDIR} AS bad, {_RULE} AS rule FROM fi) SELECT path, CASE WHEN bad THEN 'PRUNE' WHEN rule IS NULL THEN 'INDEX' WHEN starts_with(path || '/', 'tools/demo.egg-info/') THEN 'TRAVERSE_ONLY' ELSE 'PRUNE' END AS decision, rule FROM r")
def dir_decisions(spark, d):
    s = scope.Scope(include=["/tools/demo.egg-info/*.c"], exclude=["/docs/economy"])
    return scope.decide_dirs(_files(spark, d).select(F.regexp_replace("path", "/[^/]*$", "").alias("path")), s)


@query(f"WITH {FILES} SELECT id FROM fi WHERE NOT starts_with(name, '.') AND (suf IN {_in(_ALL)} OR {_BUILD}) AND NOT {_IGN} AND NOT {_BADDIR} AND CASE WHEN regexp_matches(path, '^tools/demo\\.egg-info/[^/]*\\.md$') THEN true WHEN ends_with(name, '.ld') THEN false ELSE ({_RULE.replace(' WHEN dir = ', ' WHEN false AND dir = ').replace(' OR starts_with(dir, ', ' OR false AND starts_with(dir, ')}) IS NULL END")
def index_members(spark, d):
    return scope.members(_files(spark, d), scope.Scope(include=["/tools/demo.egg-info/*.md"], exclude=["*.ld"])).select("id")


@query(f"WITH {FILES}, r AS (SELECT DISTINCT dir AS path, {_RULE} AS rule FROM fi) SELECT rule, count(*) AS dirs FROM r WHERE rule IS NOT NULL GROUP BY rule")
def scope_rule_counts(spark, d):
    dirs = _files(spark, d).select(F.regexp_replace("path", "/[^/]*$", "").alias("path"))
    return scope.rule_counts(scope.decide_dirs(dirs, scope.Scope(exclude=["/docs/economy"])))


@query(f"WITH {FILES}, a AS (SELECT unnest(list_transform(generate_series(1, len(string_split(dir, '/'))), lambda k: array_to_string(string_split(dir, '/')[1:k], '/'))) AS path FROM fi) SELECT path, count(*) AS files, len(string_split(path, '/'))::INT AS depth FROM a WHERE len(string_split(path, '/')) <= 2 GROUP BY path")
def tree_listing(spark, d):
    return scope.listing(_files(spark, d), 2)


@query("SELECT doc_id, CASE WHEN doc_id % 5 = 0 THEN 'utf-16-le' WHEN doc_id % 5 = 1 THEN 'utf-8-sig' WHEN doc_id % 5 = 2 THEN NULL ELSE 'utf-8' END AS encoding FROM documents WHERE length(text) >= 40 AND regexp_matches(text, '^[\\x20-\\x7e\\s]{40}')")
def text_encodings(spark, d):
    """Heads of documents that begin with ASCII, written in several ways."""
    docs = t(spark, d, "documents").where("length(text) >= 40").where(F.col("text").rlike(r"^[\x20-\x7e\s]{40}"))
    b = F.col("text").cast("binary")
    head = F.when(F.col("doc_id") % 5 == 0, F.encode(F.left("text", F.lit(40)), "UTF-16LE")).when(F.col("doc_id") % 5 == 1, F.concat(F.unhex(F.lit("EFBBBF")), b)).when(F.col("doc_id") % 5 == 2, F.unhex(F.concat(F.lit("FFFB80"), F.hex(F.left("text", F.lit(3)).cast("binary"))))).otherwise(b)
    return docs.withColumn("_head", head).select("doc_id", scope.encoding(F.col("_head")).alias("encoding"))


@query("""
WITH s AS (SELECT o_custkey AS path, o_orderkey AS "offset", CASE o_orderkey % 5 WHEN 0 THEN ' gcc ' || o_custkey % 7 WHEN 1 THEN 'built 20' || (10 + o_custkey % 20) WHEN 2 THEN '1234567' WHEN 3 THEN 'abc' ELSE 'plain text ' || o_orderkey END AS value FROM orders),
k AS (SELECT path, "offset", trim(value) AS value FROM s WHERE length(trim(value)) >= 6 AND regexp_matches(trim(value), '[a-z]') AND (regexp_matches(value, 'gcc|built') OR regexp_matches(value, '\\b20(1[5-9]|2\\d)\\b')))
SELECT path, min("offset") AS "offset", value FROM k GROUP BY path, value""")
def priority_strings(spark, d):
    s = t(spark, d, "orders").selectExpr("o_custkey AS path", "o_orderkey AS offset", "CASE o_orderkey % 5 WHEN 0 THEN ' gcc ' || o_custkey % 7 WHEN 1 THEN 'built 20' || (10 + o_custkey % 20) WHEN 2 THEN '1234567' WHEN 3 THEN 'abc' ELSE 'plain text ' || o_orderkey END AS value")
    return scope.priority_strings(s)


@query("SELECT l_orderkey, l_linenumber, CASE WHEN l_quantity <= 20 THEN md5(l_returnflag || l_linestatus) ELSE md5((l_quantity * 1000)::BIGINT || ':' || epoch_us(l_shipdate)) END AS hash FROM lineitem")
def file_snapshot(spark, d):
    f = t(spark, d, "lineitem").select(F.struct("l_orderkey", "l_linenumber").alias("path"), (F.col("l_quantity") * 1000).cast("long").alias("length"), F.col("l_shipdate").cast("timestamp").alias("modified"), F.concat("l_returnflag", "l_linestatus").alias("content"))
    return scope.snapshot(f, 20_000).select("path.l_orderkey", "path.l_linenumber", "hash")


# --- rules: every user is a project, every event a rule or a wish for one

_RULES = "ru AS (SELECT 'L-' || lpad((event_id + 1)::VARCHAR, greatest(3, length((event_id + 1)::VARCHAR))::INT, '0') AS id, 'do ' || event_type || ' ' || user_id % 5 AS rule, CASE WHEN event_id % 4 = 0 THEN 'global' ELSE 'project' END AS scope, CASE WHEN event_id % 4 <> 0 THEN '/p/' || user_id END AS project, ts::DATE AS review_by FROM events)"


def _rules(spark, d):
    e = t(spark, d, "events")
    number = (F.col("event_id") + 1).cast("string")
    g = F.col("event_id") % 4 == 0
    return e.select(F.concat(F.lit("L-"), F.lpad(number, 18, "0")).alias("_i"), F.concat(F.lit("L-"), F.when(F.length(number) < 3, F.lpad(number, 3, "0")).otherwise(number)).alias("id"), F.concat(F.lit("do "), "event_type", F.lit(" "), (F.col("user_id") % 5).cast("string")).alias("rule"), F.when(g, "global").otherwise("project").alias("scope"), F.when(~g, F.concat(F.lit("/p/"), F.col("user_id").cast("string"))).alias("project"), F.to_date("ts").alias("review_by")).drop("_i")


@query(f"WITH {_RULES} SELECT id FROM ru WHERE (scope = 'global' OR project = '/p/3') AND review_by < DATE '2024-01-15'")
def rules_expired(spark, d):
    return rules.expired(_rules(spark, d), "/p/3", F.to_date(F.lit("2024-01-15"))).select("id")


@query(f"""
WITH {_RULES}, w AS (SELECT c_custkey AS ord, CASE c_custkey % 6 WHEN 0 THEN '' WHEN 1 THEN 'do click ' || c_custkey % 5 ELSE ' use ' || c_mktsegment || ' ' END AS raw, CASE c_custkey % 4 WHEN 0 THEN 'global' WHEN 3 THEN 'team' ELSE 'project' END AS scope, CASE WHEN c_custkey % 5 = 0 THEN 'rel' ELSE '/p/' || c_nationkey END AS root FROM customer),
p AS (SELECT ord, trim(raw) AS rule, scope, CASE WHEN scope = 'project' THEN root END AS project, CASE WHEN scope = 'team' THEN 'scope' WHEN scope = 'project' AND NOT starts_with(root, '/') THEN 'root' WHEN trim(raw) = '' THEN 'empty' ELSE '' END AS problem FROM w),
k AS (SELECT p.*, (SELECT min(id) FROM ru WHERE ru.rule = p.rule AND ru.scope = p.scope AND ru.project IS NOT DISTINCT FROM p.project) AS known, row_number() OVER (PARTITION BY rule, scope, project ORDER BY ord) AS f FROM p)
SELECT ord, CASE WHEN problem <> '' THEN 'refused: ' || problem WHEN known IS NOT NULL OR f > 1 THEN 'duplicate' ELSE 'added' END AS outcome, CASE WHEN problem = '' AND known IS NULL AND f = 1 THEN (DATE '2024-02-01' + 90)::DATE::VARCHAR END AS review_by FROM k""")
def rules_proposed(spark, d):
    c = t(spark, d, "customer").selectExpr("c_custkey AS ord", "CASE c_custkey % 6 WHEN 0 THEN '' WHEN 1 THEN 'do click ' || c_custkey % 5 ELSE ' use ' || c_mktsegment || ' ' END AS rule", "CASE c_custkey % 4 WHEN 0 THEN 'global' WHEN 3 THEN 'team' ELSE 'project' END AS scope", "CASE WHEN c_custkey % 5 = 0 THEN 'rel' ELSE '/p/' || c_nationkey END AS project")
    known = _rules(spark, d).groupBy("rule", "scope", "project").agg(F.min("id").alias("id"))
    return rules.propose(known, c, F.to_date(F.lit("2024-02-01"))).select("ord", "outcome", F.col("review_by").cast("string").alias("review_by"))


@query("SELECT conv_id, turn, array_to_string(list_sort(list_distinct(regexp_extract_all(text || ' [L-007] x [L-1] [L-0123] [L-007]', '\\[(L-\\d{3,})\\]', 1))), ' ') AS ids FROM conversations WHERE NOT contains(text, '[L-')")
def rule_citations(spark, d):
    c = t(spark, d, "conversations").where("NOT contains(text, '[L-')")
    return c.select("conv_id", "turn", F.array_join(F.array_sort(rules.citations(F.concat("text", F.lit(" [L-007] x [L-1] [L-0123] [L-007]")))), " ").alias("ids"))


@query(f"WITH {_RULES} SELECT project, string_agg('- [' || id || '] ' || rule, chr(10) ORDER BY id) AS markdown FROM ru WHERE scope = 'project' AND review_by >= DATE '2024-01-20' GROUP BY project")
def rules_shown(spark, d):
    live = _rules(spark, d).where("scope = 'project'").where(F.col("review_by") >= F.to_date(F.lit("2024-01-20")))
    return rules.shown(live, "project")


@query(f"WITH {_RULES} SELECT max(event_id) + 2 AS number FROM events")
def next_rule_number(spark, d):
    return rules.next_number(_rules(spark, d)).select(F.col("number").cast("long").alias("number"))


# --- stores and logs


@query("SELECT count(*) AS places, count(*) FILTER (a.l IS DISTINCT FROM b.l OR a.k IS DISTINCT FROM b.k) AS differ, count(*) FILTER (a.l IS DISTINCT FROM b.l OR a.k IS DISTINCT FROM b.k) = 0 AS aligned FROM (SELECT doc_id AS ord, lang AS l, source AS k FROM documents) a FULL JOIN (SELECT doc_id AS ord, CASE WHEN doc_id % 50 = 0 THEN 'xx' ELSE lang END AS l, source AS k FROM documents WHERE doc_id > 3) b USING (ord)")
def index_alignment(spark, d):
    docs = t(spark, d, "documents").select(F.col("doc_id").alias("ord"), F.col("lang").alias("l"), F.col("source").alias("k"))
    return store.aligned(docs, docs.where("ord > 3").withColumn("l", F.when(F.col("ord") % 50 == 0, "xx").otherwise(F.col("l"))), ["l", "k"])


@query("SELECT count(*) AS chunks, count(DISTINCT source) AS sources, (SELECT string_agg(l, ',' ORDER BY l) FROM (SELECT DISTINCT lang AS l FROM documents)) AS types, floor(count(*) FILTER (doc_id % 3 > 0) * 100 / count(*))::BIGINT AS percent FROM documents")
def store_status(spark, d):
    return store.status(t(spark, d, "documents").select("source", F.col("lang").alias("type"), F.when(F.col("doc_id") % 3 > 0, F.col("doc_id")).alias("vector")))


@query("SELECT o_orderkey, sha256('{\"a\":' || o_orderkey || ',\"b\":\"' || o_orderstatus || '\"}') AS fingerprint FROM orders")
def fingerprints(spark, d):
    return t(spark, d, "orders").select("o_orderkey", store.fingerprint(F.col("o_orderkey").alias("a"), F.col("o_orderstatus").alias("b")).alias("fingerprint"))


@query("SELECT user_id, arg_max(value, event_id) AS metrics FROM events WHERE event_type = 'purchase' GROUP BY user_id")
def last_metrics(spark, d):
    e = t(spark, d, "events").withColumn("metrics", F.when(F.col("event_type") == "purchase", F.col("value")))
    return conversations.last_metrics(e, "user_id", "event_id")


@query("""
WITH r AS (SELECT doc_id AS i, source, left(text, 500) AS t, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS n FROM documents), s AS (SELECT source, string_agg('[' || i || '] ' || t, chr(10) ORDER BY n) AS refs FROM r WHERE n <= 5 GROUP BY source)
SELECT source, md5(refs || chr(10) || 'one' || chr(10) || 'two') AS digest FROM s""")
def formatted_contexts(spark, d):
    w = Window.partitionBy("source").orderBy("doc_id")
    first = t(spark, d, "documents").withColumn("_n", F.row_number().over(w)).where("_n <= 5")  # a group limit: five of each source leave a task
    refs = F.transform(F.array_sort(F.collect_list(F.struct("doc_id", "text"))), lambda x: F.struct(x["doc_id"].cast("string").alias("source"), x["text"].alias("content")))
    g = first.groupBy("source").agg(refs.alias("refs"))
    return g.select("source", F.md5(conversations.formatted_context(F.col("refs"), F.array(F.lit("one"), F.lit("two"))).cast("binary")).alias("digest"))


@query("""
SELECT 'r1' AS run_id, false AS failed, 'figures' AS name, count(*) AS rows, md5(sum(p_partkey)::BIGINT::VARCHAR) AS digest FROM part
UNION ALL SELECT 'r1', false, 'variants', count(*), md5(sum(l_partkey)::BIGINT::VARCHAR) FROM lineitem UNION ALL SELECT 'r2', true, 'figures', count(*), md5(sum(s_suppkey)::BIGINT::VARCHAR) FROM supplier""")
def run_artifacts(spark, d):
    """A run of two tables and a failed one, published and read back by their manifests."""
    path = scratch(spark, "runs")
    store.publish_run(spark, path, "r1", {"figures": t(spark, d, "part").select(F.col("p_partkey").alias("id")), "variants": t(spark, d, "lineitem").select(F.col("l_partkey").alias("id"))})
    store.publish_run(spark, path, "r2", {"figures": t(spark, d, "supplier").select(F.col("s_suppkey").alias("id"))}, failed=True)
    out = None
    for run, name in (("r1", "figures"), ("r1", "variants"), ("r2", "figures")):
        digest = store.run_table(spark, path, run, name).agg(F.md5(F.sum("id").cast("string").cast("binary")).alias("digest")).select(F.lit(run).alias("run_id"), F.lit(name).alias("name"), "digest")
        out = digest if out is None else out.unionByName(digest)
    return store.runs(spark, path).join(out, ["run_id", "name"])


@query("SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN 'b' WHEN doc_id % 2 = 0 THEN 'a' ELSE 'old' END AS version FROM documents")
def merged_writers(spark, d):
    """A store of all documents that two writers change one after the other; each writes its own rows alone."""
    path, docs = scratch(spark, "writers"), t(spark, d, "documents").select("doc_id")
    store.publish(docs.withColumn("version", F.lit("old")), path)
    store.publish_changes(docs.where("doc_id % 2 = 0").withColumn("version", F.lit("a")), path, "doc_id")
    store.mutate(spark, path, "doc_id", lambda rows: rows.where("doc_id % 3 = 0").withColumn("version", F.lit("b")).select("doc_id", "version"))
    return store.current(spark, path)
