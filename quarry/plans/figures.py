"""Queries of structured figures: orders stand for tables, documents for terminal output, parts for boxes on pages."""

from __future__ import annotations

from pyspark.sql import functions as F

from quarry.operators import payloads as P
from quarry.plans.registry import query, t

PART = [
    "p_partkey AS id", "CASE WHEN p_partkey % 3 = 0 THEN 'f' || (p_partkey // 7) ELSE '' END AS figure_id", "'s' || p_size % 9 AS source", "p_size AS page", "p_partkey % 4 AS figure_index",
    "CASE p_partkey % 5 WHEN 0 THEN 'native_verified' WHEN 1 THEN 'corroborated' WHEN 2 THEN 'human_verified' WHEN 3 THEN 'unverified' ELSE 'needs_review' END AS status", "'r' || p_size % 3 AS reason",
    "p_partkey % 6 <> 5 AS structured", "p_partkey % 8 AS revision",
]
PARTS = f"pa AS (SELECT {', '.join(PART)}, CASE WHEN p_partkey % 3 = 0 THEN 'id|f' || (p_partkey // 7) ELSE 'loc|s' || p_size % 9 || '|' || p_size || '|' || p_partkey % 4 END AS key FROM part)"
_RANKS = "CASE status WHEN 'needs_review' THEN 0 WHEN 'legacy_unverified' THEN 1 WHEN 'unverified' THEN 2 WHEN 'corroborated' THEN 3 WHEN 'native_verified' THEN 4 ELSE 5 END"
_NAMES = "['needs_review', 'legacy_unverified', 'unverified', 'corroborated', 'native_verified', 'human_verified']"
TRUSTS = f"{PARTS}, wo AS (SELECT key, min({_RANKS}) AS worst, list_sort(list_distinct(list(reason))) AS every FROM pa GROUP BY key), tr AS (SELECT pa.*, {_NAMES}[least({_RANKS}, worst) + 1] AS effective, list_sort(list_distinct(list_concat([reason], every, CASE WHEN worst < {_RANKS} THEN ['figure_part_flagged_elsewhere'] ELSE [] END))) AS whys FROM pa JOIN wo USING (key))"


def _parts(spark, d):
    cols = [c.replace("//", "DIV") for c in PART]
    p = t(spark, d, "part").selectExpr(*cols)
    return p.withColumn("key", P.figure_key("figure_id", "source", "page", "figure_index")).withColumn("reasons", F.array("reason"))


@query(f"WITH {PARTS} SELECT id, key FROM pa")
def figure_keys(spark, d):
    return _parts(spark, d).select("id", "key")


@query(f"WITH {TRUSTS} SELECT id, effective, array_to_string(whys, ',') AS reasons, effective NOT IN ('native_verified', 'corroborated', 'human_verified') AS flagged, CASE WHEN structured AND effective NOT IN ('native_verified', 'corroborated', 'human_verified') THEN 0.8 ELSE 1.3 END::DOUBLE AS weight FROM tr")
def effective_states(spark, d):
    p = P.with_trust(_parts(spark, d), "key")
    bad = P.flagged("effective")
    return p.select("id", "effective", F.array_join(F.array_sort("all_reasons"), ",").alias("reasons"), bad.alias("flagged"), P.capped_weight(F.lit(1.3), F.col("structured"), bad).alias("weight"))


_EXCL = f"{TRUSTS}, ex AS (SELECT key, any_value(source) AS source, {_NAMES}[min(CASE effective WHEN 'needs_review' THEN 0 WHEN 'legacy_unverified' THEN 1 ELSE 2 END) + 1] AS status, array_to_string(list_sort(list_distinct(flatten(list(whys)))), ',') AS reasons, count(*) AS parts FROM tr WHERE effective NOT IN ('native_verified', 'corroborated', 'human_verified') GROUP BY key)"


@query(f"WITH {_EXCL} SELECT key, status, reasons, parts FROM ex")
def excluded_figures(spark, d):
    return P.excluded(P.with_trust(_parts(spark, d), "key"), "key")


@query(f"WITH {_EXCL} SELECT status, count(*) || ' excluded: ' || string_agg(key || ' (' || status || ')', ', ' ORDER BY key || ' (' || status || ')') AS line FROM ex GROUP BY status")
def excluded_lines(spark, d):
    return P.excluded_line(P.excluded(P.with_trust(_parts(spark, d), "key"), "key"), "status", "key")


@query(f"WITH {PARTS} SELECT id, CASE WHEN structured THEN coalesce(CASE WHEN id % 4 > 0 THEN status END, 'legacy_unverified') END AS status FROM pa")
def backfilled_states(spark, d):
    return _parts(spark, d).select("id", P.backfilled(F.when(F.col("id") % 4 > 0, F.col("status")), "structured").alias("status"))


@query(f"WITH {PARTS} SELECT source, key AS figure, max(revision) AS revision FROM pa WHERE status = 'human_verified' GROUP BY source, key")
def human_baseline(spark, d):
    return P.baseline(_parts(spark, d).withColumnRenamed("key", "figure"))


@query(f"WITH {PARTS}, o AS (SELECT id % 10 AS digest, page, max(revision) AS revision FROM pa WHERE status = 'human_verified' GROUP BY ALL) SELECT n.id AS figure, n.id % 10 AS digest, n.page, o.revision FROM pa n JOIN o ON n.id % 10 = o.digest AND n.page = o.page WHERE n.structured")
def carried_verifications(spark, d):
    p = _parts(spark, d).withColumn("digest", F.col("id") % 10)
    return P.carried_over(p, p.where("structured").withColumnRenamed("id", "figure"), ["digest", "page"])


@query(f"WITH {PARTS} SELECT id, min(id) OVER (PARTITION BY page, id % 5) AS of FROM pa")
def shared_results(spark, d):
    p = _parts(spark, d).withColumn("kind", F.col("id") % 5)
    return P.shared_results(p, ["page", "kind"], "id").select("id", "of")


@query(f"WITH {PARTS} SELECT id, page, (coalesce((SELECT max(b.id % 50) FROM pa b WHERE b.source = a.source AND b.page = a.page AND NOT b.structured), -1) + row_number() OVER (PARTITION BY source, page ORDER BY id))::BIGINT AS chunk_index FROM pa a WHERE structured")
def figure_chunk_indexes(spark, d):
    p = _parts(spark, d)
    texts = p.where("NOT structured").select("source", "page", (F.col("id") % 50).alias("chunk_index"))
    return P.numbered_after(p.where("structured").withColumn("ord", F.col("id")), texts).select("id", "page", "chunk_index")


@query(f"WITH {PARTS} SELECT key, true AS in_store FROM pa WHERE structured GROUP BY key UNION ALL SELECT DISTINCT key, false FROM pa WHERE key NOT IN (SELECT key FROM pa WHERE structured)")
def figure_listing(spark, d):
    p = _parts(spark, d)
    return P.listed(p.where("structured"), p, "key")


@query(f"""
WITH {PARTS}, now AS (SELECT key, max(revision) AS r FROM pa GROUP BY key), fx AS (SELECT min(id) AS n, key FROM pa WHERE id % 3 = 0 GROUP BY key), good AS (SELECT fx.key, r, n FROM fx JOIN now USING (key) WHERE CASE WHEN n % 2 = 0 THEN r ELSE r - 1 END = r)
SELECT key, revision, 'c' || id AS content, status FROM pa WHERE key NOT IN (SELECT key FROM good) UNION ALL SELECT key, r + 1, 'fixed ' || n, 'human_verified' FROM good""")
def fixed_figures(spark, d):
    p = _parts(spark, d).select("key", "revision", F.concat(F.lit("c"), F.col("id").cast("string")).alias("content"), "status", "id")
    now = p.groupBy("key").agg(F.max("revision").alias("r"))
    fixes = p.where("id % 3 = 0").groupBy("key").agg(F.min("id").alias("n")).join(now, "key").select("key", F.expr("CASE WHEN n % 2 = 0 THEN r ELSE r - 1 END").alias("expected"), F.concat(F.lit("fixed "), F.col("n").cast("string")).alias("content"))
    return P.fixed(p.drop("id"), fixes, "key")


# --- payloads

_CELLS = "[l_partkey::VARCHAR, l_returnflag || CASE WHEN l_linenumber = 3 THEN '|x' WHEN l_linenumber = 4 THEN '▯' ELSE '' END, l_linestatus]"
TABLES = f"ta AS (SELECT l_orderkey AS id, list({_CELLS} ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice) AS cells, list(l_linenumber ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice) AS nums FROM lineitem GROUP BY l_orderkey)"


def _payloads(spark, d):
    cells = F.array(F.col("l_partkey").cast("string"), F.concat("l_returnflag", F.when(F.col("l_linenumber") == 3, "|x").when(F.col("l_linenumber") == 4, "▯").otherwise("")), F.col("l_linestatus"))
    rows = F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", F.transform(cells, lambda c: F.struct(c.alias("text"), F.lit("ok").alias("state"))).alias("cells"))))
    labels = F.transform(F.array(F.lit("part"), F.lit("flag|s"), F.lit("state")), lambda c: F.struct(c.alias("label")))
    p = t(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("id")).agg(rows.alias("rows")).withColumn("columns", labels)
    return p.withColumn("payload", P.canonical_table(F.col("columns"), F.col("rows")))


_ROWS = "list_transform(cells, lambda r: '| ' || array_to_string(list_transform(r, lambda c: replace(c, '|', '\\|')), ' | ') || ' |')"


@query(f"WITH {TABLES} SELECT id, md5(array_to_string(list_concat(['[FIGURE table rows 1-' || len(cells) || ']', '| part | flag\\|s | state |', '| --- | --- | --- |'], {_ROWS}, ['[FOOTNOTE 1] a', '[FOOTNOTE 2] b']), chr(10))) AS digest FROM ta")
def table_texts(spark, d):
    n = F.size("payload.rows")
    header = F.concat(F.lit("[FIGURE table rows 1-"), n.cast("string"), F.lit("]"))
    text = P.table_lines(header, F.col("payload"), F.lit(1), n, F.array(F.lit("a"), F.lit("b")))
    return _payloads(spark, d).select("id", F.md5(text.cast("binary")).alias("digest"))


@query(f"""
WITH RECURSIVE {TABLES}, sz AS (SELECT id, list_transform({_ROWS}, lambda s: length(s)) AS s FROM ta),
f AS (SELECT id, s, 1 AS k, 1 AS first, 40 + s[1] + 1 AS used, 0 AS part FROM sz UNION ALL SELECT id, s, k + 1, CASE WHEN used + s[k + 1] + 1 <= 80 THEN first ELSE k + 1 END, CASE WHEN used + s[k + 1] + 1 <= 80 THEN used + s[k + 1] + 1 ELSE 40 + s[k + 1] + 1 END, CASE WHEN used + s[k + 1] + 1 <= 80 THEN part ELSE part + 1 END FROM f WHERE k < len(s))
SELECT id, first::INT AS first, max(k)::INT AS last, max(used) > 80 AS oversized FROM f GROUP BY id, first""")
def payload_parts(spark, d):
    sizes = F.transform("payload.rows", lambda r: F.length(P.row_line(r)))
    return _payloads(spark, d).select("id", F.inline(P.parts(sizes, F.lit(40), 80)))


_GAP = "len(list_filter(generate_series(1, len(nums)), lambda i: nums[i] <> i)) > 0"


@query(f"""
WITH {TABLES}, g AS (SELECT id, CASE WHEN {_GAP} THEN ['rows: row_index has gaps'] ELSE [] END AS a, list_transform(list_filter(generate_series(1, len(cells)), lambda i: contains(cells[i][2], '▯')), lambda i: 'row ' || nums[i] || ' c2 unreadable') AS b FROM ta)
SELECT id, array_to_string(list_concat(a, b)[1:5], '; ') AS why FROM g""")
def payload_doubts(spark, d):
    rows = F.transform("rows", lambda r: F.struct(r["l_linenumber"].alias("row_index"), F.transform(r["cells"], lambda c, j: F.struct(F.concat(F.lit("c"), (j + 1).cast("string")).alias("column_id"), c["text"].alias("text"), c["state"].alias("state"))).alias("cells")))
    return _payloads(spark, d).select("id", F.array_join(P.uncertainty(rows), "; ").alias("why"))


@query("WITH l AS (SELECT doc_id, string_split(text, chr(10)) AS lines, greatest(3, coalesce(list_max(list_transform(regexp_extract_all(text, '`+'), lambda x: length(x))), 0) + 1)::INT AS n FROM documents) SELECT doc_id, md5('[FIGURE terminal]' || chr(10) || repeat('`', n) || chr(10) || array_to_string(lines, chr(10)) || chr(10) || repeat('`', n)) AS digest, len(lines)::INT AS lines FROM l")
def terminal_texts(spark, d):
    lines = F.transform(P.canonical_terminal(F.split("text", "\n")), lambda x: x["text"])
    return t(spark, d, "documents").where(~F.col("text").contains("\r")).select("doc_id", F.md5(P.terminal_text(F.lit("[FIGURE terminal]"), lines).cast("binary")).alias("digest"), F.size(lines).alias("lines"))


@query("SELECT o_orderkey, '0x' || printf('%x', o_orderkey) || ' ' || o_orderstatus AS tokens, 'UUID' AS kind FROM orders")
def critical_token_lists(spark, d):
    text = F.concat(F.lit("0x"), F.lower(F.hex("o_orderkey")), F.lit("  "), "o_orderstatus")
    return t(spark, d, "orders").select("o_orderkey", F.array_join(P.critical_tokens(text, "table"), " ").alias("tokens"), F.lit("UUID").alias("kind"))


@query("SELECT conv_id, turn, left(text, 3) || '▯▯' || substr(text, 6, 4) || '▯' || substr(text, 11) AS masked FROM conversations WHERE length(text) > 12")
def masked_texts(spark, d):
    spans = F.expr("array(named_struct('start', 9, 'end', 10), named_struct('start', 3, 'end', 5))")
    return t(spark, d, "conversations").where("length(text) > 12").select("conv_id", "turn", P.masked("text", spans).alias("masked"))


@query("SELECT o_custkey, count(*) AS rows, 'key,a|b' AS header, max(o_orderkey)::VARCHAR AS top FROM orders GROUP BY o_custkey")
def markdown_grids(spark, d):
    """Orders of a customer as a Markdown table, read back."""
    line = F.concat(F.lit("| "), F.col("o_orderkey").cast("string"), F.lit(" | "), F.col("o_orderstatus"), F.lit(" |"))
    text = F.concat(F.lit("intro\n| key | a\\|b |\n|---|:-:|\n"), F.array_join(F.collect_list(line), "\n"))
    g = t(spark, d, "orders").groupBy("o_custkey").agg(text.alias("text")).withColumn("g", P.markdown_grid("text"))
    return g.select("o_custkey", F.size("g.rows").cast("long").alias("rows"), F.array_join("g.header", ",").alias("header"), F.array_max(F.transform("g.rows", lambda r: F.get(r, F.lit(0)).cast("long"))).cast("string").alias("top"))


# --- signals, scores and states

_BANDS = "ba AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS text, generate_subscripts(string_split(text, chr(10)), 1) AS ord FROM documents), bx AS (SELECT *, 0.0 AS x0, length(text) * 6.0 + ord % 3 AS x1 FROM ba)"
_PROMPT = r"^\s*(?:[$#>]|PS[ >]|[A-Za-z0-9._-]+[@:][^\s]*[$#>])\s"
_LEVEL = r"\b(?:DEBUG|INFO|WARN|WARNING|ERROR|FATAL|TRACE|CRITICAL)\b"
_HEX = r"0[xX][0-9A-Fa-f][0-9A-Fa-f_]*|\[\s*\d+\s*:\s*\d+\s*\]"


def _bands(spark, d):
    b = t(spark, d, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("k", "text"))
    return b.select("doc_id", "text", (F.col("k") + 1).alias("ord"), F.lit(0.0).alias("x0"), (F.length("text") * 6.0 + (F.col("k") + 1) % 3).alias("x1"))


_SIG = f"""{_BANDS}, ex AS (SELECT *, max(x1) OVER (PARTITION BY doc_id) AS r, CASE WHEN length(text) >= 4 AND x1 > x0 THEN (x1 - x0) / length(text) END AS p FROM bx),
si AS (SELECT doc_id, count(*) AS bands, count(*) FILTER (regexp_matches(text, '{_PROMPT}')) AS prompts, count(*) FILTER (regexp_matches(text, '^\\s*[\\[(]\\s*\\d+[.:]\\d+')) AS stamps, count(*) FILTER (regexp_matches(text, '{_LEVEL}')) AS levels, 0 AS ansi,
round(count(*) FILTER ((r - x1) / greatest(1.0, r) > 0.05) / count(*), 4) AS ragged, count(*) FILTER (regexp_matches(text, '{_HEX}')) AS hex_rows, count(*) >= 2 AND NOT bool_or(ord = 1 AND regexp_matches(text, '{_HEX}')) AND bool_or(ord > 1 AND regexp_matches(text, '{_HEX}')) AS header_like,
round(CASE WHEN count(p) < 2 THEN 0.0 ELSE greatest(0.0, least(1.0, 1 - stddev_pop(p) / avg(p) / 0.35)) END, 6) AS mono FROM ex GROUP BY doc_id)"""


@query(f"WITH {_SIG} SELECT doc_id, bands, prompts, stamps, levels, ansi::BIGINT AS ansi, ragged, hex_rows, header_like, round(mono, 5) AS mono FROM si")
def layout_signals(spark, d):
    return P.terminal_signals(_bands(spark, d), "doc_id").withColumn("mono", F.round("mono", 5))


_SHAPES = "sh AS (SELECT p_size AS page, p_partkey AS id, (p_partkey * 37 % 500)::DOUBLE AS x0, (p_partkey * 53 % 700)::DOUBLE AS y0, p_partkey * 37 % 500 + CASE p_partkey % 3 WHEN 0 THEN 90.0 WHEN 1 THEN 1.5 ELSE 30.0 END AS x1, p_partkey * 53 % 700 + CASE p_partkey % 3 WHEN 0 THEN 2.0 WHEN 1 THEN 80.0 ELSE 20.0 END AS y1 FROM part)"


def _shapes(spark, d):
    return t(spark, d, "part").selectExpr("p_size AS page", "p_partkey AS id", "CAST(p_partkey * 37 % 500 AS DOUBLE) AS x0", "CAST(p_partkey * 53 % 700 AS DOUBLE) AS y0", "p_partkey * 37 % 500 + CASE p_partkey % 3 WHEN 0 THEN 90.0D WHEN 1 THEN 1.5D ELSE 30.0D END AS x1", "p_partkey * 53 % 700 + CASE p_partkey % 3 WHEN 0 THEN 2.0D WHEN 1 THEN 80.0D ELSE 20.0D END AS y1")


_RULED = f"{_SHAPES}, ru AS (SELECT page, count(*) FILTER (y1 - y0 <= 2.5 AND x1 - x0 >= 40) AS h_lines, count(*) FILTER (NOT (y1 - y0 <= 2.5 AND x1 - x0 >= 40) AND x1 - x0 <= 2.5 AND y1 - y0 >= 40) AS v_lines, count(*) AS n FROM sh GROUP BY page), rl AS (SELECT page, h_lines, v_lines, n - h_lines - v_lines AS others, h_lines >= 3 AND v_lines >= 2 AS grid, round((n - h_lines - v_lines) / n, 4) AS density FROM ru)"


@query(f"WITH {_RULED} SELECT * FROM rl")
def ruled_lines(spark, d):
    return P.ruled_signals(_shapes(spark, d), "page")


@query(f"""
WITH {_RULED} SELECT page, round(least(1.0, 0.45 * (page % 2 = 0)::INT + 0.2 * CASE WHEN grid THEN 1.0 WHEN h_lines >= 3 THEN 0.5 ELSE 0.0 END + 0.2 * 0.5 + 0.1 * least(1.0, v_lines / 3.0) + 0.05 * grid::INT), 4) AS "table",
round(least(1.0, 0.3 * 0.25 + 0.3 * least(1.0, h_lines / 3.0) + 0.2 * density + 0.2 * least(1.0, others / 8.0)), 4) AS terminal, round(least(1.0, 0.6 * (page % 5 = 0)::INT + 0.4 * density), 4) AS diagram FROM rl""")
def kind_scores(spark, d):
    r = P.ruled_signals(_shapes(spark, d), "page")
    s = P.kind_scores(F.col("page") % 2 == 0, F.col("grid"), F.col("h_lines"), F.lit(0.5), F.col("v_lines"), F.col("grid"), F.lit(0.25), F.col("h_lines"), F.col("density"), F.col("others"), F.col("page") % 5 == 0, F.col("density"))
    return r.select("page", s["table"].alias("table"), s["terminal"].alias("terminal"), s["diagram"].alias("diagram"))


_LOG = r"(trim(text) <> '' AND (substr(regexp_replace(text, '^\s+', ''), 1, 1) IN ('$', '#', '>', '%') OR regexp_matches(text, '\$ |# |> |>>> |PS |root@|C:\\') OR regexp_matches(text, '\[\s*\d+\.\d+\s*\]|\d{2}:\d{2}:\d{2}|\d{4}-\d{2}-\d{2}') OR regexp_matches(text, '(?:^|\s)/[\w.+-]+/[\w./+-]*') OR regexp_matches(text, 'INFO|WARN|WARNING|ERROR|DEBUG|TRACE|FATAL|NOTICE')))"


@query(f"""
WITH {_BANDS}, a AS (SELECT doc_id, count(*) AS n, count(*) FILTER (trim(text) <> '') AS nz, count(*) FILTER (trim(text) <> '' AND {_LOG}) AS logs, avg(length(text)) AS m, stddev_pop(length(text)) AS s, count(*) FILTER (regexp_matches(text, '^\\s')) AS lead, count(*) FILTER (length(text) - length(replace(text, '|', '')) >= 2) AS bars FROM ba GROUP BY doc_id)
SELECT doc_id, round((CASE WHEN nz > 0 THEN logs / nz ELSE 0 END * 4.0 + CASE WHEN m > 0 THEN least(1.0, s / m) ELSE 0 END * 2.0 + lead / n + (1 - bars / n) * 3.0) / 10.0, 6) AS likeness FROM a""")
def terminal_likeness(spark, d):
    return P.terminal_likeness(_bands(spark, d), "doc_id")


_FLAT = "list_filter(flatten(cells), lambda s: trim(s) <> '')"


@query(f"WITH {TABLES}, c AS (SELECT id, {_FLAT} AS x FROM ta) SELECT id, round((2 / 3 * 3.0 + 2.0 + 1.0 + 1.0 + 3.0) / 10.0, 6) AS likeness FROM c WHERE len(x) > 0")
def table_likeness(spark, d):
    texts = F.flatten(F.transform("payload.rows", lambda r: F.transform(r["cells"], lambda c: c["text"])))
    labels = F.transform("payload.columns", lambda c: c["label"])
    return _payloads(spark, d).select("id", P.table_likeness(labels, texts).alias("likeness"))


@query("WITH a AS (SELECT o_orderkey AS id, CASE WHEN o_orderkey % 7 > 0 THEN round(o_orderkey * 31 % 100 / 100, 2) END AS t, CASE WHEN o_orderkey % 5 > 0 THEN round(o_orderkey * 17 % 100 / 100, 2) END AS m FROM orders) SELECT id, CASE WHEN coalesce(t, -1) >= coalesce(m, -1) THEN 'table' ELSE 'terminal' END AS kind, t IS NOT NULL AND m IS NOT NULL AND round(abs(t - m), 6) < 0.15 AS ambiguous FROM a")
def resolved_kinds(spark, d):
    a = t(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.when(F.col("o_orderkey") % 7 > 0, F.round(F.col("o_orderkey") * 31 % 100 / 100, 2)).alias("t"), F.when(F.col("o_orderkey") % 5 > 0, F.round(F.col("o_orderkey") * 17 % 100 / 100, 2)).alias("m"))
    k = P.resolved_kind(F.col("t"), F.col("m"))
    near = F.col("t").isNotNull() & F.col("m").isNotNull() & (F.round(F.abs(F.col("t") - F.col("m")), 6) < 0.15)
    return a.select("id", k["kind"].alias("kind"), near.alias("ambiguous"))


@query("""
WITH r AS (SELECT l_orderkey AS figure, l_linenumber AS atom, l_returnflag AS channel, l_discount < 0.08 AS reliable, CASE WHEN l_tax < 0.06 THEN 'match' ELSE 'differ' END AS verdict, l_quantity > 5 AS matched FROM lineitem),
a AS (SELECT figure, atom, bool_or(channel <> 'R' AND reliable) AS an, bool_or(channel <> 'R' AND reliable AND verdict = 'match' AND matched) AS ma FROM r GROUP BY ALL), c AS (SELECT figure, count(*) AS total, count(*) FILTER (an) AS anchorable, count(*) FILTER (ma) AS matched FROM a GROUP BY figure)
SELECT figure, total, anchorable, matched, CASE WHEN figure % 11 = 0 THEN 'needs_review' WHEN figure % 5 = 0 AND matched > 1 AND anchorable > 2 THEN 'native_verified' WHEN anchorable = total AND matched = total THEN 'corroborated' ELSE 'unverified' END AS status FROM c""")
def figure_states(spark, d):
    r = t(spark, d, "lineitem").select(F.col("l_orderkey").alias("figure"), F.col("l_linenumber").alias("atom"), F.col("l_returnflag").alias("channel"), (F.col("l_discount") < 0.08).alias("reliable"), F.when(F.col("l_tax") < 0.06, "match").otherwise("differ").alias("verdict"), (F.col("l_quantity") > 5).alias("matched"))
    c = P.coverage(r, "figure", "R")
    checks = F.array(F.col("matched") > 1, F.col("anchorable") > 2)
    return c.withColumn("status", P.decided_status((F.col("figure") % 11 == 0).cast("int"), F.col("figure") % 5 == 0, checks, F.col("total"), F.col("anchorable"), F.col("matched")))


# --- truncation, pages and places


@query("""
WITH x AS (SELECT o_custkey AS id, '[FIGURE x]' || chr(10) || '```' || chr(10) || string_agg(o_orderkey::VARCHAR, chr(10) ORDER BY o_orderkey) || chr(10) || '```' AS c, count(*) AS n FROM orders GROUP BY o_custkey),
y AS (SELECT *, left(c, 40) AS k, length(left(c, 40)) - length(regexp_extract(left(c, 40), '[^\\n]*$')) - 1 AS e FROM x)
SELECT id, e::INT AS cut_chars, len(string_split(left(c, e), chr(10)))::INT AS shown_lines, least(len(string_split(left(c, e), chr(10))) - 2, n)::INT AS atoms, left(c, e) || chr(10) || '```' || chr(10) || '... [REF1 cut: ' || len(string_split(left(c, e), chr(10))) || ' lines shown]' AS text FROM y""")
def truncated_figures(spark, d):
    lines = F.array_join(F.transform(F.array_sort(F.collect_list("o_orderkey")), lambda x: x.cast("string")), "\n")
    x = t(spark, d, "orders").groupBy(F.col("o_custkey").alias("id")).agg(F.concat(F.lit("[FIGURE x]\n```\n"), lines, F.lit("\n```")).alias("c"), F.count("*").alias("n"))
    p = x.withColumn("p", P.truncation("c", F.lit("terminal"), F.lit(1), F.col("n"), 40))
    return p.select("id", "p.cut_chars", "p.shown_lines", "p.atoms", P.truncated("c", F.col("p"), F.lit(1)).alias("text"))


@query(f"""
WITH {_SHAPES}, b AS (SELECT page, id, CASE WHEN id % 40 <> 7 THEN 1 END AS known, x0, y0, x0 + 20 + id % 90 AS x1, y0 + 25 + id % 80 AS y1 FROM sh), k AS (SELECT *, known = 1 AND least(x1 - x0, y1 - y0) >= 30 AND (x1 - x0) * (y1 - y0) >= 4000 AS pass FROM b),
p AS (SELECT page, count(*) FILTER (pass) AS pass, count(*) FILTER (known IS NULL) AS missing, page % 10 = 0 AS bare FROM k GROUP BY page), w AS (SELECT *, CASE WHEN bare THEN pass > 0 OR missing > 0 ELSE missing > 0 END AS whole FROM p)
SELECT page, 1 AS figure_index, 'page' AS mode FROM w WHERE whole UNION ALL SELECT page, row_number() OVER (PARTITION BY page ORDER BY id)::INT, 'crop' FROM k JOIN w USING (page) WHERE NOT whole AND NOT bare AND k.pass""")
def page_jobs(spark, d):
    b = _shapes(spark, d).select("page", "id", F.when(F.col("id") % 40 != 7, F.struct("x0", "y0", (F.col("x0") + 20 + F.col("id") % 90).alias("x1"), (F.col("y0") + 25 + F.col("id") % 80).alias("y1"))).alias("box"))
    g = b.groupBy("page").agg(F.transform(F.array_sort(F.collect_list(F.struct("id", "box"))), lambda x: x["box"]).alias("boxes")).withColumn("text", F.when(F.col("page") % 10 == 0, " x ").otherwise("some text of more than twenty characters"))
    return P.page_jobs(g).select("page", "figure_index", "mode")


@query("SELECT o_custkey, arg_min(o_orderstatus || o_orderkey, o_orderkey) AS text FROM orders GROUP BY o_custkey")
def first_page_texts(spark, d):
    o = t(spark, d, "orders").withColumn("text", F.concat("o_orderstatus", F.col("o_orderkey").cast("string")))
    return P.first_texts(o, "o_custkey", "o_orderkey", "text")


@query(r"""
WITH p AS (SELECT doc_id, text AS raw, CASE WHEN doc_id % 9 > 0 THEN doc_id % 13 END AS s, 40 + doc_id % 50 AS e FROM documents), n AS (SELECT *, CASE doc_id % 4 WHEN 0 THEN substr(raw, s + 1, e - s) WHEN 1 THEN '' WHEN 2 THEN 'never there' ELSE substr(raw, s + 3, 12) END AS native FROM p),
k AS (SELECT *, substr(raw, s + 1, e - s) AS part, trim(native) AS proof FROM n)
SELECT doc_id, CASE WHEN s IS NULL THEN 'missing' WHEN e > length(raw) THEN 'outside' WHEN trim(regexp_replace(part, '\s+', ' ', 'g')) = '' THEN 'blank' WHEN proof = '' THEN 'unproven' WHEN NOT contains(part, proof) THEN 'elsewhere'
WHEN regexp_replace(trim(regexp_replace(part, '\s+', ' ', 'g')), '[\s|:-]+', ' ', 'g') <> regexp_replace(trim(regexp_replace(proof, '\s+', ' ', 'g')), '[\s|:-]+', ' ', 'g') THEN 'more' ELSE '' END AS problem FROM k""")
def position_problems(spark, d):
    p = t(spark, d, "documents").selectExpr("doc_id", "text AS raw", "CAST(CASE WHEN doc_id % 9 > 0 THEN doc_id % 13 END AS INT) AS s", "CAST(40 + doc_id % 50 AS INT) AS e")
    p = p.withColumn("native", F.expr("CASE doc_id % 4 WHEN 0 THEN substring(raw, s + 1, e - s) WHEN 1 THEN '' WHEN 2 THEN 'never there' ELSE substring(raw, s + 3, 12) END"))
    return p.select("doc_id", P.position_problem(F.col("raw"), F.col("s"), F.col("e"), F.col("native")).alias("problem"))


@query(r"""
WITH p AS (SELECT doc_id, text AS raw, length(text) AS n FROM documents WHERE length(text) >= 60), k AS (SELECT *, CASE WHEN substr(raw, 10, 1) <> chr(10) THEN chr(10) ELSE '' END || '[T]' || CASE WHEN substr(raw, 21, 1) <> chr(10) THEN chr(10) ELSE '' END AS a, CASE WHEN substr(raw, 40, 1) <> chr(10) THEN chr(10) ELSE '' END || '[U]' || CASE WHEN substr(raw, 46, 1) <> chr(10) THEN chr(10) ELSE '' END AS b FROM p)
SELECT doc_id, md5(left(raw, 10) || a || substr(raw, 21, 20) || b || substr(raw, 46)) AS digest FROM k""".replace("substr(raw, 40, 1) <>", "substr(raw, 40, 1) <>"))
def page_replacements(spark, d):
    raw = F.col("text")
    piece = lambda s, e, mark: F.struct(F.lit(s).alias("start"), F.lit(e).alias("end"), P.marker_piece(raw, F.lit(s), F.lit(e), F.lit(mark)).alias("piece"))
    return t(spark, d, "documents").where("length(text) >= 60").select("doc_id", F.md5(P.replaced(raw, F.array(piece(40, 45, "[U]"), piece(10, 20, "[T]"))).cast("binary")).alias("digest"))


@query("SELECT o_orderkey, o_orderstatus || '::' || substr(sha256(o_orderpriority), 1, 16) AS document, 'fig_' || substr(sha256('doc|' || o_custkey || '|' || (round(o_totalprice / 612, 4)::DECIMAL(12,4)) || ',' || (round(1.0::DOUBLE / 792, 4)::DECIMAL(12,4)) || ',' || (round(50.0::DOUBLE / 612, 4)::DECIMAL(12,4)) || ',' || (round(60.0::DOUBLE / 792, 4)::DECIMAL(12,4)) || '|d'), 1, 16) AS figure FROM orders")
def figure_ids(spark, d):
    box = [F.col("o_totalprice"), F.lit(1.0), F.lit(50.0), F.lit(60.0)]
    return t(spark, d, "orders").select("o_orderkey", P.document_id(F.col("o_orderstatus"), F.col("o_orderpriority")).alias("document"), P.figure_id(F.lit("doc"), F.col("o_custkey"), box, F.lit(612.0), F.lit(792.0), F.lit("d")).alias("figure"))


@query(f"""
WITH {_SHAPES}, v AS (SELECT page, id, x0, y0, x0 + 60 AS x1, y0 + 50 AS y1 FROM sh), c AS (SELECT * FROM v WHERE id % 4 = 0)
SELECT page, id FROM v j WHERE id % 4 > 0 AND NOT EXISTS (SELECT 1 FROM c WHERE c.page = j.page AND greatest(least(c.x1, j.x1) - greatest(c.x0, j.x0), 0) * greatest(least(c.y1, j.y1) - greatest(c.y0, j.y0), 0) / (6000 - greatest(least(c.x1, j.x1) - greatest(c.x0, j.x0), 0) * greatest(least(c.y1, j.y1) - greatest(c.y0, j.y0), 0)) >= 0.2)""")
def uncovered_jobs(spark, d):
    v = _shapes(spark, d).withColumn("x1", F.col("x0") + 60).withColumn("y1", F.col("y0") + 50)
    return P.uncovered(v.where("id % 4 > 0"), v.where("id % 4 = 0"), 0.2).select("page", "id")


@query("WITH p AS (SELECT l_orderkey AS k, l_partkey AS box, round(l_discount * 10, 1) AS iou FROM lineitem), m AS (SELECT k, max(iou) AS top FROM p WHERE iou >= 0.5 GROUP BY k) SELECT p.k, min(box) AS box, count(*) AS ties FROM p JOIN m ON p.k = m.k AND iou = top GROUP BY p.k")
def best_boxes(spark, d):
    p = t(spark, d, "lineitem").select(F.col("l_orderkey").alias("k"), F.col("l_partkey").alias("box"), F.round(F.col("l_discount") * 10, 1).alias("iou"))
    return P.best_box(p, "k", 0.5)
