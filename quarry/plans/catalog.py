"""Named queries over the driver's tables, and the same queries in DuckDB's SQL where SQL can express them."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quarry import config
from quarry.functions import code, text, vectors
from quarry.operators import answer, context, conversations, evalm, figures, graph, ingest, lexical_scan, search, store
from quarry.plans import knowledge, samples
from quarry.plans.bounded import bounded
from quarry.plans.registry import query, t
from quarry.plans.reuse import reuse
from quarry.sources import readers
from quarry.streaming import ingest as streaming

def _quote(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def _list(words: list[str]) -> str:
    return "[" + ", ".join(map(_quote, words)) + "]"


def _any(col: str, words: list[str]) -> str:
    return f"regexp_matches({col}, {_quote('|'.join(re.escape(w) for w in words))})"


def _case(col: str, cases: dict[str, list[str]], default: str) -> str:
    return "CASE " + " ".join(f"WHEN {_any(col, ws)} THEN {_quote(k)}" for k, ws in cases.items()) + f" ELSE {_quote(default)} END"


# RE2 has no lookaround, so its token pattern matches more and a second one filters.
_RE2_WIDE = r"v?[0-9]+(?:\.[0-9]+)+[a-z]*|[a-z0-9_]+"
_RE2_FULL = r"v?[0-9]+(?:\.[0-9]+)+[a-z]*|0x[0-9a-f]+(?:_[0-9a-f]+)*|[0-9]+[a-z]*|[a-z_][a-z0-9_]*"
TOKENS_SQL = f"list_filter(regexp_extract_all(lower({{0}}), '{_RE2_WIDE}'), lambda x: regexp_full_match(x, '{_RE2_FULL}') AND (length(x) > 1 OR regexp_full_match(x, '[0-9]')) AND NOT list_contains({_list(config.STOPWORDS)}, x))"
KEYWORDS_SQL = f"list_distinct(list_filter(string_split_regex(trim(regexp_replace(lower({{0}}), '[^\\p{{{{L}}}}\\p{{{{N}}}}_\\s\\-]|\\s+', ' ', 'g')), ' +'), lambda x: length(x) > 2 AND NOT list_contains({_list(config.STOPWORDS)}, x)))"
WORDS_SQL = r"list_distinct(list_filter(regexp_extract_all(lower({0}), '[\p{{L}}\p{{N}}\p{{M}}_]+'), lambda x: regexp_full_match(x, '{1}')))"
COS_SQL = "list_dot_product({0}::DOUBLE[], {1}::DOUBLE[]) / (sqrt(list_dot_product({0}::DOUBLE[], {0}::DOUBLE[])) * sqrt(list_dot_product({1}::DOUBLE[], {1}::DOUBLE[])))"
BM25_SQL = f"""
asked AS (SELECT item_id AS query, term, count(*) AS qtf FROM (SELECT item_id, unnest({TOKENS_SQL.format('text')}) AS term FROM benchmark) GROUP BY ALL),
tok AS (SELECT doc_id AS id, {TOKENS_SQL.format('text')} AS tokens FROM documents),
whole AS (SELECT count(*) AS n, avg(len(tokens)) AS avgdl FROM tok),
post AS (SELECT term, id, dl, count(*) AS tf FROM (SELECT id, len(tokens) AS dl, unnest(tokens) AS term FROM tok) WHERE term IN (SELECT term FROM asked) GROUP BY ALL),
idf AS (SELECT term, any_value(avgdl) AS avgdl, ln((any_value(n) - count(*) + 0.5) / (count(*) + 0.5) + 1) AS idf FROM post, whole GROUP BY term),
raw AS (SELECT query, id, sum(qtf * idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avgdl))) AS raw FROM post JOIN idf USING (term) JOIN asked USING (term) GROUP BY ALL),
bm AS (SELECT query, id, round(raw / max(raw) OVER (PARTITION BY query), 6) AS score FROM raw),
lex AS (SELECT query, id, score, row_number() OVER (PARTITION BY query ORDER BY score DESC, id) AS rank FROM bm WHERE score >= 0.05)"""
DENSE_SQL = f"""
q AS (SELECT vec_id AS query, embedding AS qv, label AS qlabel FROM embeddings WHERE vec_id % 100 = 0),
sc AS (SELECT query, vec_id AS id, label, qlabel, round({COS_SQL.format('embedding', 'qv')}, 6) AS score FROM embeddings, q),
den AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY score DESC, id) AS rank FROM sc)"""


def _top(spark: SparkSession, d: str, k: int, skip_self: bool = False) -> DataFrame:
    """The k best of every vector for the query set: vectors whose id is divisible by 100."""
    e = t(spark, d, "embeddings")
    return search.dense_top(e, e.where("vec_id % 100 = 0").select(F.col("vec_id").alias("query"), F.col("embedding").alias("qv")), k, skip_self=skip_self)


def _dense(spark: SparkSession, d: str, least: float = -2.0) -> DataFrame:
    """Every vector against the query set (vectors whose id is divisible by 100), scores from least on."""
    e = t(spark, d, "embeddings")
    return search.dense_scores(e, e.where("vec_id % 100 = 0").select(F.col("vec_id").alias("query"), F.col("embedding").alias("qv")), least=least)


# --- types, filters and scalar functions over documents


@query(f"SELECT doc_id, source, {_case('lower(source)', config.TYPE_BY_NAME, 'doc')} AS doc_type FROM documents")
def doc_type_by_name(spark, d):
    return t(spark, d, "documents").select("doc_id", "source", text.type_by_name("source").alias("doc_type"))


def _hits(kind: str) -> str:
    return " + ".join(f"regexp_matches(substr(text, 1, 2000), {_quote(p)})::INT" for p in config.TYPE_BY_CONTENT[kind])


_KINDS = list(config.TYPE_BY_CONTENT)


@query(f"WITH h AS (SELECT doc_id, {', '.join(f'{_hits(k)} AS {k}' for k in _KINDS)} FROM documents), g AS (SELECT *, greatest({', '.join(_KINDS)}) AS top FROM h) SELECT doc_id, doc_type, CASE doc_type WHEN 'spec' THEN 800 WHEN 'api' THEN 600 WHEN 'manual' THEN 1000 WHEN 'guide' THEN 1200 WHEN 'faq' THEN 800 ELSE 1200 END AS size FROM (SELECT doc_id, CASE WHEN top < 2 THEN 'doc' {' '.join(f'WHEN {k} = top THEN {_quote(k)}' for k in _KINDS)} END AS doc_type FROM g)")
def doc_type_by_content(spark, d):
    return t(spark, d, "documents").select("doc_id", text.type_by_content("text").alias("doc_type")).withColumn("size", text.chunk_size("doc_type"))


@query(f"SELECT doc_id, CASE WHEN {_any('upper(text)', [w.upper() for w in config.WARNINGS])} THEN 'warning' ELSE 'doc' END AS type FROM documents")
def content_type_warning(spark, d):
    return t(spark, d, "documents").select("doc_id", text.content_type("text", F.lit("doc")).alias("type"))


@query(r"""
WITH c AS (SELECT doc_id, ch, count(*) AS n FROM (SELECT doc_id, unnest(string_split(text, '')) AS ch FROM documents) GROUP BY ALL),
m AS (SELECT doc_id, max(n) AS top FROM c GROUP BY doc_id)
SELECT doc_id, top::INT AS top_count, length(text) >= 50 AND NOT (top / length(text) > 0.5 OR length(regexp_replace(text, '[^\p{L}]', '', 'g')) / length(text) < 0.3) AS keep
FROM documents JOIN m USING (doc_id)""")
def noise_filter(spark, d):
    return t(spark, d, "documents").withColumn("top_count", text.most_frequent_char_count("text")).select("doc_id", "top_count", (~text.is_noisy("text", F.col("top_count"))).alias("keep"))


@query("SELECT doc_id, floor(length(text) / 4.0)::BIGINT AS est_tokens, floor(length(text) / 3.5)::BIGINT AS budget_tokens FROM documents")
def token_estimate(spark, d):
    return t(spark, d, "documents").select("doc_id", text.estimate_tokens("text").alias("est_tokens"), text.chars_to_tokens(F.length("text")).alias("budget_tokens"))


@query(r"SELECT doc_id, md5(text) AS digest, length(trim(regexp_replace(text, '[\s\x{3000}\x{00a0}]+', ' ', 'g')))::INT AS flat_chars FROM documents")
def canonical_text(spark, d):
    return t(spark, d, "documents").select("doc_id", F.md5(F.col("text").cast("binary")).alias("digest"), F.length(text.collapse_blanks("text")).alias("flat_chars"))


@query(r"""
WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS n FROM documents),
c AS (SELECT *, list_filter(list_transform(string_split(line, '|'), lambda x: regexp_replace(x, '^[\s\p{Z}]+|[\s\p{Z}]+$', '', 'g')), lambda x: x <> '') AS cells, length(line) - length(replace(line, '|', '')) AS pipes FROM l),
o AS (SELECT doc_id, n, CASE WHEN pipes >= 2 THEN CASE WHEN len(cells) >= 3 THEN line WHEN len(cells) >= 2 AND NOT len(list_filter(cells, lambda x: starts_with(x, '-'))) = len(cells) THEN cells[1] || ': ' || cells[2] END
  WHEN regexp_matches(regexp_replace(line, '^[\s\p{Z}]+|[\s\p{Z}]+$', '', 'g'), '^[\-\*•]\s*(.+?):\s*(.+)$') THEN regexp_extract(regexp_replace(line, '^[\s\p{Z}]+|[\s\p{Z}]+$', '', 'g'), '^[\-\*•]\s*(.+?):\s*(.+)$', 1) || ': ' || regexp_extract(regexp_replace(line, '^[\s\p{Z}]+|[\s\p{Z}]+$', '', 'g'), '^[\-\*•]\s*(.+?):\s*(.+)$', 2) ELSE line END AS line FROM c)
SELECT doc_id, md5(string_agg(line, chr(10) ORDER BY n)) AS digest, count(line) AS lines FROM o GROUP BY doc_id""")
def table_normalize(spark, d):
    n = text.normalize_tables("text")
    return t(spark, d, "documents").select("doc_id", F.md5(n.cast("binary")).alias("digest"), F.size(F.split(n, "\n")).cast("long").alias("lines"))


@query(f"""
WITH d AS (SELECT doc_id, list_distinct(regexp_extract_all(lower(text), '[a-z_][a-z0-9_]{{2,}}')) AS toks FROM documents)
SELECT doc_id, len(list_filter(toks, lambda x: NOT list_contains({_list(config.CODE_STOPWORDS)}, x)))::INT AS n FROM d""")
def identifier_tokens(spark, d):
    stop = F.array(*map(F.lit, config.CODE_STOPWORDS))
    toks = F.array_distinct(text.all_matches(F.lower(F.col("text")), "[a-z_][a-z0-9_]{2,}"))
    return t(spark, d, "documents").select("doc_id", F.size(F.filter(toks, lambda x: ~F.array_contains(stop, x))).alias("n"))


@query()
def code_tokens(spark, d):
    return samples.files(spark, d).select("path", F.array_join(text.code_tokens("content"), " ").alias("tokens"))


@query(r"""
WITH x AS (SELECT item_id AS id, list_distinct(regexp_extract_all(text, '\d+')) AS lits FROM benchmark),
y AS (SELECT doc_id, list_distinct(list_transform(list_filter(regexp_extract_all(text, 'v?[0-9]+(?:\.[0-9]+)+|[A-Za-z0-9_]+'), lambda z: regexp_full_match(lower(z), '0x[0-9a-f]+(?:_[0-9a-f]+)*|v?\d+(?:\.\d+)+|\d+')), lambda z: lower(z))) AS lits FROM documents)
SELECT doc_id, len(lits)::INT AS literals FROM y""")
def exact_literals(spark, d):
    return t(spark, d, "documents").select("doc_id", F.size(text.exact_literals("text")).alias("literals"))


# --- questions, answers and conversations

_USER = "conversations WHERE role = 'user'"


@query(f"SELECT conv_id, turn, regexp_matches(text, {_quote(config.NUMERIC_QUESTION)}) AS is_numeric FROM {_USER}")
def numeric_query_flag(spark, d):
    return t(spark, d, "conversations").where("role = 'user'").select("conv_id", "turn", text.is_numeric_question("text").alias("is_numeric"))


@query(f"SELECT conv_id, turn, {_case('lower(text)', config.QUESTION_CLASSES, 'general')} AS class FROM {_USER}")
def question_class(spark, d):
    return t(spark, d, "conversations").where("role = 'user'").select("conv_id", "turn", text.question_class("text").alias("class"))


@query(f"""SELECT conv_id, turn, CASE WHEN regexp_matches(lower(text), {_quote(answer.EXCLUDE)}) AND NOT regexp_matches(lower(text), {_quote(answer.NUMERIC)}) THEN 'excluded'
WHEN {_any('lower(text)', answer.FORCE)} THEN 'force' WHEN regexp_matches(lower(text), {_quote(answer.NUMERIC)}) THEN 'numeric' WHEN regexp_matches(lower(text), {_quote(answer.SPEC)}) THEN 'spec'
WHEN regexp_matches(lower(text), {_quote(answer.COMPARE)}) THEN 'compare' WHEN {_any('lower(text)', config.SPEC_WORDS)} THEN 'keyword' ELSE '' END AS reason FROM {_USER}""")
def grounding_reason(spark, d):
    return t(spark, d, "conversations").where("role = 'user'").select("conv_id", "turn", answer.grounding_reason("text").alias("reason"))


_SENT = r"(SELECT conv_id, turn, unnest(string_split(regexp_replace(text, '([。.!?！？])\s*', '\1' || chr(10), 'g'), chr(10))) AS s FROM conversations WHERE role = 'assistant')"


@query(f"""
WITH s AS (SELECT * FROM {_SENT} WHERE trim(s) <> '' AND regexp_matches(s, {_quote(answer.CLAIM)})),
g AS (SELECT conv_id, turn, count(*) AS claims, count(*) FILTER (regexp_matches(s, '(?i)REF\\s*[123]\\b')) AS verified FROM s GROUP BY ALL)
SELECT conv_id, turn, coalesce(claims, 0) AS claims, coalesce(verified, 0) AS verified, round(coalesce(verified / claims, 1.0), 6) AS coverage
FROM (SELECT conv_id, turn FROM conversations WHERE role = 'assistant') LEFT JOIN g USING (conv_id, turn)""")
def claim_coverage(spark, d):
    rows = t(spark, d, "conversations").where("role = 'assistant'")
    return answer.claim_coverage(rows, ["conv_id", "turn"], F.array(F.lit("1"), F.lit("2"), F.lit("3")))


@query(f"""
WITH s AS (SELECT * FROM {_SENT} WHERE length(trim(s)) >= 15)
SELECT conv_id, turn, count(*) FILTER (regexp_matches(s, {_quote(answer.CODE_CLAIM)})) AS code_claims, count(*) FILTER (regexp_matches(s, {_quote(answer.CODE_CLAIM)}) AND regexp_matches(s, '[\\w./]+\\.\\w+:\\d+')) AS code_cited,
count(*) FILTER (regexp_matches(s, {_quote(answer.REF_CLAIM)})) AS ref_claims, count(*) FILTER (regexp_matches(s, {_quote(answer.REF_CLAIM)}) AND regexp_matches(s, '(?i)REF\\s*\\d+')) AS ref_cited FROM s GROUP BY ALL""")
def claim_citations(spark, d):
    return answer.claim_counts(t(spark, d, "conversations").where("role = 'assistant'"), ["conv_id", "turn"])


@query(f"""
WITH a AS (SELECT conv_id, turn, string_split(regexp_replace(text, '([。.!?！？])\\s*', '\\1' || chr(10), 'g'), chr(10)) AS l FROM conversations WHERE role = 'assistant'), s AS (SELECT conv_id, turn, unnest(l) AS s, generate_subscripts(l, 1) AS n FROM a),
b AS (SELECT *, regexp_matches(trim(s), {_quote(answer.CLAIM)}) AND length(trim(s)) >= 15 AND NOT regexp_matches(trim(s), {_quote(answer.WHITELIST)}) AND NOT list_contains(regexp_extract_all(s, '(?i)REF\\s*(\\d+)', 1), '1') AS bad FROM s WHERE trim(s) <> '')
SELECT conv_id, turn, coalesce(string_agg(trim(s), ' ' ORDER BY n) FILTER (NOT bad), '') AS answer, count(*) FILTER (bad) AS dropped FROM b GROUP BY ALL""")
def evidence_filtered_answer(spark, d):
    return answer.evidence_only(t(spark, d, "conversations").where("role = 'assistant'"), ["conv_id", "turn"], F.array(F.lit("1")))


@query("""
SELECT *, CASE WHEN used >= 0.9 THEN 'hard' WHEN used >= 0.8 THEN 'soft' ELSE 'ok' END AS level FROM (
SELECT conv_id, messages, tool_messages, chars, tokens, round((tokens + 4096) / 5000, 6) AS used FROM (
SELECT conv_id, count(*) AS messages, count(*) FILTER (role = 'tool') AS tool_messages, sum(length(text))::BIGINT AS chars, floor(sum(length(text)) / 3.5)::BIGINT AS tokens FROM conversations GROUP BY conv_id))""")
def conversation_budget(spark, d):
    return conversations.budget(t(spark, d, "conversations"), 5000)


@query("""
SELECT conv_id, turn, role, age, CASE WHEN role = 'assistant' AND age > 1 AND length(text) > 200 THEN left(text, 200) || '…' ELSE text END AS trimmed
FROM (SELECT *, row_number() OVER (PARTITION BY conv_id, role ORDER BY turn DESC)::INT AS age FROM conversations)""")
def trim_recency(spark, d):
    return conversations.trim(t(spark, d, "conversations"), "assistant", recent=1).select("conv_id", "turn", "role", "age", "trimmed")


@query("SELECT conv_id, turn, role, coalesce(last_value(CASE WHEN role = 'user' THEN turn END IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), -1) AS answers FROM conversations")
def resolve_asked_turn(spark, d):
    return conversations.last_of_role(t(spark, d, "conversations"), "user").select("conv_id", "turn", "role", F.coalesce("answers", F.lit(-1).cast("long")).alias("answers"))


@query("""
WITH a AS (SELECT *, CASE WHEN event_type IS NOT DISTINCT FROM lag(event_type) OVER w THEN 0 ELSE 1 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
b AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS run FROM a)
SELECT event_id, user_id, event_type, row_number() OVER (PARTITION BY user_id, run ORDER BY ts, event_id)::INT AS run_length FROM b""")
def tool_run_length(spark, d):
    return conversations.run_lengths(t(spark, d, "events"), ["user_id"], F.col("event_type"), ["ts", "event_id"]).select("event_id", "user_id", "event_type", "run_length")


_RATED = "(SELECT l.doc_id, CASE WHEN toxic = 1 THEN -1 WHEN quality = 1 THEN 1 ELSE 0 END AS rating FROM documents d LEFT JOIN labels l USING (doc_id))"


@query(f"SELECT count(*) AS total, count(*) FILTER (doc_id IS NOT NULL) AS rated, count(*) FILTER (doc_id IS NULL) AS unrated, count(*) FILTER (doc_id IS NOT NULL AND rating = 1) AS good, count(*) FILTER (doc_id IS NOT NULL AND rating = 0) AS neutral, count(*) FILTER (doc_id IS NOT NULL AND rating = -1) AS bad FROM {_RATED}")
def interaction_stats(spark, d):
    return conversations.interaction_stats(_interactions(spark, d))


def _interactions(spark: SparkSession, d: str) -> DataFrame:
    rating = F.when(F.col("toxic") == 1, -1).when(F.col("quality") == 1, 1).when(F.col("quality") == 0, 0)
    return t(spark, d, "documents").join(t(spark, d, "labels"), "doc_id", "left").select("doc_id", F.col("source").alias("question"), F.col("text").alias("answer"), rating.alias("rating"))


@query("SELECT source AS instruction, '' AS input, text AS output FROM documents JOIN labels USING (doc_id) WHERE quality = 1 AND toxic = 0")
def export_training(spark, d):
    return conversations.training_rows(_interactions(spark, d))


# --- lexical retrieval


@query(f"SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest({TOKENS_SQL.format('text')}) AS term FROM documents) GROUP BY ALL")
def bm25_terms(spark, d):
    return search.bm25_terms(t(spark, d, "documents"))


@query(f"""
WITH p AS (SELECT DISTINCT doc_id, term FROM (SELECT doc_id, unnest({TOKENS_SQL.format('text')}) AS term FROM documents)), n AS (SELECT count(*) AS n FROM documents)
SELECT term, df, round(ln((n - df + 0.5) / (df + 0.5) + 1), 6) AS idf FROM (SELECT term, count(*) AS df FROM p GROUP BY term), n""")
def bm25_term_stats(spark, d):
    return search.bm25_term_stats(t(spark, d, "documents")).withColumn("idf", F.round("idf", 6))


@query(f"WITH {BM25_SQL} SELECT query, id, score, rank::INT AS rank FROM lex WHERE rank <= 10")
def bm25_topk(spark, d):
    return lexical_scan.top(lexical_scan.passes(t(spark, d, "documents"), t(spark, d, "benchmark")), 10)


@query(rf"""
WITH q AS (SELECT item_id AS query, {KEYWORDS_SQL.format('text')} AS kw FROM benchmark), w AS (SELECT query, unnest(kw) AS word, len(kw) AS n FROM q WHERE len(kw) > 0),
h AS (SELECT doc_id AS id, unnest({WORDS_SQL.format('text', '[a-z_][a-z0-9_]*')}) AS word FROM documents),
s AS (SELECT query, id, round(count(*) / max(n), 6) AS score FROM h JOIN w USING (word) GROUP BY ALL)
SELECT query, id, score, rank::INT AS rank FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY score DESC, id) AS rank FROM s) WHERE rank <= 5""")
def keyword_overlap_topk(spark, d):
    return search.top_k(search.keyword_scores(t(spark, d, "documents"), t(spark, d, "benchmark")), 5)


# --- dense retrieval, fusion and selection


@query(f"WITH {DENSE_SQL} SELECT query, id, score, rank::INT AS rank FROM den WHERE rank <= 10")
def dense_topk(spark, d):
    return _top(spark, d, 10)


@query(f"WITH {DENSE_SQL} SELECT query, id, score FROM sc WHERE score >= 0.3")
def dense_threshold(spark, d):
    return _dense(spark, d, config.DEFAULT.threshold)


_LABELRANK = "lab AS (SELECT query, id, row_number() OVER (PARTITION BY query ORDER BY (label = qlabel)::INT DESC, id) AS rank FROM sc)"


def _label_rank(spark: SparkSession, d: str) -> DataFrame:
    """A second ranking of the same vectors: those of the query's label first."""
    e = t(spark, d, "embeddings")
    q = e.where("vec_id % 100 = 0").select(F.col("vec_id").alias("query"), F.col("label").alias("qlabel"))
    # the 20 least ids of each label hold the 20 best of every query
    first = e.select("vec_id", "label", F.row_number().over(Window.partitionBy("label").orderBy("vec_id")).alias("n")).where("n <= 20")
    rows = q.crossJoin(bounded(first)).select("query", F.col("vec_id").alias("id"), (F.col("label") == F.col("qlabel")).cast("int").alias("score"))
    return search.top_k(rows, 20)


def _rrf_sql(first: int) -> str:
    part = lambda c: f"coalesce(1 / (60 + {c} + {first - 1}), 0)"
    return f"SELECT query, id, round({part('a.rank')} + {part('b.rank')}, 9) AS rrf FROM (SELECT query, id, rank FROM den WHERE rank <= 20) a FULL JOIN (SELECT query, id, rank FROM lab WHERE rank <= 20) b USING (query, id)"


@query(f"WITH {DENSE_SQL}, {_LABELRANK} {_rrf_sql(0)}")
def rrf_fusion(spark, d):
    return search.rrf(_top(spark, d, 20), _label_rank(spark, d))


@query(f"WITH {DENSE_SQL}, {_LABELRANK} {_rrf_sql(1)}")
def rrf_rank1_union(spark, d):
    return search.rrf(_top(spark, d, 20), _label_rank(spark, d), first_rank=1)


_SIG = "round(1 / (60 + rank - 1), 9) AS rrf, score AS retrieval, score AS gate, round(score / 2, 9) AS bm25"


@query(f"""
WITH {DENSE_SQL}, b AS (SELECT query, id, {_SIG} FROM den WHERE rank <= 20), v AS (SELECT query - 100 AS query, id, {_SIG} FROM den WHERE rank <= 20)
SELECT query, id, round(coalesce(b.rrf, 0) + 0.9 * coalesce(v.rrf, 0), 9) AS rrf, round(greatest(coalesce(b.retrieval, 0), 0.9 * coalesce(v.retrieval, 0)), 9) AS retrieval,
round(greatest(coalesce(b.gate, 0), 0.9 * coalesce(v.gate, 0)), 9) AS gate, round(greatest(coalesce(b.bm25, 0), coalesce(v.bm25, 0)), 9) AS bm25 FROM b FULL JOIN v USING (query, id)""")
def expansion_merge(spark, d):
    """The next query of the set stands for another wording of each query."""
    top = _top(spark, d, 20)
    sig = top.select("query", "id", F.round(1 / (60 + F.col("rank") - 1), 9).alias("rrf"), F.col("score").alias("retrieval"), F.col("score").alias("gate"), F.round(F.col("score") / 2, 9).alias("bm25"))
    return search.merge_expansion(sig, sig.withColumn("query", F.col("query") - 100))


_LABEL_TYPES = ["spec", "api", "manual", "warning", "guide", "faq", "doc", "web", "diagram", "chat"]


@query(f"""
WITH {DENSE_SQL}, w AS (SELECT query, id, score, CASE label {' '.join(f'WHEN {i} THEN {config.DEFAULT.source_weights[k]}' for i, k in enumerate(_LABEL_TYPES))} END AS weight FROM sc)
SELECT query, id, score, rank::INT AS rank FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY score DESC, id) AS rank FROM (SELECT query, id, round(score * weight, 6) AS score FROM w)) WHERE rank <= 5""")
def source_weighted_rank(spark, d):
    e = t(spark, d, "embeddings")
    q = e.where("vec_id % 100 = 0").select(F.col("vec_id").alias("query"), F.col("embedding").alias("qv"))
    kind = F.element_at(F.array(*map(F.lit, _LABEL_TYPES)), F.col("label") + 1)
    # the best of each type hold the best of all: a type's weight keeps their order
    best = [search.dense_top(e.where(kind == x), q, 5).withColumn("type", F.lit(x)) for x in _LABEL_TYPES]
    scored = reduce(DataFrame.unionByName, best).select("query", "id", F.round(F.col("score") * search.source_weight(F.col("type")), 6).alias("score"))
    return search.top_k(scored, 5)


_RISK = "risk AS (SELECT query, max(score) FILTER (rank = 1) AS top1, max(score) FILTER (rank = 2) AS top2 FROM den WHERE rank <= 2 GROUP BY query), risky AS (SELECT *, round(top1 - coalesce(top2, 0), 6) AS gap, round(top1 - coalesce(top2, 0), 6) < 0.05 OR top1 < 0.4 AS high_risk FROM risk)"
_NOSELF = DENSE_SQL.replace("FROM embeddings, q)", "FROM embeddings, q WHERE vec_id <> query)")


@query(f"WITH {_NOSELF}, {_RISK} SELECT query, top1, top2, gap, high_risk FROM risky")
def margin_risk(spark, d):
    return search.margin_risk(_top(spark, d, 2, skip_self=True))


@query(f"""
WITH {_NOSELF}, {_RISK}, s AS (SELECT query, label AS source, score, high_risk FROM den JOIN risky USING (query) WHERE rank <= 6),
a AS (SELECT query, count(DISTINCT source) AS sources, round(var_pop(score), 9) AS variance, bool_or(high_risk) AS risky FROM s GROUP BY query)
SELECT *, CASE WHEN sources > 3 AND variance < 0.02 THEN 'high' WHEN sources > 2 AND risky THEN 'medium' ELSE 'low' END AS pollution FROM a""")
def pollution_risk(spark, d):
    scored = reuse(_top(spark, d, 6, skip_self=True).drop("rank"))
    labels = t(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("label").alias("source"))
    return search.pollution_risk(search.top_k(scored, 6).join(labels, "id").join(search.margin_risk(scored).select("query", "high_risk"), "query"))


@query(f"WITH {DENSE_SQL}, p AS (SELECT * FROM den WHERE rank <= 12) SELECT query, id, CASE WHEN hi = lo THEN 1.0 ELSE round((score - lo) / (hi - lo), 6) END AS relevance FROM (SELECT *, min(score) OVER (PARTITION BY query) AS lo, max(score) OVER (PARTITION BY query) AS hi FROM p)")
def minmax_relevance(spark, d):
    return search.min_max(_top(spark, d, 12)).select("query", "id", "relevance")


@query(f"""
WITH {DENSE_SQL}, p AS (SELECT query, id, score, embedding AS v FROM den JOIN embeddings ON vec_id = id WHERE rank <= 12),
one AS (SELECT query, id, v FROM p QUALIFY row_number() OVER (PARTITION BY query ORDER BY score DESC, id) = 1),
r2 AS (SELECT p.query, p.id, p.score, p.v, {COS_SQL.format('p.v', 'one.v')} AS near FROM p JOIN one USING (query) WHERE p.id <> one.id),
two AS (SELECT * FROM r2 QUALIFY row_number() OVER (PARTITION BY query ORDER BY round(0.7 * score - 0.3 * near, 9) DESC, score DESC, id) = 1),
r3 AS (SELECT r2.query, r2.id, r2.score, greatest(r2.near, {COS_SQL.format('r2.v', 'two.v')}) AS near FROM r2 JOIN two USING (query) WHERE r2.id <> two.id),
three AS (SELECT * FROM r3 QUALIFY row_number() OVER (PARTITION BY query ORDER BY round(0.7 * score - 0.3 * near, 9) DESC, score DESC, id) = 1)
SELECT query, id, 1 AS pick FROM one UNION ALL SELECT query, id, 2 FROM two UNION ALL SELECT query, id, 3 FROM three""")
def mmr_select(spark, d):
    v = t(spark, d, "embeddings").select(F.col("vec_id").alias("id"), vectors.normalize(F.col("embedding")).alias("v"))
    return search.mmr(_top(spark, d, 12).join(v, "id"), 3)


@query("SELECT count(*) AS vectors, count(DISTINCT len(embedding)) AS dimensions, count(*) FILTER (embedding IS NULL) AS missing, count(*) FILTER (len(list_filter(embedding, lambda x: isnan(x) OR isinf(x))) > 0) AS not_finite, count(*) FILTER (len(list_filter(embedding, lambda x: x <> 0)) = 0) AS zero FROM embeddings")
def vector_validation(spark, d):
    return store.vector_health(t(spark, d, "embeddings"), "embedding")


@query("SELECT label, i::INT AS i, round(avg(x), 6) AS mean FROM (SELECT label, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) - 1 AS i FROM embeddings) GROUP BY label, i")
def centroid_mean(spark, d):
    return vectors.means(t(spark, d, "embeddings"), "label", "embedding")


# --- near and exact duplicates


@query(f"""
WITH w AS (SELECT doc_id AS id, {WORDS_SQL.format('text', '[a-z0-9_]+')} AS words FROM documents)
SELECT a.id AS a, b.id AS b, round(j, 6) AS jaccard FROM w a JOIN w b ON a.id < b.id AND len(a.words) > 0 AND len(b.words) > 0 AND least(len(a.words), len(b.words)) >= 0.85 * greatest(len(a.words), len(b.words)),
LATERAL (SELECT len(list_intersect(a.words, b.words)) AS i), LATERAL (SELECT i / (len(a.words) + len(b.words) - i) AS j) WHERE j >= 0.85""")
def jaccard_pairs(spark, d):
    return search.jaccard_pairs(t(spark, d, "documents"), config.DEFAULT.dedup_jaccard)


@query(f"""
WITH RECURSIVE w AS (SELECT doc_id AS id, {WORDS_SQL.format('text', '[a-z0-9_]+')} AS words FROM documents),
j AS (SELECT a.id AS a, b.id AS b, len(list_intersect(a.words, b.words)) AS i, len(a.words) + len(b.words) AS n FROM w a JOIN w b ON a.id < b.id AND len(a.words) > 0 AND len(b.words) > 0 AND least(len(a.words), len(b.words)) >= 0.85 * greatest(len(a.words), len(b.words))),
p AS MATERIALIZED (SELECT a, b FROM j WHERE i / (n - i) >= 0.85), v AS MATERIALIZED (SELECT id, early, row_number() OVER (ORDER BY id) AS r FROM (SELECT b AS id, list(a) AS early FROM p GROUP BY b)),
f AS (SELECT 0::BIGINT AS r, []::BIGINT[] AS gone UNION ALL SELECT v.r, CASE WHEN len(list_filter(early, lambda x: NOT list_contains(gone, x))) > 0 THEN list_append(gone, id) ELSE gone END FROM f JOIN v ON v.r = f.r + 1)
SELECT doc_id FROM documents WHERE NOT list_contains((SELECT gone FROM f ORDER BY r DESC LIMIT 1), doc_id)""")
def greedy_dedup(spark, d):
    docs = t(spark, d, "documents").select("doc_id", "text")
    return search.greedy_kept(docs, config.DEFAULT.dedup_jaccard).select("doc_id")


@query(f"""
WITH w AS (SELECT doc_id AS id, list_sort({WORDS_SQL.format('text', '[a-z0-9_]+')}) AS words FROM documents), c AS (SELECT words, min(id) AS rep, count(*) AS copies FROM w WHERE len(words) > 0 GROUP BY words),
j AS (SELECT a.rep AS a, b.rep AS b, a.copies AS ca, b.copies AS cb, len(list_intersect(a.words, b.words)) AS i, len(a.words) + len(b.words) AS n FROM c a JOIN c b ON a.rep < b.rep AND least(len(a.words), len(b.words)) >= 0.85 * greatest(len(a.words), len(b.words))),
p AS (SELECT a AS rep, cb AS n FROM j WHERE i / (n - i) >= 0.85 UNION ALL SELECT b, ca FROM j WHERE i / (n - i) >= 0.85)
SELECT c.rep, any_value(c.copies) AS copies, (any_value(c.copies) - 1 + coalesce(sum(p.n), 0))::BIGINT AS links FROM c LEFT JOIN p USING (rep) GROUP BY c.rep""")
def jaccard_classes(spark, d):
    return search.jaccard_classes(t(spark, d, "documents"), config.DEFAULT.dedup_jaccard)[0].drop("key")


@query("SELECT min(doc_id) AS doc_id, md5(text) AS digest, count(*) AS copies FROM documents GROUP BY text")
def exact_dedup_keep_first(spark, d):
    return t(spark, d, "documents").groupBy(F.md5(F.col("text").cast("binary")).alias("digest")).agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("copies"))


# --- lines, sections and chunks

_LINES = "l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS line_no FROM documents), o AS (SELECT *, coalesce(sum(length(line) + 1) OVER (PARTITION BY doc_id ORDER BY line_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start FROM l)"
_HEAD = r"(regexp_matches(trim(line), '^#{1,6}\s+\S') OR (length(trim(line)) BETWEEN 4 AND 99 AND upper(trim(line)) = trim(line) AND regexp_matches(trim(line), '\p{Lu}') AND regexp_matches(trim(line), '\S\s+\S')) OR (regexp_matches(trim(line), '^\d+\.[\d\.]*\s+\S') AND length(trim(line)) <= 99 AND NOT regexp_matches(trim(line), '[.。;；,，]$')))"


@query(f"WITH {_LINES} SELECT doc_id, line_no::INT AS line_no, start, length(line)::INT AS chars FROM o")
def line_offsets(spark, d):
    return ingest.line_offsets(t(spark, d, "documents")).select("doc_id", "line_no", "start", F.length("line").alias("chars"))


@query(f"""
WITH {_LINES}, h AS (SELECT doc_id, start, CASE WHEN regexp_matches(trim(line), '^#{{1,6}}\\s+\\S') THEN trim(regexp_extract(trim(line), '^#{{1,6}}\\s+(.+)$', 1)) ELSE trim(line) END AS title,
CASE WHEN starts_with(trim(line), '### ') THEN 3 WHEN starts_with(trim(line), '## ') THEN 2 WHEN starts_with(trim(line), '# ') THEN 1 WHEN upper(trim(line)) = trim(line) AND regexp_matches(trim(line), '\\p{{Lu}}') THEN 1 ELSE 2 END AS level FROM o WHERE {_HEAD}),
e AS (SELECT * FROM h UNION ALL SELECT doc_id, 0, '', 0 FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM h WHERE start = 0))
SELECT doc_id, (row_number() OVER w - 1)::INT AS section, title, level::INT AS level, start, coalesce(lead(start) OVER w, length(text))::BIGINT AS "end" FROM e JOIN documents USING (doc_id) WINDOW w AS (PARTITION BY doc_id ORDER BY start)""")
def section_spans(spark, d):
    return ingest.sections(t(spark, d, "documents"))


_FIXED = "c AS (SELECT doc_id, source, text, unnest(generate_series(0, greatest(ceil(length(text) / 1000), 1)::INT - 1)) AS k FROM documents), f AS (SELECT doc_id, source, k::INT AS chunk_index, substr(text, k * 1000 + 1, 1000) AS content FROM c)"


@query(f"""
WITH {_LINES}, {_FIXED}, h AS (SELECT doc_id, start FROM o WHERE {_HEAD}), e AS (SELECT * FROM h UNION ALL SELECT doc_id, 0 FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM h WHERE start = 0)),
s AS (SELECT doc_id, start, row_number() OVER (PARTITION BY doc_id ORDER BY start) - 1 AS section FROM e)
SELECT f.doc_id, chunk_index, max(section)::INT AS section FROM f JOIN s ON f.doc_id = s.doc_id AND s.start <= chunk_index * 1000 GROUP BY ALL""")
def section_containment(spark, d):
    docs = t(spark, d, "documents")
    points = ingest.fixed_chunks(docs, 1000).select("doc_id", "chunk_index", (F.col("chunk_index") * 1000).cast("long").alias("start"))
    return ingest.contained_in(points, ingest.sections(docs).select("doc_id", "start", "section"), "doc_id").select("doc_id", "chunk_index", "section")


@query()
def semantic_chunks(spark, d):
    return ingest.semantic_chunks(t(spark, d, "documents"))


@query(f"WITH {_FIXED} SELECT doc_id, chunk_index, md5(CASE WHEN b IS NULL THEN content ELSE right(b, 100) || chr(10) || content END) AS digest FROM (SELECT *, lag(content) OVER (PARTITION BY doc_id ORDER BY chunk_index) AS b FROM f)")
def chunk_overlap(spark, d):
    return ingest.with_overlap(ingest.fixed_chunks(t(spark, d, "documents"), 1000), 100).select("doc_id", "chunk_index", F.md5(F.col("content").cast("binary")).alias("digest"))


@query(f"WITH {_FIXED} SELECT doc_id, chunk_index, source || '::p1::c' || chunk_index || '::' || left(md5(content), 8) AS chunk_id FROM f")
def chunk_ids(spark, d):
    docs = t(spark, d, "documents")
    chunks = ingest.fixed_chunks(docs, 1000).join(docs.select("doc_id", "source"), "doc_id")
    return chunks.select("doc_id", "chunk_index", text.chunk_key(F.col("source"), F.lit(1), F.col("chunk_index"), F.col("content")).alias("chunk_id"))


@query(f"WITH {_FIXED} SELECT doc_id, min(chunk_index) AS first, max(chunk_index) AS last, md5(string_agg(content, chr(10) ORDER BY chunk_index)) AS digest FROM (SELECT *, chunk_index // 2 AS g FROM f) GROUP BY doc_id, g")
def adjacent_merge(spark, d):
    merged = ingest.merge_adjacent(ingest.fixed_chunks(t(spark, d, "documents"), 1000), ["doc_id"], 2001)
    return merged.select("doc_id", "first", "last", F.md5(F.col("content").cast("binary")).alias("digest"))


@query("""
WITH RECURSIVE d AS (SELECT source, doc_id, length(text) AS z, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS rn FROM documents),
r AS (SELECT source, doc_id, rn, 0 AS batch, 1 AS n, z AS used FROM d WHERE rn = 1 UNION ALL
SELECT d.source, d.doc_id, d.rn, CASE WHEN r.n >= 32 OR r.used + d.z > 20000 THEN r.batch + 1 ELSE r.batch END, CASE WHEN r.n >= 32 OR r.used + d.z > 20000 THEN 1 ELSE r.n + 1 END, CASE WHEN r.n >= 32 OR r.used + d.z > 20000 THEN d.z ELSE r.used + d.z END
FROM r JOIN d ON d.source = r.source AND d.rn = r.rn + 1) SELECT source, doc_id, batch FROM r""")
def embed_batches(spark, d):
    return ingest.greedy_batches(t(spark, d, "documents").select("source", "doc_id", F.length("text").alias("z")), "source", "doc_id", "z").withColumn("batch", F.col("batch").cast("int"))


# --- pages


@query("SELECT page_id, regexp_extract(html, '(?i)<title[^>]*>([^<]+)</title>', 1) AS title FROM pages")
def page_titles(spark, d):
    return t(spark, d, "pages").select("page_id", text.page_title("html").alias("title"))


@query(r"""
WITH u AS (SELECT page_id, url, translate(replace(regexp_extract(url, '^[a-zA-Z][a-zA-Z0-9+.\-]*://([^/?#]*)', 1), 'www.', ''), '.:', '__') AS host, regexp_extract(regexp_extract(url, '^[a-zA-Z][a-zA-Z0-9+.\-]*://[^/?#]*([^?#]*)', 1), '([^/]+)/*$', 1) AS last FROM pages)
SELECT page_id, CASE WHEN last = '' THEN host ELSE host || '_' || regexp_replace(last, '[^\p{L}\p{N}_\-]', '_', 'g') END AS name FROM u""")
def url_names(spark, d):
    return t(spark, d, "pages").select("page_id", text.url_name("url").alias("name"))


def _markdown_sql(column: str) -> str:
    for pattern, by in text.MARKDOWN_STEPS:
        to = re.sub(r"\$(\d)", r"\\\1", by).replace("\n", "' || chr(10) || '").replace("'" * 2 + " || chr(10)", "'' || chr(10)")
        column = f"regexp_replace({column}, {_quote(pattern)}, '{to if by != chr(39) else chr(39) * 2}', 'g')"
    return column


@query(f"""
WITH l AS (SELECT page_id, unnest(string_split({_markdown_sql('html')}, chr(10))) AS line, generate_subscripts(string_split({_markdown_sql('html')}, chr(10)), 1) AS n FROM pages), s AS (SELECT *, trim(line) AS s FROM l),
r AS (SELECT *, sum((s <> '')::INT) OVER (PARTITION BY page_id ORDER BY n) AS run FROM s), k AS (SELECT *, row_number() OVER (PARTITION BY page_id, run, s = '' ORDER BY n) AS nth FROM r)
SELECT page_id, md5(trim(coalesce(string_agg(line, chr(10) ORDER BY n), ''))) AS digest, count(*) AS lines FROM k WHERE CASE WHEN s = '' THEN nth <= 2 ELSE NOT regexp_matches(s, {_quote('(?i)' + '|'.join(ingest.NOISE_LINES))}) AND (length(s) >= 3 OR starts_with(s, '#')) END GROUP BY page_id""")
def html_clean(spark, d):
    clean = ingest.clean_lines(t(spark, d, "pages").select("page_id", text.html_to_markdown("html").alias("plain")), "page_id", "plain")
    return clean.select("page_id", F.md5(F.col("content").cast("binary")).alias("digest"), "lines")


# --- stores


@query("SELECT source, count(*) AS n, sum(length(text))::BIGINT AS chars FROM (SELECT source, text FROM documents WHERE source NOT IN (SELECT source FROM documents WHERE doc_id % 97 = 0) UNION ALL SELECT source, text || '!' FROM documents WHERE doc_id % 97 = 0) GROUP BY source")
def kb_upsert(spark, d):
    docs = t(spark, d, "documents").select("source", "text")
    new = t(spark, d, "documents").where("doc_id % 97 = 0").select("source", F.concat("text", F.lit("!")).alias("text"))
    return store.upsert(docs, new, "source").groupBy("source").agg(F.count("*").alias("n"), F.sum(F.length("text")).alias("chars"))


@query("SELECT doc_id FROM documents WHERE source NOT IN (SELECT source FROM documents WHERE doc_id % 97 = 0)")
def kb_delete(spark, d):
    docs = t(spark, d, "documents")
    return store.remove(docs, "source", docs.where("doc_id % 97 = 0")).select("doc_id")


@query("SELECT count(*) FILTER (b.doc_id IS NULL) AS only_a, count(*) FILTER (a.doc_id IS NULL) AS only_b, count(*) FILTER (a.doc_id IS NOT NULL AND b.doc_id IS NOT NULL) AS both, count(*) FILTER (a.doc_id IS NOT NULL AND b.doc_id IS NOT NULL AND a.text <> b.text) AS diff_text, count(*) FILTER (a.doc_id IS NOT NULL AND b.doc_id IS NOT NULL AND a.lang <> b.lang) AS diff_lang FROM (SELECT * FROM documents WHERE doc_id % 10 <> 1) a FULL JOIN (SELECT doc_id, CASE WHEN doc_id % 7 = 0 THEN text || '!' ELSE text END AS text, lang FROM documents WHERE doc_id % 10 <> 2) b ON a.doc_id = b.doc_id")
def kb_diff(spark, d):
    docs = t(spark, d, "documents").select("doc_id", "text", "lang")
    b = docs.where("doc_id % 10 <> 2").withColumn("text", F.when(F.col("doc_id") % 7 == 0, F.concat("text", F.lit("!"))).otherwise(F.col("text")))
    return store.diff(docs.where("doc_id % 10 <> 1"), b, ["doc_id"], ["text", "lang"])


@query("SELECT source, count(*) AS chunks, count(*) FILTER (coalesce(length(text), 0) = 0) AS empty, count(*) FILTER (length(text) < 50) AS short, count(DISTINCT text) AS distinct_texts, sum(length(text))::BIGINT AS chars FROM documents GROUP BY source")
def kb_audit(spark, d):
    return store.audit(t(spark, d, "documents"), "source", "text")


@query("""
WITH r AS (SELECT source, lpad(length(text)::VARCHAR, 8, '0') || md5(text) AS d, row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1 AS n FROM documents),
b AS (SELECT source, n // 4096 AS block, count(*) AS n, md5(string_agg(d, '' ORDER BY n)) AS d FROM r GROUP BY source, n // 4096)
SELECT source, sum(n)::BIGINT AS n, md5(string_agg(d, '' ORDER BY block)) AS digest FROM b GROUP BY source""")
def content_digest(spark, d):
    return store.content_digest(t(spark, d, "documents"), "source", ["doc_id"], "text")


@query("SELECT count(*) AS misses FROM (SELECT DISTINCT md5(text) AS m FROM documents) WHERE m NOT IN (SELECT md5(text) FROM documents WHERE doc_id % 3 = 0)")
def embedding_cache_misses(spark, d):
    docs = t(spark, d, "documents")
    cache = docs.where("doc_id % 3 = 0").select(F.md5(F.col("text").cast("binary")).alias("md5")).distinct()
    return store.misses(docs, cache).agg(F.count("*").alias("misses"))


@query("SELECT coalesce(a.path, b.path) AS path, CASE WHEN a.path IS NULL THEN 'added' WHEN b.path IS NULL THEN 'deleted' ELSE 'changed' END AS change FROM (SELECT 'f' || doc_id AS path, md5(text) AS h FROM documents WHERE doc_id % 10 <> 1) a FULL JOIN (SELECT 'f' || doc_id AS path, CASE WHEN doc_id % 7 = 0 THEN md5(text || '!') ELSE md5(text) END AS h FROM documents WHERE doc_id % 10 <> 2) b ON a.path = b.path WHERE a.h IS DISTINCT FROM b.h")
def changed_files(spark, d):
    f = t(spark, d, "documents").select("doc_id", F.concat(F.lit("f"), "doc_id").alias("path"), "text")
    old = f.where("doc_id % 10 <> 1").select("path", F.md5(F.col("text").cast("binary")).alias("hash"))
    new = f.where("doc_id % 10 <> 2").select("path", F.md5(F.when(F.col("doc_id") % 7 == 0, F.concat("text", F.lit("!"))).otherwise(F.col("text")).cast("binary")).alias("hash"))
    return graph.changed_files(old, new)


@query("SELECT user_id, scope, project, review_by::VARCHAR AS review_by FROM (SELECT user_id, CASE WHEN user_id % 5 = 0 THEN 'global' ELSE 'project' END AS scope, 'p' || (user_id % 3) AS project, max(ts)::DATE AS review_by FROM events GROUP BY user_id) WHERE (scope = 'global' OR project = 'p1') AND review_by >= DATE '2024-01-30'")
def lessons_active(spark, d):
    return store.active_rules(_rules(spark, d), "p1", F.to_date(F.lit("2024-01-30"))).withColumn("review_by", F.col("review_by").cast("string"))


def _rules(spark: SparkSession, d: str) -> DataFrame:
    """Rules made of the users: one each, of a project or global, to be reviewed on the user's last day."""
    e = t(spark, d, "events").groupBy("user_id").agg(F.to_date(F.max("ts")).alias("review_by"))
    return e.select("user_id", F.when(F.col("user_id") % 5 == 0, "global").otherwise("project").alias("scope"), F.concat(F.lit("p"), F.col("user_id") % 3).alias("project"), "review_by")


@query("WITH r AS (SELECT user_id, CASE WHEN user_id % 5 = 0 THEN 'global' ELSE 'project' END AS scope, 'p' || (user_id % 3) AS project, max(ts)::DATE AS review_by FROM events GROUP BY user_id), l AS (SELECT * FROM r WHERE review_by >= DATE '2024-01-30') SELECT project, count(*) + (SELECT count(*) FROM l WHERE scope = 'global') AS active FROM l WHERE scope <> 'global' GROUP BY project HAVING count(*) + (SELECT count(*) FROM l WHERE scope = 'global') > 20")
def lesson_caps(spark, d):
    return store.over_cap(_rules(spark, d), F.to_date(F.lit("2024-01-30")))


# --- code graph


@query(f"""WITH {samples.files_sql()} SELECT path, name, 'function' AS kind, name AS qualified_name, line::INT AS start_line, (line + 3)::INT AS end_line,
CASE WHEN python THEN name || '(a)' ELSE 'function ' || name || '(a) {{' END AS signature, CASE WHEN python THEN substr(name, 3) || ' of ' || coalesce(source, '') ELSE '' END AS docstring, CASE WHEN python THEN 'ast' ELSE 'regex' END AS backend FROM def""")
def code_symbols(spark, d):
    return graph.symbols(samples.files(spark, d))


@query(f"WITH {samples.files_sql()}, {samples.CALLS_SQL}, {samples.RESOLVED_SQL}")
def call_resolution(spark, d):
    f = samples.files(spark, d)
    nodes = reuse(graph.symbols(f))
    return graph.resolve_placed(nodes, graph.placed(nodes, graph.calls(f))).drop("attribute")


@query(f"WITH {samples.files_sql()} SELECT name AS callee, path, path || '::' || name AS dst FROM def QUALIFY count(*) OVER (PARTITION BY name) > 1")
def ambiguous_targets(spark, d):
    return graph.ambiguous_targets(graph.symbols(samples.files(spark, d)))


@query(f"WITH {samples.files_sql('doc_id % 100 = 0')}, {samples.CALLS_SQL}, {samples.RESOLVED_SQL}")
def graph_update(spark, d):
    """The graph after the files of documents whose number is divisible by 100 have changed; the SQL builds it anew."""
    old, new = (reuse(samples.files(spark, d, order)) for order in (None, F.col("doc_id") % 100 == 0))  # small files of large texts, read often
    nodes = reuse(graph.symbols(old))
    edges = graph.resolve_placed(nodes, graph.placed(nodes, graph.calls(old)))
    digest = lambda f: f.select("path", F.md5(F.col("content").cast("binary")).alias("hash"))
    return graph.update_graph(nodes, edges, new, graph.changed_files(digest(old), digest(new)))[1].drop("attribute")


def _supply(spark: SparkSession, d: str) -> DataFrame:
    """A large bipartite graph: parts and the suppliers that delivered them, an edge for each delivery."""
    return t(spark, d, "lineitem").select(F.concat(F.lit("p"), "l_partkey").alias("src"), F.concat(F.lit("s"), "l_suppkey").alias("dst"))


_EDGES = "e AS (SELECT DISTINCT 'p' || l_partkey AS a, 's' || l_suppkey AS b FROM lineitem), u AS (SELECT a, b FROM e UNION SELECT b, a FROM e)"


@query(f"""
WITH {_EDGES}, s AS (SELECT DISTINCT 's' || s_suppkey AS seed FROM supplier), n1 AS (SELECT DISTINCT seed, b AS node FROM s JOIN u ON seed = a), n2 AS (SELECT DISTINCT seed, b AS node FROM n1 JOIN u ON node = a),
x AS (SELECT seed, node, min(hop) AS hop FROM (SELECT seed, node, 1 AS hop FROM n1 UNION ALL SELECT seed, node, 2 FROM n2 UNION ALL SELECT seed, seed, 0 FROM s) GROUP BY ALL)
SELECT seed, node, hop FROM (SELECT *, row_number() OVER (PARTITION BY seed ORDER BY hop, node) AS rn FROM x WHERE hop > 0) WHERE rn <= 50""")
def graph_neighbors(spark, d):
    seeds = t(spark, d, "supplier").select(F.concat(F.lit("s"), "s_suppkey").alias("seed"), F.concat(F.lit("s"), "s_suppkey").alias("node"))
    return graph.neighbors(_supply(spark, d), seeds, 2)


@query("""
WITH RECURSIVE e AS (SELECT DISTINCT c.c_nationkey AS a, s.s_nationkey AS b FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer c ON o_custkey = c_custkey JOIN supplier s ON l_suppkey = s_suppkey),
q AS (SELECT a.n_nationkey AS src, b.n_nationkey AS dst FROM nation a, nation b WHERE a.n_nationkey <> b.n_nationkey), p AS (SELECT src, dst, [src] AS path FROM q UNION ALL SELECT src, dst, list_append(path, b) FROM p JOIN e ON path[-1] = a WHERE NOT list_contains(path, b) AND len(path) <= 2 AND path[-1] <> dst)
SELECT src, dst, array_to_string(path, ' > ') AS path, len(path)::INT - 1 AS hops FROM p WHERE path[-1] = dst QUALIFY row_number() OVER (PARTITION BY src, dst ORDER BY len(path), array_to_string(path, ' ')) <= 3""")
def graph_paths(spark, d):
    e = t(spark, d, "lineitem").join(t(spark, d, "orders"), F.col("l_orderkey") == F.col("o_orderkey")).join(t(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey")).join(t(spark, d, "supplier"), F.col("l_suppkey") == F.col("s_suppkey"))
    edges = e.select(F.col("c_nationkey").alias("src"), F.col("s_nationkey").alias("dst")).distinct()
    n = t(spark, d, "nation").select("n_nationkey")
    pairs = n.select(F.col("n_nationkey").alias("src")).crossJoin(bounded(n.select(F.col("n_nationkey").alias("dst")))).where("src <> dst")
    return graph.paths(edges, pairs, 2)


_HYB = "(p_partkey * 31 % 97) / 96.0"
_LEX = "(p_partkey * 17 % 11) / 10.0"


@query(f"""SELECT p_partkey, round(CASE WHEN p_partkey % 13 = 0 THEN 0.95 WHEN {_LEX} >= 0.8 AND p_size >= 2 THEN 0.9 + 0.1 * {_LEX}
ELSE CASE WHEN p_brand <> 'Brand#5' THEN 0.5 * {_HYB} + 0.5 * {_LEX} ELSE {_HYB} END + CASE WHEN p_type = 'ECONOMY' THEN 0.05 ELSE 0 END END, 6)::DOUBLE AS score FROM part""")
def hybrid_symbol_score(spark, d):
    kind = F.when(F.col("p_type") == "ECONOMY", "function").otherwise("class")
    score = code.hybrid_score(F.col("p_partkey") * 31 % 97 / 96.0, F.col("p_partkey") * 17 % 11 / 10.0, kind, F.col("p_partkey") % 13 == 0, F.col("p_size"), F.col("p_brand") != "Brand#5")
    return t(spark, d, "part").select("p_partkey", F.round(score, 6).alias("score"))


# --- evidence ranges and figures


@query("""
WITH r AS (SELECT l_suppkey AS k, date_diff('day', DATE '1992-01-01', l_shipdate::DATE) AS s, l_quantity::INT AS q FROM lineitem), x AS (SELECT k, s AS start, s + q % 5 AS "end", q AS priority FROM r),
m AS (SELECT *, CASE WHEN start <= max("end") OVER (PARTITION BY k ORDER BY start, "end" ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) + 1 THEN 0 ELSE 1 END AS new FROM x),
i AS (SELECT *, sum(new) OVER (PARTITION BY k ORDER BY start, "end" ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS isle FROM m)
SELECT k AS suppkey, min(start)::INT AS start, max("end")::INT AS "end", count(*) AS n, max(priority) AS priority FROM i GROUP BY k, isle""")
def range_merge(spark, d):
    day = F.datediff(F.to_date("l_shipdate"), F.to_date(F.lit("1992-01-01")))
    r = t(spark, d, "lineitem").select(F.col("l_suppkey").alias("suppkey"), day.alias("start"), (day + F.col("l_quantity").cast("int") % 5).alias("end"), F.col("l_quantity").cast("int").alias("priority"))
    return context.merge_ranges(r, ["suppkey"])


@query("""
WITH c AS (SELECT p_brand AS g, p_type AS path, p_partkey AS start, p_partkey AS "end", p_size AS priority FROM part), v AS (SELECT *, priority - 12 * (row_number() OVER (PARTITION BY g, path ORDER BY priority DESC, start, "end") - 1) AS value FROM c)
SELECT start AS partkey, row_number() OVER (PARTITION BY g ORDER BY value DESC, path, start, "end")::INT AS place FROM v""")
def file_diversity(spark, d):
    c = t(spark, d, "part").select(F.col("p_brand").alias("g"), F.col("p_type").alias("path"), F.col("p_partkey").alias("start"), F.col("p_partkey").alias("end"), F.col("p_size").alias("priority"))
    return context.diversify(c, "g").select(F.col("start").alias("partkey"), "place")


@query("SELECT doc_id, source FROM (SELECT doc_id, source, sum(length(text)) OVER (PARTITION BY source ORDER BY length(text), doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS running FROM documents) WHERE running <= 12000")
def budget_pack(spark, d):
    rows = t(spark, d, "documents").select("doc_id", "source", F.length("text").alias("z"))
    return context.pack(rows, "source", ["z", "doc_id"], "z", 12000).select("doc_id", "source")


@query("WITH n AS (SELECT DISTINCT user_id, day(ts)::INT AS v FROM events WHERE event_type = 'purchase'), g AS (SELECT *, v - row_number() OVER (PARTITION BY user_id ORDER BY v) AS g FROM n), p AS (SELECT user_id, min(v) AS a, max(v) AS b FROM g GROUP BY user_id, g) SELECT user_id, string_agg(CASE WHEN a = b THEN a::VARCHAR ELSE a || '-' || b END, ', ' ORDER BY a) AS ranges FROM p GROUP BY user_id")
def page_ranges(spark, d):
    days = t(spark, d, "events").where("event_type = 'purchase'").select("user_id", F.dayofmonth("ts").alias("v"))
    return context.number_ranges(days, "user_id", "v")


_PARTS = "p AS (SELECT l_orderkey AS figure, CASE l_linenumber % 7 WHEN 0 THEN NULL WHEN 1 THEN 'native_verified' WHEN 2 THEN 'corroborated' WHEN 3 THEN 'human_verified' WHEN 4 THEN 'unverified' WHEN 5 THEN 'strange' ELSE 'native_verified' END AS status, l_returnflag, l_linestatus, l_quantity FROM lineitem)"


@query(f"""
WITH {_PARTS}, r AS (SELECT *, greatest(coalesce(list_position(['needs_review', 'legacy_unverified', 'unverified', 'corroborated', 'native_verified', 'human_verified'], coalesce(status, 'legacy_unverified')), 0) - 1, 0) AS rk FROM p)
SELECT figure, count(*) AS parts, bool_and(l_linestatus = 'O') AS complete, ['needs_review', 'legacy_unverified', 'unverified', 'corroborated', 'native_verified', 'human_verified'][min(rk) + 1] AS worst, string_agg(DISTINCT l_returnflag, ',' ORDER BY l_returnflag) AS reasons, count(DISTINCT l_quantity) AS revisions FROM r GROUP BY figure""")
def trust_aggregate(spark, d):
    n = F.col("l_linenumber") % 7
    status = F.when(n == 1, "native_verified").when(n == 2, "corroborated").when(n == 3, "human_verified").when(n == 4, "unverified").when(n == 5, "strange").when(n == 6, "native_verified")
    parts = t(spark, d, "lineitem").select(F.col("l_orderkey").alias("figure"), status.alias("status"), F.when(F.col("l_linestatus") == "O", "complete").otherwise("partial").alias("extraction"), F.array("l_returnflag").alias("reasons"), F.col("l_quantity").alias("revision"))
    return figures.trust(parts, "figure")


_BOXES = "b AS (SELECT p_size AS page, p_partkey AS id, (p_partkey * 37 % 500)::DOUBLE AS x0, (p_partkey * 53 % 700)::DOUBLE AS y0, p_partkey * 37 % 500 + 40.0 + p_partkey % 90 AS x1, p_partkey * 53 % 700 + 30.0 + p_partkey % 70 AS y1 FROM part)"


@query(f"""
WITH {_BOXES}, i AS (SELECT a.page, a.id AS a, c.id AS b, greatest(least(a.x1, c.x1) - greatest(a.x0, c.x0), 0) * greatest(least(a.y1, c.y1) - greatest(a.y0, c.y0), 0) AS o, (a.x1 - a.x0) * (a.y1 - a.y0) + (c.x1 - c.x0) * (c.y1 - c.y0) AS s FROM b a JOIN b c ON a.page = c.page AND a.id < c.id)
SELECT page, a, b, round(o / (s - o), 6) AS iou FROM i WHERE o / (s - o) >= 0.3""")
def iou_pairs(spark, d):
    k = F.col("p_partkey")
    b = t(spark, d, "part").select(F.col("p_size").alias("page"), k.alias("id"), (k * 37 % 500).cast("double").alias("x0"), (k * 53 % 700).cast("double").alias("y0"), (k * 37 % 500 + 40.0 + k % 90).alias("x1"), (k * 53 % 700 + 30.0 + k % 70).alias("y1"))
    return figures.iou_pairs(b, 0.3)


# --- metrics


_REL = "rel AS (SELECT query, id, CASE WHEN id % 2 = 0 THEN 2 ELSE 1 END AS grade FROM sc WHERE label = qlabel)"


@query(f"""
WITH {DENSE_SQL}, {_REL}, got AS (SELECT rel.query, count(*) FILTER (rank <= 10) / count(*) AS recall, coalesce(1 / min(rank), 0) AS rr, coalesce(sum((2 ** grade - 1) / log2(rank + 1)) FILTER (rank <= 10), 0) AS dcg FROM rel LEFT JOIN (SELECT query, id, rank FROM den WHERE rank <= 20) r ON r.query = rel.query AND r.id = rel.id GROUP BY rel.query),
ideal AS (SELECT query, sum((2 ** grade - 1) / log2(ir + 1)) AS idcg FROM (SELECT query, grade, row_number() OVER (PARTITION BY query ORDER BY grade DESC, id) AS ir FROM rel) WHERE ir <= 10 GROUP BY query)
SELECT query, round(recall, 6) AS recall, round(rr, 6) AS rr, round(dcg / idcg, 6) AS ndcg FROM got JOIN ideal USING (query)""")
def recall_mrr_ndcg(spark, d):
    return evalm.ranking_metrics(_top(spark, d, 20), _relevant(spark, d), 10)


def _relevant(spark: SparkSession, d: str) -> DataFrame:
    e = t(spark, d, "embeddings")
    q = e.where("vec_id % 100 = 0").select(F.col("vec_id").alias("query"), "label")
    return e.join(q, "label").select("query", F.col("vec_id").alias("id"), F.when(F.col("vec_id") % 2 == 0, 2).otherwise(1).alias("grade"))


@query("SELECT lang AS family, count(*) AS cases, round(avg(quality), 4) AS quality, round(avg(toxic), 4) AS toxic FROM documents JOIN labels USING (doc_id) GROUP BY lang")
def family_summary(spark, d):
    rows = t(spark, d, "documents").join(t(spark, d, "labels"), "doc_id").withColumnRenamed("lang", "family")
    return evalm.family_summary(rows, "family", ["quality", "toxic"])


@query("SELECT *, round(high - low, 6) AS range, std > 0.1 AS unstable FROM (SELECT user_id, count(*) AS runs, round(avg(value), 6) AS mean, round(stddev_pop(value), 6) AS std, min(value) AS low, max(value) AS high FROM events GROUP BY user_id)")
def stability(spark, d):
    return evalm.stability(t(spark, d, "events"), "user_id", "value")


@query("WITH f AS (SELECT l_partkey AS src, l_suppkey AS dst FROM lineitem WHERE l_discount < 0.05), g AS (SELECT DISTINCT l_partkey AS src, l_suppkey AS dst FROM lineitem WHERE l_tax < 0.04) SELECT (SELECT count(*) FROM f) AS found, (SELECT count(*) FROM g) AS gold, round((SELECT count(*) FROM f SEMI JOIN g USING (src, dst)) / (SELECT count(*) FROM f), 6) AS \"precision\", round((SELECT count(*) FROM g SEMI JOIN f USING (src, dst)) / (SELECT count(*) FROM g), 6) AS recall")
def graph_precision(spark, d):
    e = t(spark, d, "lineitem").withColumnsRenamed({"l_partkey": "src", "l_suppkey": "dst"})
    return evalm.edge_precision(e.where("l_discount < 0.05").select("src", "dst"), e.where("l_tax < 0.04").select("src", "dst"))


# --- scans, search over lines, streams and glue


@query(r"""
WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS line_no FROM documents), h AS (SELECT *, regexp_matches(line, '\d{3,}') AS hit FROM l),
n AS (SELECT *, max(hit::INT) OVER (PARTITION BY doc_id ORDER BY line_no ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING) AS near FROM h)
SELECT doc_id, line_no::INT AS line_no, left(line, 500) AS line, hit FROM n WHERE near = 1""")
def grep_lines(spark, d):
    lines = t(spark, d, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("line_no", "line"))
    return readers.within_budget(readers.grep(lines, r"\d{3,}", 1, "doc_id"), "doc_id", ["line_no"])


@query()
def binary_report(spark, d):
    f = readers.heads(spark, d, readers.SCAN, "*.parquet")
    return f.select(F.regexp_extract("path", r"([^/]+)$", 1).alias("name"), F.to_json(readers.magics(F.col("head"))).alias("magics"), readers.hex_dump(F.col("head"), 1).alias("head"))


@query("WITH e AS (SELECT user_id, ts, value, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS new FROM events), s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS k FROM (SELECT * FROM e ORDER BY user_id, ts)) SELECT user_id, min(ts) AS start, max(ts) + INTERVAL 30 MINUTE AS \"end\", count(*) AS events, round(sum(value), 6) AS value FROM s GROUP BY user_id, k")
def events_sessions(spark, d):
    s = streaming.sessions(t(spark, d, "events"))
    return s.withColumn("start", F.col("start").cast("timestamp_ntz")).withColumn("end", F.col("end").cast("timestamp_ntz"))


@query("SELECT r_name, n_name, o_orderpriority, sum(l_extendedprice * (1 - l_discount)) AS revenue, count(*) AS n FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY ROLLUP (r_name, n_name, o_orderpriority)".replace("sum(l_extendedprice * (1 - l_discount))", "round(sum(l_extendedprice * (1 - l_discount)), 2)"))
def star_join_rollup(spark, d):
    j = t(spark, d, "lineitem").join(t(spark, d, "orders"), F.col("l_orderkey") == F.col("o_orderkey")).join(t(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey")).join(t(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).join(t(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return j.rollup("r_name", "n_name", "o_orderpriority").agg(F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("revenue"), F.count("*").alias("n"))



# --- whole plans


def _chunks(spark: SparkSession, d: str) -> DataFrame:
    """documents as chunks; the tables share no key, so a document takes the vector whose id is its own modulo their number."""
    e = t(spark, d, "embeddings")
    n = e.count()
    docs = t(spark, d, "documents").withColumn("vec_id", F.col("doc_id") % n)
    cols = [F.col("doc_id").alias("id"), "source", F.when(F.col("doc_id") % 3 == 0, "spec").otherwise("doc").alias("type"), F.lit(1).alias("page"), F.col("doc_id").cast("int").alias("chunk_index"), F.lit("").alias("section"), F.col("text").alias("content"), "v"]
    return docs.join(e.select("vec_id", F.col("embedding").alias("v")), "vec_id").select(*cols)


def _questions(spark: SparkSession, d: str) -> DataFrame:
    """Every benchmark item as a question, with the vector of its id modulo their number."""
    e = t(spark, d, "embeddings")
    n = e.count()
    q = t(spark, d, "benchmark").select(F.col("item_id").alias("query"), F.col("text").alias("question"), (F.col("item_id") % n).alias("vec_id"))
    return q.join(e.select("vec_id", F.col("embedding").alias("qv")), "vec_id").drop("vec_id")


@query()
def query_knowledge(spark, d):
    return knowledge.search_knowledge(_chunks(spark, d), _questions(spark, d)).select("query", "ref", "id", "source", "score", "gate")


@query()
def query_decisions(spark, d):
    q = _questions(spark, d)
    return knowledge.decide(q, knowledge.search_knowledge(_chunks(spark, d), q))


def _code_questions(spark, d):
    """A question after the first function of each file whose document's number is divisible by 100."""
    name = F.regexp_extract("content", r"f_(\w+)", 1)
    return samples.files(spark, d).where("doc_id % 100 = 0").select(F.col("doc_id").alias("query"), name.alias("name"), F.concat(F.lit("where is f_"), name, F.lit(" defined")).alias("question")).where("name <> ''")


@query()
def code_search(spark, d):
    return knowledge.search_symbols(reuse(graph.symbols(samples.files(spark, d))), _code_questions(spark, d).drop("name"))


@query()
def code_search_lazy(spark, d):
    """Half of the questions share words with symbols, the others go over all vectors; vectors are those of the documents' numbers."""
    e = t(spark, d, "embeddings")
    n = e.count()
    of = e.select((F.col("vec_id") % n).alias("vec_id"), F.col("embedding").alias("v"))
    symbols = reuse(graph.symbols(samples.files(spark, d)))
    doc = F.regexp_extract("path", r"(\d+)\.", 1).cast("long")
    ids = symbols.select((doc * 3 + F.floor((F.col("start_line") - 1) / samples.LINES)).alias("id"), "path", "name", "kind", "start_line", (doc % n).alias("vec_id"))
    asked = _code_questions(spark, d).withColumn("question", F.when(F.col("query") % 200 == 0, F.concat(F.lit("qqq"), F.col("query").cast("string"))).otherwise(F.col("question")))
    questions = asked.withColumn("vec_id", F.col("query") % n).join(of.withColumnRenamed("v", "qv"), "vec_id").select("query", "question", "qv")
    return knowledge.search_symbols_lazily(symbols, questions, reuse(ids.join(of, "vec_id")))


@query()
def code_context(spark, d):
    """Evidence for each question: the definitions that search finds, under a budget of 400 characters."""
    f = samples.files(spark, d)
    nodes = reuse(graph.symbols(f))
    hits = knowledge.search_symbols(nodes, _code_questions(spark, d).drop("name")).join(nodes.select("path", "name", "start_line", "end_line"), ["path", "name", "start_line"])
    return knowledge.code_evidence(hits.select("query", "path", F.col("start_line").alias("start"), F.col("end_line").alias("end"), F.lit(60).alias("priority")), f, 400)


@query("SELECT page_id, len(string_split(regexp_extract(url, '^[a-z]+://[^/?#]*([^?#]*)', 1), '/'))::INT - 1 AS depth, regexp_matches(url, '\\?') AS has_query FROM pages")
def url_depth(spark, d):
    return t(spark, d, "pages").select("page_id", (F.size(F.split(F.regexp_extract("url", r"^[a-z]+://[^/?#]*([^?#]*)", 1), "/")) - 1).alias("depth"), F.col("url").rlike(r"\?").alias("has_query"))


@query("SELECT event_id, least(coalesce(list_max(list_filter(generate_series(1, 3), lambda k: right(a, k) = left(b, k))), 0), 3)::INT AS k FROM (SELECT event_id, event_type AS a, lead(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS b FROM events) WHERE b IS NOT NULL")
def sequence_overlap(spark, d):
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    e = t(spark, d, "events").withColumn("b", F.lead("event_type").over(w)).where("b IS NOT NULL")
    return e.select("event_id", code.longest_overlap(F.split("event_type", ""), F.split("b", ""), 3).alias("k"))


@query("SELECT conv_id, turn, CASE WHEN length(s) <= 100 THEN s WHEN length(regexp_extract(left(s, 100), '^(.*[.。!?！？])', 1)) >= 50 THEN regexp_extract(left(s, 100), '^(.*[.。!?！？])', 1) ELSE left(s, 100) END AS clean FROM (SELECT conv_id, turn, regexp_replace(trim(regexp_replace(regexp_replace(text, '[\\x00-\\x08\\x0b-\\x1f\\x7f]', '', 'g'), '\\s+', ' ', 'g')), '^[\"''“”「」]+|[\"''“”「」]+$', '', 'g') AS s FROM conversations)")
def sanitized_context(spark, d):
    return t(spark, d, "conversations").select("conv_id", "turn", code.sanitize(F.col("text"), 100).alias("clean"))
