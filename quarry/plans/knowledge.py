"""The whole retrieval plan over a chunk store, for one or many questions at once."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quarry.config import DEFAULT
from quarry.functions import code, text, vectors
from quarry.operators import answer, context, evidence, ingest, lexical_index, lexical_scan, search
from quarry.operators import chunks as chunks_text
from quarry.plans.bounded import bounded
from quarry.plans.reuse import reuse


def search_knowledge(
    chunks: DataFrame, questions: DataFrame, source: str | None = None, top_k: int = 6, strict: bool = False,
    rerank: Callable[[pd.Series, pd.Series], pd.Series] | None = None, filters: dict[str, str | list[str]] | None = None,
    other_wordings: DataFrame | None = None, always_rerank: bool = True, index: lexical_index.Index | None = None, gate_index: lexical_index.Index | None = None,
) -> DataFrame:
    """REF rows (query, ref, id, source, chunk_index, last_index, type, score, gate, content) for questions (query, question, qv).

    chunks: id, source, type, page, chunk_index, section, content, v and, where it has generated contexts, ctx. The steps in
    order: metadata filters, dense and lexical ranks, fusion, other wordings (query, question, qv) of questions that need
    them, gates of content alone, weights by type, thresholds or exact numbers, rerank, diverse selection, pollution
    control, merging of neighbours, noise filter, removal of near copies. Lexical statistics stay global under a filter;
    what passes is decided by the gate, never by a generated context. index, gate_index: stored indexes of the chunks' texts
    with and without generated contexts (section, source, ctx, content); without one the questions go over the texts in one
    pass. Whole texts and vectors of chunks are read for candidates alone.
    """
    k = DEFAULT.candidate_k
    with_ctx = "ctx" in chunks.columns
    allowed = chunks.where(search.matches(source, filters=filters))
    ids = allowed.select("id")
    body = F.concat_ws(" ", "section", "source", "content")
    plain = chunks.select("id", body.alias("content"))
    index = index if with_ctx else index or gate_index
    ranked_text = chunks.select("id", F.concat_ws(" ", "section", "source", F.when(F.trim("ctx") != "", F.col("ctx")), "content").alias("content")) if with_ctx else plain
    filtered = source not in (None, "") or bool(filters)

    def lexical_ranks(asked: DataFrame, others: DataFrame) -> tuple[DataFrame, DataFrame]:
        """The 2k best (query, id, score, rank), and the scores of them and of others (query, id), relative to the best that the filter leaves."""
        if index:
            rows = lexical_index.scores(index, asked, "query", "question").join(ids, "id", "left_semi")
            rows = rows.withColumn("score", F.round(F.col("score") / F.max("score").over(Window.partitionBy("query")), 6)).where(F.col("score") >= DEFAULT.bm25_floor)
            rows = reuse(rows)
            return search.top_k(rows, 2 * k), rows
        found = lexical_scan.passes(ranked_text, asked, "id", "content", "query", "question")
        best = reuse(lexical_scan.top(found, 2 * k, ids if filtered else None))
        rows = lexical_scan.gate(found, others.select("query", "id").unionByName(best.select("query", "id")))
        most = best.where("rank = 1").select("query", F.col("score").alias("_most"))
        relative = lambda df: df.join(most, "query").withColumn("score", F.round(F.col("score") / F.col("_most"), 6)).drop("_most").where(F.col("score") >= DEFAULT.bm25_floor)
        return relative(best), relative(rows)

    def ranked(asked: DataFrame) -> DataFrame:
        dense = reuse(search.dense_top(allowed, asked.select("query", "qv"), 2 * k, "id", "v"))
        best, lexical = lexical_ranks(asked, dense)
        fused = search.top_k(search.rrf(dense, best), k, by="rrf").drop("rank")
        scored = fused.join(dense.select("query", "id", F.col("score").alias("retrieval")), ["query", "id"], "left").join(lexical.select("query", "id", F.col("score").alias("bm25")), ["query", "id"], "left")
        return scored.fillna(0.0, ["retrieval", "bm25"])

    def plain_scores(cand: DataFrame, asked: DataFrame) -> DataFrame:
        if gate_index:
            return lexical_index.gate(gate_index, asked, cand, "query", "question")
        return lexical_scan.gate(lexical_scan.passes(plain, asked, "id", "content", "query", "question"), cand)

    def gated(cand: DataFrame, asked: DataFrame) -> DataFrame:
        # candidates outside the dense list still need their dense score: at most k rows a question
        v = allowed.join(cand.select("id").distinct(), "id", "left_semi").select("id", vectors.normalize(F.col("v")).alias("v"))
        q = asked.select("query", vectors.normalize(F.col("qv")).alias("qv"))
        out = cand.join(v, "id").join(q, "query").withColumn("retrieval", F.round(vectors.dot(F.col("v"), F.col("qv")), 6)).drop("v", "qv")
        return search.fill_gate(out, None, plain_scores(cand, asked) if with_ctx else None)

    cand = reuse(gated(reuse(ranked(questions)), questions))
    if other_wordings is not None:
        signals = search.decision_signals(cand)
        weak = questions.join(signals, "query", "left").where(search.should_expand(text.is_numeric_question("question"), F.col("n"), F.col("g1"))).select("query")
        more = reuse(other_wordings.join(weak, "query", "left_semi").withColumn("asked", F.col("query")).withColumn("query", F.monotonically_increasing_id()))
        found = gated(reuse(ranked(more)), more).join(more.select("query", "asked"), "query").drop("query").withColumnRenamed("asked", "query")
        merged = search.merge_expansion(cand.select("query", "id", "rrf", "retrieval", "gate", "bm25"), found.select("query", "id", "rrf", "retrieval", "gate", "bm25"))
        cand = reuse(search.top_k(merged.withColumn("gate_bm25", F.col("bm25")), k, by="rrf").drop("rank"))
    # the texts of candidates alone, so that the others stay where they are
    meta = allowed.join(cand.select("id").distinct(), "id", "left_semi").select("id", "source", "type", "page", "chunk_index", "section", "content", vectors.normalize(F.col("v")).alias("v"))
    weight = search.source_weight(F.col("type"))
    sizes = questions.select("query", "question", text.estimate_tokens("question").alias("tokens"))
    cand = cand.join(meta, "id").join(sizes, "query").withColumn("rrf", F.col("rrf") * weight).withColumn("gate", F.col("gate") * weight)
    cand = reuse(cand)  # at most k rows a question, read by every step below
    signals = search.decision_signals(cand, by_gate=with_ctx)
    cand = cand.join(signals.select("query", F.col("g1").alias("top_gate"), "n", "g1", "g2", "g3", "g5"), "query")
    number = search.numeric_evidence(F.col("question"), F.col("gate_bm25"), F.concat_ws(" ", "source", "section", "content"))
    cand = cand.where((F.col("gate") >= search.min_gate(F.col("tokens"), F.lit(strict), F.col("top_gate"))) | number)
    cand = cand.withColumn("score", F.col("gate"))
    if rerank:
        wanted = search.should_rerank(F.col("n"), F.col("g1"), F.col("g2"), F.col("g3"), F.col("g5"), F.lit(strict), always_rerank)
        passages = cand.withColumn("passage", chunks_text.passage("source", "section", "content"))
        cand = search.rerank(passages, rerank, "question", "passage").withColumn("score", F.when(wanted, F.col("rerank_score")).otherwise(F.col("gate"))).drop("passage")
    cand = reuse(cand)
    scaled = search.min_max(cand).withColumn("score", F.coalesce("relevance", "score"))
    pool = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), "id"))
    effective = search.effective_k(F.col("top_gate"), F.lit(top_k))
    scaled = reuse(scaled.withColumn("_place", pool).where(F.col("_place") <= F.greatest(effective * 3, F.lit(12))))
    picks = search.mmr(scaled.select("query", "id", "score", "v"), top_k)
    chosen = reuse(scaled.join(picks, ["query", "id"]).where(F.col("pick") <= effective))
    risk = search.margin_risk(cand.select("query", "id", F.col("gate").alias("score"))).select("query", "high_risk")
    polluted = search.pollution_risk(chosen.select("query", "source", F.col("gate").alias("score")).join(risk, "query")).select("query", "pollution")
    kept = search.control_pollution(chosen.join(polluted, "query"), weight)
    merged = refine(kept)
    renumber = F.row_number().over(Window.partitionBy("query").orderBy("source", "page", "first"))
    return merged.select("query", renumber.alias("ref"), "id", "source", F.col("first").alias("chunk_index"), F.col("last").alias("last_index"), "type", F.round("score", 6).alias("score"), F.round("gate", 6).alias("gate"), "content")


def refine(chosen: DataFrame) -> DataFrame:
    """chosen with neighbours of a page and section merged, without noise and near copies of earlier ones; a few rows a question.

    A merged chunk has the best score and gate of its members, the id of the first, and the type of the strongest.
    """
    keys = ["query", "source", "page", "section"]
    runs = ingest.adjacent_runs(chosen, keys)
    one = Window.partitionBy(*keys, "run").orderBy("chunk_index")
    # neighbours join while their texts stay short enough: sizes are summed anew after each cut
    lengths = runs.withColumn("_before", F.collect_list(F.length("content")).over(one.rowsBetween(Window.unboundedPreceding, 0)))
    zero = F.struct(F.lit(0).alias("used"), F.lit(0).alias("part"))

    def step(s: Column, n: Column) -> Column:
        fits = (s["used"] > 0) & (s["used"] + n < DEFAULT.merge_chars)
        return F.struct(F.when(fits, s["used"] + 1 + n).otherwise(n).alias("used"), F.when(fits, s["part"]).otherwise(s["part"] + 1).alias("part"))

    parts = lengths.withColumn("part", F.aggregate("_before", zero, step, lambda s: s["part"]))
    whole = parts.groupBy(*keys, "run", "part").agg(
        F.array_sort(F.collect_list(F.struct("chunk_index", "id", "type", "content"))).alias("m"), F.max("score").alias("score"), F.max("gate").alias("gate"),
    )
    whole = whole.select(
        *keys, F.get("m", F.lit(0))["id"].alias("id"), F.get("m", F.lit(0))["chunk_index"].alias("first"), F.element_at("m", -1)["chunk_index"].alias("last"), chunks_text.upgraded(F.transform("m", lambda x: x["type"])).alias("type"),
        "score", "gate", F.array_join(F.transform("m", lambda x: x["content"]), "\n").alias("content"),
    )
    clean = whole.where(~text.is_noisy("content")).withColumn("words", F.array_distinct(text.all_matches(F.lower("content"), r"\b[a-z0-9_]+\b"))).withColumn("ord", F.row_number().over(Window.partitionBy("query").orderBy("source", "page", "first")))
    rows = clean.groupBy("query").agg(F.array_sort(F.collect_list(F.struct("ord", "words"))).alias("r"))

    def like(a: Column, b: Column) -> Column:
        common = F.size(F.array_intersect(a, b))
        return (F.size(a) > 0) & (F.size(b) > 0) & (common / (F.size(a) + F.size(b) - common) >= DEFAULT.dedup_jaccard)

    none = F.expr("CAST(array() AS array<struct<ord:int,words:array<string>>>)")
    kept = rows.select("query", F.explode(F.aggregate("r", none, lambda acc, x: F.when(F.exists(acc, lambda y: like(y["words"], x["words"])), acc).otherwise(F.array_append(acc, x)))).alias("k"))
    return clean.join(kept.select("query", F.col("k.ord").alias("ord")), ["query", "ord"], "left_semi").drop("words")


def decide(questions: DataFrame, refs: DataFrame, authoritative: list[str] | None = None) -> DataFrame:
    """(query, reason, refs, top, decision) of questions given their REF rows: refuse, strict or plain."""
    best = refs.groupBy("query").agg(F.count("*").alias("refs"), F.max("gate").alias("top"), F.bool_or(F.col("source").isin(authoritative or [])).alias("authoritative"))
    q = questions.select("query", "question").join(best, "query", "left").select("query", "question", F.coalesce("refs", F.lit(0)).alias("refs"), F.coalesce("top", F.lit(0.0)).alias("top"), F.coalesce("authoritative", F.lit(False)).alias("auth"))
    reason = answer.grounding_reason("question")
    grounded = ~reason.isin("", "excluded")
    refuse = answer.should_refuse(grounded & reason.isin("spec", "keyword", "force"), F.col("refs") > 0, F.col("top"), F.col("auth"))
    return q.select("query", reason.alias("reason"), "refs", "top", F.when(refuse, "refuse").when(grounded, "strict").otherwise("plain").alias("decision"))


def assemble(refs: DataFrame) -> DataFrame:
    """(query, context): the REF rows as one text for a model."""
    line = F.concat(F.lit("[REF"), F.col("ref").cast("string"), F.lit("] "), "source", F.lit("\n"), "content")
    return refs.groupBy("query").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ref", line.alias("s")))), lambda x: x["s"]), "\n\n").alias("context"))


_SYMBOL = ["path", "name", "kind", "start_line"]


def _tokenised(questions: DataFrame) -> DataFrame:
    """questions with tokens and their number n, of those that have any; both steps are kept, else their expressions are put into each other many times."""
    q = reuse(questions).withColumn("tokens", text.code_tokens("question"))
    return reuse(q.where("size(tokens) > 0").withColumn("n", F.greatest(F.size("tokens"), F.lit(1))))


def _first_alike(symbols: DataFrame, most: int) -> DataFrame:
    """The first `most` symbols by path and line of those that differ in nothing else: to any question they are the same."""
    same = Window.partitionBy("name", "kind", "signature", "docstring", "dense").orderBy("path", "start_line")
    return symbols.withColumn("_n", F.row_number().over(same)).where(F.col("_n") <= most).drop("_n")


def _symbol_hits(symbols: DataFrame, q: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The names that _tokenised() questions mention; and the symbols that share a word with them, with kw and dense.

    Symbols meet questions by their identifiers, so those without a word in common never do.
    """
    asked = q.select("query", "n", F.explode(F.array_distinct(F.transform("tokens", F.lower))).alias("token"))
    named = q.select("query", F.explode("tokens").alias("name")).distinct().withColumn("explicit", F.lit(True))
    around = F.transform(text.all_matches(F.concat_ws(" ", "signature", "docstring"), "[A-Za-z_][A-Za-z0-9_]*"), F.lower)
    words = F.array_distinct(F.concat(
        F.transform(code.identifier_parts(F.col("name")), lambda x: F.struct(x.alias("token"), F.lit("part").alias("at"))),
        F.transform(F.array_distinct(around), lambda x: F.struct(x.alias("token"), F.lit("around").alias("at"))), F.array(F.struct(F.lower("name").alias("token"), F.lit("whole").alias("at"))),
    ))
    flat = symbols.select(*_SYMBOL, "dense", F.inline(words))
    count = lambda k: F.count(F.when(F.col("at") == k, 1))
    met = flat.join(asked, "token").groupBy("query", *_SYMBOL, "dense", "n").agg(count("part").alias("_p"), count("around").alias("_a"), count("whole").alias("_w"))
    kw = F.when(F.col("_w") > 0, 1.0).otherwise(F.least(F.lit(1.0), F.col("_p") / F.col("n") + 0.3 * F.col("_a") / F.col("n")))
    return named, reuse(met.withColumn("kw", kw).where("kw > 0").select("query", *_SYMBOL, "dense", "n", "kw"))


def _best_symbols(rows: DataFrame, hits: DataFrame, named: DataFrame, top_k: int, threshold: float) -> DataFrame:
    """(query, path, name, kind, start_line, score) of the best rows of each question, by the hybrid score."""
    lexical = hits.select("query").distinct().withColumn("any_lexical", F.lit(True))
    j = rows.join(lexical, "query", "left").join(named, ["query", "name"], "left").fillna(False, ["any_lexical", "explicit"])
    scored = j.withColumn("score", F.round(code.hybrid_score(F.col("dense"), F.col("kw"), F.col("kind"), F.col("explicit"), F.col("n"), F.col("any_lexical")), 6))
    w = Window.partitionBy("query").orderBy(F.desc("score"), "path", "start_line")
    return scored.where((F.col("score") >= threshold) | F.col("explicit")).withColumn("rn", F.row_number().over(w)).where(F.col("rn") <= top_k).select("query", *_SYMBOL, "score")


def search_symbols(symbols: DataFrame, questions: DataFrame, top_k: int = 10, threshold: float = 0.35) -> DataFrame:
    """(query, path, name, kind, start_line, score): symbols (with dense score column, or 0) by the hybrid score.

    Symbols without a word in common with a question are looked at for their dense score only. Questions of the same tokens
    are asked once, and of symbols that differ only in their place the first top_k take part, as no others can be a result.
    """
    s = reuse(_first_alike(symbols.withColumn("dense", F.col("dense") if "dense" in symbols.columns else F.lit(0.0)), top_k))
    every = _tokenised(questions)
    alike = reuse(every.select("query", "tokens", "n", F.min("query").over(Window.partitionBy("tokens")).alias("_as")))
    q = alike.where(F.col("query") == F.col("_as")).drop("_as")
    named, hits = _symbol_hits(s, q)
    strong = s.where(F.col("dense") >= threshold).select(*_SYMBOL, "dense").join(bounded(q.select("query", "n")), how="cross").join(hits.select("query", *_SYMBOL), ["query", *_SYMBOL], "left_anti").withColumn("kw", F.lit(0.0))
    best = _best_symbols(hits.unionByName(strong.select(*hits.columns)), hits, named, top_k, threshold)
    return best.withColumnRenamed("query", "_as").join(alike.select("query", "_as"), "_as").select("query", *_SYMBOL, "score")


#: Lexical candidates of a question whose vectors are looked at.
LAZY = 150


def search_symbols_lazily(symbols: DataFrame, questions: DataFrame, vectors_of: DataFrame, top_k: int = 10, threshold: float = 0.35, most: int = LAZY) -> DataFrame:
    """search_symbols() for questions (query, question, qv) and vectors (id, path, name, kind, start_line, v) in two phases.

    A question that shares words with symbols asks for the vectors of its `most` best ones, ties by path and line, and of the
    symbols that it names; the others count with a dense score of 0. Only questions without any such symbol go over all
    vectors, and where there is none, no scan of them takes place. Of symbols that differ only in their place the first
    most + top_k take part in the first phase: later ones are neither looked at nor can they be a result.
    """
    q = _tokenised(questions)
    named, hits = _symbol_hits(_first_alike(symbols.withColumn("dense", F.lit(0.0)), most + top_k), q)
    place = F.row_number().over(Window.partitionBy("query").orderBy(F.desc(F.round("kw", 9)), "path", "start_line", "name", "kind"))
    ranked = hits.drop("dense").withColumn("_n", place).join(named, ["query", "name"], "left")
    looked = ranked.where((F.col("_n") <= most) | F.col("explicit")).select("query", *_SYMBOL)
    unit = vectors_of.select(*_SYMBOL, vectors.normalize(F.col("v")).alias("v"))
    scores = looked.join(unit, _SYMBOL).join(q.select("query", vectors.normalize(F.col("qv")).alias("qv")), "query").select("query", *_SYMBOL, F.round(vectors.dot(F.col("v"), F.col("qv")), 6).alias("dense"))
    settled = hits.drop("dense").join(scores, ["query", *_SYMBOL], "left").fillna(0.0, ["dense"])
    open_ = q.join(hits.select("query").distinct(), "query", "left_anti").select("query", "qv", "n")
    # without a lexical match a score is the dense one, and 0.05 more for functions
    whole = search.dense_scores(vectors_of, open_, "id", "v", least=threshold - 0.05).join(vectors_of.select("id", *_SYMBOL), "id").join(open_.select("query", "n"), "query")
    return _best_symbols(settled.unionByName(whole.select("query", *_SYMBOL, F.col("score").alias("dense"), "n", F.lit(0.0).alias("kw")).select(*settled.columns)), hits, named, top_k, threshold)


def code_evidence(candidates: DataFrame, sources: DataFrame, max_chars: int, most: int = 48) -> DataFrame:
    """(query, path, start, end, body): ranges (query, path, start, end, priority) merged, diversified and packed under a budget.

    A range that does not fit is cut to the lines around its anchor that do, or left out; bodies that repeat an earlier one
    are left out. See omitted_evidence() for what is.
    """
    out = _packed(candidates, sources, max_chars, most).select("query", F.inline("f.out"))
    return out.select("query", "path", "start", "end", "body")


def omitted_evidence(candidates: DataFrame, sources: DataFrame, max_chars: int, most: int = 48) -> DataFrame:
    """(query, used, beyond_limit, over_budget, repeated): what code_evidence() leaves out, and the characters it uses."""
    p = _packed(candidates, sources, max_chars, most)
    return p.select("query", F.col("f.used").alias("used"), "beyond_limit", F.col("f.omitted").alias("over_budget"), F.col("f.repeated").alias("repeated"))


def _packed(candidates: DataFrame, sources: DataFrame, max_chars: int, most: int) -> DataFrame:
    rows = candidates if "anchor" in candidates.columns else candidates.withColumn("anchor", F.col("start"))
    placed = context.diversify(context.merge_ranges(rows, ["query", "path"]), "query")
    beyond = placed.groupBy("query").agg(F.count(F.when(F.col("place") > most, 1)).alias("beyond_limit"))
    lines = sources.select("path", F.split("content", "\n").alias("lines"))
    window = F.slice("lines", F.col("start").cast("int"), (F.col("end") - F.col("start") + 1).cast("int"))
    item = F.struct("place", "path", F.col("start").cast("int").alias("start"), F.least(F.col("end"), F.size("lines")).cast("int").alias("end"), F.col("anchor").cast("int").alias("anchor"), window.alias("lines"))
    items = placed.where(F.col("place") <= most).join(lines, "path").groupBy("query").agg(F.array_sort(F.collect_list(item)).alias("items"))
    zero = F.struct(F.lit(0).alias("used"), F.lit(0).alias("omitted"), F.lit(0).alias("repeated"), F.expr("CAST(array() AS array<string>)").alias("seen"), F.expr("CAST(array() AS array<struct<path:string,start:int,end:int,body:string>>)").alias("out"))

    def step(s: Column, x: Column) -> Column:
        left = F.lit(max_chars) - s["used"]
        whole = F.array_join(x["lines"], "\n")
        span = x["end"] - x["start"] + 1
        target = F.greatest(F.lit(1), F.floor(span * left / F.greatest(F.length(whole), F.lit(1))).cast("int") - 1)
        cut = (F.length(whole) > left) & (left > 0) & (target < span)
        w = evidence.shrink(x["start"], x["end"], x["anchor"], target)
        start, end = F.when(cut, w["start"]).otherwise(x["start"]).cast("int"), F.when(cut, w["end"]).otherwise(x["end"]).cast("int")
        body = F.when(cut, F.array_join(F.slice(x["lines"], start - x["start"] + 1, end - start + 1), "\n")).otherwise(whole)
        key = F.md5(body.cast("binary"))
        big, again = F.length(body) > left, F.array_contains(s["seen"], key)
        take = ~big & ~again
        return F.struct(
            (s["used"] + F.when(take, F.length(body)).otherwise(0)).cast("int").alias("used"), (s["omitted"] + big.cast("int")).alias("omitted"), (s["repeated"] + (~big & again).cast("int")).alias("repeated"),
            F.when(take, F.array_append(s["seen"], key)).otherwise(s["seen"]).alias("seen"),
            F.when(take, F.array_append(s["out"], F.struct(x["path"].alias("path"), start.alias("start"), end.alias("end"), body.alias("body")))).otherwise(s["out"]).alias("out"),
        )

    return items.withColumn("f", F.aggregate("items", zero, step)).join(beyond, "query")
