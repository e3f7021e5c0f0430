"""Steps that a model does: vectors, ranks, contexts, summaries and answers. Models are plain callables given by the caller.

A provider runs in tasks over Arrow batches; what it has answered before comes from a cache, so only new texts reach it.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quarry.operators import store
from quarry.shipping import ensure_importable

Embed = Callable[[list[str]], list[list[float]]]
Complete = Callable[[str], str]
#: Characters and texts of one call of an embedding provider.
CALL_CHARS, CALL_TEXTS = 20_000, 32
#: Largest share of chunks that may be left without a generated context.
MOST_ABSENT = 0.20


def embed(texts: DataFrame, provider: Embed, text_col: str = "text") -> DataFrame:
    """(md5, vector) of the distinct texts, in calls of bounded size; an answer of the wrong length is an error."""
    ensure_importable(texts.sparkSession)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            keys, held, size = [], [], 0

            def call() -> pd.DataFrame:
                found = provider(held)
                if len(found) != len(held) or any(not v for v in found):
                    raise ValueError(f"{len(found)} vectors for {len(held)} texts, or an empty one")
                return pd.DataFrame({"md5": keys, "vector": [[float(x) for x in v] for v in found]})

            for key, t in zip(pdf["md5"], pdf["text"], strict=True):
                if held and (size + len(t) > CALL_CHARS or len(held) == CALL_TEXTS):
                    yield call()
                    keys, held, size = [], [], 0
                keys.append(key)
                held.append(t)
                size += len(t)
            if held:
                yield call()

    t = F.coalesce(F.col(text_col), F.lit(""))
    one = texts.select(F.md5(t.cast("binary")).alias("md5"), t.alias("text")).dropDuplicates(["md5"])
    return one.mapInPandas(run, "md5 string, vector array<double>")


def with_vectors(rows: DataFrame, provider: Embed, cache: DataFrame, text_col: str = "text") -> DataFrame:
    """rows with vector: of the cache (md5, vector) where it has one, of the provider for the gaps; one dimension, no zero norm."""
    keyed = rows.withColumn("md5", F.md5(F.coalesce(F.col(text_col), F.lit("")).cast("binary")))
    gaps = keyed.join(cache.select("md5"), "md5", "left_anti")
    known = cache.select("md5", "vector").unionByName(embed(gaps, provider, text_col))
    out = keyed.join(known, "md5", "left")
    bad = F.raise_error(F.concat(F.lit("no usable vector for "), "md5"))
    return out.withColumn("vector", F.when(F.coalesce(F.exists("vector", lambda x: x != 0), F.lit(False)), F.col("vector")).otherwise(bad.cast("array<double>"))).drop("md5")


def completed(prompts: DataFrame, provider: Complete, prompt_col: str = "prompt") -> DataFrame:
    """prompts with answer of the provider."""
    ensure_importable(prompts.sparkSession)

    @F.pandas_udf("string")
    def ask(p: pd.Series) -> pd.Series:
        return p.map(lambda x: provider(x or ""))

    return prompts.withColumn("answer", ask(prompt_col))


def order_of_answer(answer: str | Column, most: int) -> Column:
    """Numbers of documents that an answer such as 'DOC_2, DOC_0' names, each once, as long as they exist."""
    a = F.col(answer) if isinstance(answer, str) else answer
    named = F.transform(F.regexp_extract_all(a, F.lit(r"DOC_(\d+)"), F.lit(1)), lambda x: x.cast("int"))
    return F.array_distinct(F.filter(named, lambda k: k < most))


def rank_by_model(candidates: DataFrame, provider: Complete, top_k: int, shown: int = 15, chars: int = 500) -> DataFrame:
    """candidates (query, question, id, source, content, score) with place by a model that lists documents; without a usable answer by score."""
    w = Window.partitionBy("query").orderBy(F.desc("score"), "id")
    c = candidates.withColumn("k", F.row_number().over(w) - 1)
    doc = F.concat(F.lit("[DOC_"), F.col("k").cast("string"), F.lit("] ("), "source", F.lit("):\n"), F.left("content", F.lit(chars)))
    lines = F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("k") < shown, F.struct("k", doc.alias("d"))))), lambda x: x["d"]), "\n")
    asked = c.groupBy("query", "question").agg(F.concat(F.lit("Question: "), F.first("question"), F.lit("\nMost relevant first, as DOC_0, DOC_2:\n"), lines).alias("prompt"), F.count("*").cast("int").alias("n"))
    answers = completed(asked, provider).select("query", F.filter(order_of_answer("answer", shown), lambda k: k < F.col("n")).alias("named"))
    j = c.join(answers, "query").withColumn("_p", F.array_position("named", F.col("k")))
    place = F.when(F.size("named") == 0, F.col("k") + 1).when(F.col("_p") > 0, F.col("_p"))
    return j.withColumn("place", place).where(F.col("place") <= top_k).drop("k", "named", "_p")


def rerank_or_fall_back(scored: DataFrame, policy: str) -> DataFrame:
    """scored (score, rerank_score) with final and score_source; where the reranker gave none: policy embedding takes score, error raises."""
    if policy not in ("embedding", "error"):
        raise ValueError(f"unknown policy {policy!r}")
    missing = F.raise_error(F.lit("the reranker gave no score")).cast("double") if policy == "error" else F.col("score")
    none = F.col("rerank_score").isNull()
    return scored.withColumn("final", F.when(none, missing).otherwise(F.col("rerank_score"))).withColumn("score_source", F.when(none, "fusion").otherwise("rerank"))


def generated_contexts(chunks: DataFrame, provider: Complete, cache: DataFrame, prompt: Column, most_absent: float = MOST_ABSENT) -> DataFrame:
    """chunks with ctx and absent_reason; contexts come from the cache (fingerprint, ctx) or the provider, once for equal prompts.

    Chunks that are generative themselves (column generative) get none. If more than most_absent of the others are left
    without one, it is an error and nothing is returned.
    """
    keyed = chunks.withColumn("fingerprint", F.when(~F.col("generative"), store.fingerprint(prompt.alias("prompt"))))
    wanted = keyed.where("NOT generative").select("fingerprint", prompt.alias("prompt")).dropDuplicates(["fingerprint"])
    new = completed(wanted.join(cache.select("fingerprint"), "fingerprint", "left_anti"), provider).select("fingerprint", F.trim("answer").alias("ctx"))
    known = cache.select("fingerprint", "ctx").unionByName(new)
    out = keyed.join(known, "fingerprint", "left").withColumn("absent_reason", F.when(F.col("generative"), "generative").when(F.coalesce("ctx", F.lit("")) == "", "empty"))
    from quarry.plans.reuse import reuse

    out = reuse(out)
    share = out.where("NOT generative").agg(F.avg((F.col("absent_reason") == "empty").cast("int")).alias("a"), F.avg(F.col("absent_reason").isNotNull().cast("int")).alias("b")).first()["b"]
    if share is not None and share > most_absent:
        raise ValueError(f"{share:.0%} of the chunks are left without a context; at most {most_absent:.0%} may be")
    return out


def summaries(docs: DataFrame, provider: Complete, budget: int, id_col: str = "doc_id", text_col: str = "text", levels: int = 5) -> DataFrame:
    """(id, summary): texts over budget characters are cut into pieces, each is summarised, and so on with what that gives.

    Every level is a distributed step over all pieces of all documents; a text still too long after the last is cut.
    """
    from quarry.plans.reuse import reuse

    now = docs.select(F.col(id_col), F.coalesce(F.col(text_col), F.lit("")).alias("summary"))
    for _ in range(levels):
        long = now.where(F.length("summary") > budget)
        if long.isEmpty():
            break
        n = F.ceil(F.length("summary") / budget).cast("int")
        pieces = long.select(id_col, F.posexplode(F.transform(F.sequence(F.lit(0), n - 1), lambda k: F.substring("summary", k * budget + 1, F.lit(budget)))).alias("k", "prompt"))
        done = completed(pieces, provider).groupBy(id_col).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("k", "answer"))), lambda x: x["answer"]), "\n").alias("summary"))
        now = reuse(now.where(F.length("summary") <= budget).unionByName(done))
    return now.withColumn("summary", F.left("summary", F.lit(budget)))


def checked_answers(questions: DataFrame, provider: Complete) -> DataFrame:
    """(query, answer) of questions (query, question, context): a draft, then the same with its sentences without a REF taken out."""
    from quarry.operators import answer as A

    draft = completed(questions.withColumn("prompt", F.concat("context", F.lit("\n\n"), "question")), provider)
    checked = draft.withColumn("prompt", F.concat(F.lit("Keep only what the references bear out:\n"), "answer", F.lit("\n\n"), "context")).drop("answer")
    final = completed(checked, provider).select("query", F.col("answer").alias("text"), F.transform(F.regexp_extract_all("context", F.lit(r"\[REF(\d+)\]"), F.lit(1)), lambda x: x).alias("refs"))
    return A.evidence_only(final, ["query"], F.col("refs"))


def evidence_report(answer: Column, refs: Column, unverified: Column, coverage: Column) -> Column:
    """Answer, evidence (source, page, section), what has no evidence, and the share that has, as one text."""
    cited = F.transform(refs, lambda r, i: F.concat(F.lit("- REF"), (i + 1).cast("string"), F.lit(": "), r["source"], F.lit(" p."), r["page"].cast("string"), F.when(F.coalesce(r["section"], F.lit("")) != "", F.concat(F.lit(" ("), r["section"], F.lit(")"))).otherwise(F.lit(""))))
    evidence = F.when(F.size(refs) > 0, F.concat(F.lit("## Evidence\n"), F.array_join(cited, "\n"), F.lit("\n")))
    unknown = F.when(F.size(unverified) > 0, F.concat(F.lit("## Unknowns\n"), F.array_join(F.transform(unverified, lambda s: F.concat(F.lit("- "), F.left(s, F.lit(80)), F.lit("..."))), "\n"), F.lit("\n")))
    return F.concat_ws("\n", F.lit("## Answer"), F.concat(answer, F.lit("\n")), evidence, unknown, F.concat(F.lit("---\n*Coverage: "), F.round(coverage * 100).cast("int").cast("string"), F.lit("%*")))


def route(path: str | Column) -> Column:
    """What reads a file: text, page markup, picture, elf, binary or document, by its suffix."""
    p = F.col(path) if isinstance(path, str) else path
    end = F.lower(F.regexp_extract(p, r"\.([^./]+)$", 1))
    return (
        F.when(end.isin("md", "txt", "rst", "log", "csv", "json", "yaml", "yml", "toml", "ini", "cfg"), "text").when(end.isin("html", "htm"), "markup").when(end.isin("png", "jpg", "jpeg", "gif", "bmp", "webp"), "picture")
        .when(end.isin("elf", "so", "o", "ko", "axf"), "elf").when(end.isin("pdf"), "document").when(end.isin("c", "h", "cc", "cpp", "hpp", "py", "rs", "go", "java", "kt", "js", "ts", "s", "ld"), "text").otherwise("binary")
    )


def file_references(c: str | Column) -> Column:
    """Paths that a text names as file:path, quoted or bare, each once."""
    t = F.col(c) if isinstance(c, str) else c
    found = F.regexp_extract_all(t, F.lit(r"""(?i)\bfile:("[^"]+"|'[^']+'|[^\s"'<>]+)"""), F.lit(1))
    return F.array_distinct(F.transform(found, lambda x: F.regexp_replace(F.regexp_replace(x, r"""^["']|["']$""", ""), "^//", "")))


def staged(files: DataFrame, suffixes: list[str], most_bytes: int, taken: DataFrame) -> DataFrame:
    """files (path, length) with name and refused: what may be copied in under which name, none of those taken (name) used again."""
    base = F.element_at(F.split("path", "/"), -1)
    end = F.lower(F.regexp_extract(base, r"\.([^.]+)$", 1))
    why = F.when(~end.isin(suffixes), "suffix").when(F.col("length") > most_bytes, "size").otherwise("")
    nth = F.row_number().over(Window.partitionBy("_b", "refused").orderBy("path"))
    rows = files.withColumn("_b", base).withColumn("refused", why).withColumn("_n", nth)
    used = rows.join(taken.select(F.col("name").alias("_b"), F.lit(1).alias("_t")).distinct(), "_b", "left").withColumn("_n", F.col("_n") + F.coalesce("_t", F.lit(0)))
    name = F.when(F.col("_n") == 1, F.col("_b")).otherwise(F.concat(F.regexp_replace("_b", r"\.[^.]+$", ""), F.lit("_"), F.col("_n").cast("string"), F.regexp_extract("_b", r"(\.[^.]+)$", 1)))
    return used.select("path", F.when(F.col("refused") == "", name).alias("name"), "refused")

