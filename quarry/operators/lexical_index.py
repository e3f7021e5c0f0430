"""A stored inverted index for BM25: postings in blocks with block maxima, changed by generations.

A generation holds tables of its own documents: `forward` (id, block, tokens), in whose order documents fall into blocks
of like length, and `postings`, a row per term and block with the ids, term frequencies and lengths, and with their
maxima. Postings are written by buckets of terms, so a question reads the buckets of its terms. Documents that a later
generation replaces or deletes are listed there as `stale` (generation, id), with what each of their terms loses
(`dropped`). Postings stay as they are until compact(). A pointer tells the generations and the totals.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quarry.config import DEFAULT
from quarry.functions import text
from quarry.operators import store
from quarry.plans.reuse import reuse, scratch, spread

#: Documents of a block (a power of two), and buckets of terms.
BLOCK, BUCKETS = 256, 16
#: A bucket's postings are dealt over so many tasks by block, so a term in all documents is no hot key.
SUBS = 8
#: Blocks of each question that are scored first; they give the score that the others have to reach.
FIRST = 4


@dataclass(frozen=True)
class Index:
    """What a pointer says: generations (paths), the number of live documents, the sum of their lengths, and which of the
    generations list what they replace instead of documents."""

    spark: SparkSession
    path: str
    generations: tuple[str, ...]
    documents: int
    length: int
    lists: tuple[int, ...] = ()

    @property
    def average(self) -> float:
        return self.length / self.documents if self.documents else 1.0

    def table(self, name: str, schema: str) -> DataFrame:
        """A table of all generations that have it, with the generation's number."""
        own = [k for k in range(len(self.generations)) if (k in self.lists) == (name in ("stale", "dropped"))]
        parts = [self.spark.read.schema(schema).parquet(f"{self.generations[k]}/{name}").withColumn("generation", F.lit(k)) for k in own]
        return reduce(DataFrame.unionByName, parts) if parts else self.spark.createDataFrame([], f"{schema}, generation int")

    def changed(self) -> bool:
        """Whether documents were replaced or deleted since the index was built or compacted."""
        return bool(self.lists)


def _index(spark: SparkSession, path: str, generations: list[str], facts: dict) -> Index:
    return Index(spark, path, tuple(generations), facts["documents"], facts["length"], tuple(facts.get("lists", ())))


_FORWARD = "id long, block long, tokens array<string>"
_POSTINGS = "bucket int, term string, block long, n long, most int, least int, p array<struct<id:bigint,tf:int,dl:int>>"
_STALE, _DROPPED = "of int, id long", "term string, n long"


def _bucket(term: str) -> Column:
    return F.pmod(F.xxhash64(term), F.lit(BUCKETS)).cast("int")


def _write(tokens: DataFrame, folder: str) -> DataFrame:
    """Write the forward table and the postings of tokens (id, tokens); returns the former."""
    spark = tokens.sparkSession
    # documents of like length share a block, so block maxima are close to what their documents reach
    rows = tokens.withColumn("dl", F.size("tokens")).sortWithinPartitions("dl", "id").withColumn("block", F.shiftright(F.monotonically_increasing_id(), BLOCK.bit_length() - 1))
    rows.select("id", "block", "tokens").write.option("compression", "zstd").parquet(f"{folder}/forward")
    forward = spark.read.schema(_FORWARD).parquet(f"{folder}/forward")
    # a block's documents meet in one task; what leaves it are whole lists
    each = forward.repartition("block").select("block", "id", F.size("tokens").alias("dl"), F.explode("tokens").alias("term")).groupBy("block", "id", "dl", "term").agg(F.count("*").cast("int").alias("tf"))
    lists = each.groupBy("block", "term").agg(F.count("*").alias("n"), F.max("tf").alias("most"), F.min("dl").alias("least"), F.collect_list(F.struct("id", "tf", "dl")).alias("p"))
    lists = lists.withColumn("bucket", _bucket("term"))
    dealt = lists.repartition("bucket", F.pmod("block", F.lit(SUBS))).sortWithinPartitions("bucket", "term", "block")
    dealt.select("bucket", "term", "block", "n", "most", "least", "p").write.option("compression", "zstd").partitionBy("bucket").parquet(f"{folder}/postings")
    return forward


def _tokens(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return spread(docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))).select("id", text.lexical_tokens(F.coalesce("text", F.lit(""))).alias("tokens"))


def build(docs: DataFrame, path: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> Index:
    """Index docs (ids distinct) at path, in place of what was there; in a scratch folder if there is no path. Each text is tokenised once."""
    spark = docs.sparkSession
    path = path or scratch(spark, "lexical")
    folder = store.new_generation(spark, path)
    facts = _totals(_write(_tokens(docs, id_col, text_col), folder))
    store.advance(spark, path, lambda *_: ([folder], None, facts))
    return _index(spark, path, [folder], facts)


def _totals(forward: DataFrame) -> dict:
    r = forward.agg(F.count("*").alias("documents"), F.coalesce(F.sum(F.size("tokens")), F.lit(0)).alias("length")).first()
    return r.asDict()


def load(spark: SparkSession, path: str) -> Index:
    """The index as its newest pointer says."""
    _, generations, _, facts = store._pointer(spark, path)
    if not generations:
        raise FileNotFoundError(f"no index at {path}")
    return _index(spark, path, generations, facts)


def _live(index: Index) -> DataFrame:
    """The forward rows that no later generation lists as stale."""
    rows = index.table("forward", _FORWARD)
    if not index.changed():
        return rows
    return rows.join(index.table("stale", _STALE).select(F.col("of").alias("generation"), "id"), ["generation", "id"], "left_anti")


def update(spark: SparkSession, path: str, docs: DataFrame | None = None, deleted: DataFrame | None = None, id_col: str = "doc_id", text_col: str = "text") -> Index:
    """Replace or add docs, and delete ids (deleted: a column id_col); only what changes is tokenised and written.

    If another writer was first, what is stale is worked out again from its pointer; the documents' tables stay.
    """
    folder = store.new_generation(spark, path)
    forward = _write(_tokens(docs, id_col, text_col), folder) if docs is not None else spark.createDataFrame([], _FORWARD)
    own = _totals(forward)
    ids = forward.select("id")
    if deleted is not None:
        ids = ids.union(deleted.select(F.col(id_col).cast("long"))).distinct()

    def add(generations: list[str], facts: dict) -> tuple[list[str], None, dict]:
        now = _index(spark, path, generations, facts)
        lost = reuse(_live(now).join(ids, "id", "left_semi"))
        gone = _totals(lost)
        attempt = store.new_generation(spark, path)  # the tables of this attempt: another one writes its own
        lost.select(F.col("generation").alias("of"), "id").write.parquet(f"{attempt}/stale")
        lost.select(F.explode(F.array_distinct("tokens")).alias("term")).groupBy("term").agg(F.count("*").alias("n")).write.parquet(f"{attempt}/dropped")
        new = [*generations, folder, attempt] if docs is not None else [*generations, attempt]
        told = {k: facts[k] - gone[k] + own[k] for k in ("documents", "length")}
        return new, None, told | {"lists": [*now.lists, len(new) - 1]}

    generations, facts = store.advance(spark, path, add)
    return _index(spark, path, generations, facts)


def compact(spark: SparkSession, path: str) -> Index:
    """Write the live documents as one generation; nothing is tokenised anew."""

    def whole(generations: list[str], facts: dict) -> tuple[list[str], None, dict]:
        folder = store.new_generation(spark, path)
        _write(_live(_index(spark, path, generations, facts)).select("id", "tokens"), folder)
        return [folder], None, facts | {"lists": []}

    generations, facts = store.advance(spark, path, whole)
    return _index(spark, path, generations, facts)


def _idf(index: Index, df: str) -> Column:
    n = F.lit(float(index.documents))
    return F.log((n - F.col(df) + 0.5) / (F.col(df) + 0.5) + 1)


def term_stats(index: Index, terms: DataFrame | None = None, buckets: list[int] | None = None) -> DataFrame:
    """(term, df, idf) of live documents, of all terms or of those asked for (in buckets); lists are not read."""
    rows = index.table("postings", _POSTINGS)
    dropped = index.table("dropped", _DROPPED).select("term", (-F.col("n")).alias("n"))
    if terms is not None:
        rows = rows.where(F.col("bucket").isin(_buckets(terms) if buckets is None else buckets)).join(terms, "term", "left_semi")
        dropped = dropped.join(terms, "term", "left_semi")
    counts = rows.select("term", "n")
    counts = counts.unionByName(dropped) if index.changed() else counts
    return counts.groupBy("term").agg(F.sum("n").alias("df")).where("df > 0").select("term", "df", _idf(index, "df").alias("idf"))


def _buckets(terms: DataFrame) -> list[int]:
    """The buckets that hold the terms: at most BUCKETS of them."""
    return [r[0] for r in terms.select(_bucket("term")).distinct().collect()]


@dataclass(frozen=True)
class Asked:
    """Questions as (query, term, weight): repeated tokens count again, terms of no document are left out; and their buckets."""

    terms: DataFrame
    buckets: list[int]


def _asked(index: Index, queries: DataFrame, query_id: str, query_text: str) -> Asked:
    found = reuse(queries.select(F.col(query_id).alias("query"), F.explode(text.lexical_tokens(query_text)).alias("term")).groupBy("query", "term").agg(F.count("*").alias("qtf")))
    buckets = _buckets(found)
    stats = term_stats(index, found.select("term").distinct(), buckets)
    return Asked(reuse(found.join(stats, "term").select("query", "term", (F.col("qtf") * F.col("idf")).alias("weight"))), buckets)


def _part(index: Index, tf: Column, dl: Column) -> Column:
    """A term's part of a score but for its weight; rises with tf and falls with dl."""
    s = DEFAULT
    return tf * (s.bm25_k1 + 1) / (tf + s.bm25_k1 * (1 - s.bm25_b + s.bm25_b * dl / F.lit(index.average)))


def _lists(index: Index, asked: Asked) -> DataFrame:
    """(query, weight, generation, block, most, least, p): the lists of the terms asked for, which alone leave the scan, once."""
    rows = index.table("postings", _POSTINGS).where(F.col("bucket").isin(asked.buckets))
    return reuse(rows.join(asked.terms, "term").select("query", "weight", "generation", "block", "most", "least", "p"))


def _scored(index: Index, lists: DataFrame, within: DataFrame | None = None) -> DataFrame:
    """(query, id, raw) of the documents in lists."""
    each = lists.select("query", "weight", "generation", F.explode("p").alias("p")).select("query", "weight", "generation", "p.id", "p.tf", "p.dl")
    if index.changed():
        each = each.join(index.table("stale", _STALE).select(F.col("of").alias("generation"), "id"), ["generation", "id"], "left_anti")
    if within is not None:
        each = each.join(within.select("id"), "id", "left_semi")
    return each.groupBy("query", "id").agg(F.sum(F.col("weight") * _part(index, F.col("tf"), F.col("dl"))).alias("raw"))


def _relative(raw: DataFrame) -> DataFrame:
    """(query, id, score) relative to the best of each query, from the floor."""
    top = raw.groupBy("query").agg(F.max("raw").alias("top"))
    return raw.join(top, "query").select("query", "id", F.round(F.col("raw") / F.col("top"), 6).alias("score")).where(F.col("score") >= DEFAULT.bm25_floor)


def scores(index: Index, queries: DataFrame, query_id: str = "item_id", query_text: str = "text") -> DataFrame:
    """(query, id, score) of all documents from the floor on."""
    return _relative(reuse(_scored(index, _lists(index, _asked(index, queries, query_id, query_text)))))


def top(index: Index, queries: DataFrame, k: int, query_id: str = "item_id", query_text: str = "text", within: DataFrame | None = None) -> DataFrame:
    """(query, id, score, rank): the k best documents of each query, ties of rounded scores by the smaller id; exact.

    A block's maxima bound what its documents can reach. The FIRST most promising blocks of a query are scored, and of
    the others only those whose bound reaches the k-th best score so far: lists of the others are not opened. within: only
    documents of these ids count, also for the best that scores are relative to.
    """
    asked = _asked(index, queries, query_id, query_text)
    lists = _lists(index, asked)
    bound = _part(index, F.col("most"), F.col("least"))
    bounds = lists.drop("p").groupBy("query", "generation", "block").agg(F.sum(F.col("weight") * bound).alias("bound"))
    order = Window.partitionBy("query").orderBy(F.desc("bound"), "generation", "block")
    bounds = bounds.withColumn("place", F.row_number().over(order))
    keys = ["query", "generation", "block"]
    first = _scored(index, lists.join(bounds.where(F.col("place") <= FIRST).select(*keys), keys, "left_semi"), within)
    best = Window.partitionBy("query").orderBy(F.desc("raw"))
    reached = first.withColumn("place", F.row_number().over(best)).where(F.col("place") == k).select("query", "raw")
    # scores are rounded relative to the best one, so a document a millionth of that behind may still tie
    slack = bounds.groupBy("query").agg(F.max("bound").alias("most"))
    least = slack.join(reached, "query", "left").select("query", (F.coalesce("raw", F.lit(0.0)) - F.col("most") * 2e-6).alias("least"))
    open_ = bounds.where(F.col("place") > FIRST).join(least, "query").where("bound >= least").select(*keys)
    raw = first.unionByName(_scored(index, lists.join(open_, keys, "left_semi"), within))
    order = Window.partitionBy("query").orderBy(F.desc("score"), "id")
    return _relative(reuse(raw)).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def opened(index: Index, queries: DataFrame, k: int, query_id: str = "item_id", query_text: str = "text") -> tuple[int, int]:
    """How many of the (query, block) pairs top() scores at most after its first ones, and how many there are: a measure of the bounds."""
    asked = _asked(index, queries, query_id, query_text)
    lists = _lists(index, asked)
    bounds = reuse(lists.groupBy("query", "generation", "block").agg(F.sum(F.col("weight") * _part(index, F.col("most"), F.col("least"))).alias("bound")))
    raw = _scored(index, lists).withColumn("place", F.row_number().over(Window.partitionBy("query").orderBy(F.desc("raw")))).where(F.col("place") == k).select("query", "raw")
    return bounds.join(raw, "query", "left").where("bound >= coalesce(raw, 0)").count(), bounds.count()


def gate(index: Index, queries: DataFrame, candidates: DataFrame, query_id: str = "item_id", query_text: str = "text") -> DataFrame:
    """(query, id, score) of candidates (query, id) alone, relative to the best of the whole index, from the floor.

    The candidates' own tokens come from the forward table; of the lists only what the best document needs is opened.
    """
    asked = _asked(index, queries, query_id, query_text)
    pairs = candidates.select("query", "id").distinct()
    docs = _live(index).join(pairs.select("id").distinct(), "id", "left_semi").select("id", F.size("tokens").alias("dl"), F.explode("tokens").alias("term"))
    found = docs.groupBy("id", "dl", "term").agg(F.count("*").alias("tf")).join(pairs, "id").join(asked.terms, ["query", "term"])
    raw = found.groupBy("query", "id").agg(F.sum(F.col("weight") * _part(index, F.col("tf"), F.col("dl"))).alias("raw"))
    best = _best(index, asked)
    return raw.join(best, "query").select("query", "id", F.round(F.col("raw") / F.col("top"), 6).alias("score")).where(F.col("score") >= DEFAULT.bm25_floor)


def _best(index: Index, asked: Asked) -> DataFrame:
    """(query, top): the best raw score of each query; blocks that cannot hold it are not opened."""
    lists = _lists(index, asked)
    bounds = reuse(lists.drop("p").groupBy("query", "generation", "block").agg(F.sum(F.col("weight") * _part(index, F.col("most"), F.col("least"))).alias("bound")))
    keys = ["query", "generation", "block"]
    ranked = bounds.withColumn("place", F.row_number().over(Window.partitionBy("query").orderBy(F.desc("bound"), "generation", "block")))
    first = _scored(index, lists.join(ranked.where(F.col("place") <= FIRST).select(*keys), keys, "left_semi")).groupBy("query").agg(F.max("raw").alias("raw"))
    first = reuse(first)
    open_ = ranked.where(F.col("place") > FIRST).join(first, "query", "left").where("bound >= coalesce(raw, 0)").select(*keys)
    rest = _scored(index, lists.join(open_, keys, "left_semi")).groupBy("query").agg(F.max("raw").alias("raw"))
    return first.unionByName(rest).groupBy("query").agg(F.max("raw").alias("top"))
