"""Versioned Parquet stores: upsert, delete, diff, audit, and small governed registries."""

from __future__ import annotations

import json
import os
import re
import uuid
from collections.abc import Callable
from pathlib import Path

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quarry.operators import scans


def upsert(store: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """store with all rows of the new rows' keys replaced."""
    return store.join(new.select(key).distinct(), key, "left_anti").unionByName(new)


def remove(store: DataFrame, key: str, values: DataFrame) -> DataFrame:
    return store.join(values.select(key).distinct(), key, "left_anti")


#: Generations that a store may consist of before they are written as one.
COMPACT = 16


def exists(spark: SparkSession, path: str) -> bool:
    try:
        spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    except AnalysisException as e:
        if "PATH_NOT_FOUND" in str(e):
            return False
        raise
    return True


_POINTER = "number long, generations array<string>, key string, facts string"


def _create(spark: SparkSession, file: str, content: str) -> bool:
    """Make a file that appears whole, unless there is one of that name; of several writers one succeeds.

    Local files appear by a hard link, others by a rename that fails where its target exists, as that of HDFS does.
    """
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(file)
    system = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    beside = jvm.org.apache.hadoop.fs.Path(target.getParent(), f".{uuid.uuid4().hex}")
    if system.getUri().getScheme() == "file":
        local = Path(target.toUri().getPath())
        local.parent.mkdir(parents=True, exist_ok=True)
        draft = local.parent / beside.getName()
        draft.write_text(content, encoding="utf-8")
        try:
            os.link(draft, local)
        except FileExistsError:
            return False
        finally:
            draft.unlink()
        return True
    out = system.create(beside, True)
    out.write(bytearray(content.encode()))
    out.close()
    if system.rename(beside, target):
        return True
    system.delete(beside, False)
    return False


def _pointer(spark: SparkSession, path: str) -> tuple[int, list[str], str | None, dict]:
    """Number, generations, key and facts of the newest pointer; (0, [], None, {}) of a store that was never published."""
    begun = exists(spark, f"{path}/generations")  # a store's first pointer is there before its first generation
    if exists(spark, f"{path}/pointers"):
        row = spark.read.schema(_POINTER).json(f"{path}/pointers").orderBy(F.desc("number"), F.desc(F.array_join("generations", " "))).first()
        if row is not None:
            return row["number"], list(row["generations"]), row["key"], json.loads(row["facts"] or "{}")
    if begun:
        raise ValueError(f"{path} has generations but no pointer to one; it is not taken for an empty store")
    return 0, [], None, {}


def _switch(spark: SparkSession, path: str, generations: list[str], number: int, key: str | None = None, facts: dict | None = None) -> bool:
    """Claim the pointer of that number; False if another writer has it. Pointers are only ever added; a crash leaves the one before."""
    row = {"number": number, "generations": generations, "key": key, "facts": json.dumps(facts or {}, sort_keys=True)}
    return _create(spark, f"{path}/pointers/{number:012d}.json", json.dumps(row) + "\n")


def new_generation(spark: SparkSession, path: str) -> str:
    """Where the next generation of a store goes; the store is begun with an empty pointer if it is new."""
    if not _pointer(spark, path)[0] and not exists(spark, f"{path}/pointers"):
        _switch(spark, path, [], 0)
    return f"{path}/generations/{uuid.uuid4().hex}"


def advance(spark: SparkSession, path: str, change: Callable[[list[str], dict], tuple[list[str], str | None, dict]]) -> tuple[list[str], dict]:
    """Add a pointer to what change(generations, facts) makes of the newest one; any number of writers at a time.

    A writer that finds its number taken starts again from the newest pointer, so nothing that another has added is lost.
    """
    while True:
        number, generations, _, facts = _pointer(spark, path)
        new, key, told = change(generations, facts)
        if _switch(spark, path, new, number + 1, key, told):
            return new, told


def publish(df: DataFrame, path: str) -> str:
    """Write a generation beside the others, then add a pointer to it; readers see the old or the new one whole.

    It replaces all that was there, of other writers too; a generation whose writer died before the pointer is never read.
    """
    spark = df.sparkSession
    generation = new_generation(spark, path)
    df.write.parquet(generation)
    advance(spark, path, lambda *_: ([generation], None, {}))
    return generation


def publish_changes(df: DataFrame, path: str, key: str) -> str:
    """Add a generation of rows that replace those of their keys; only df is written, until COMPACT generations are made one.

    Of several writers each adds its own, in the order of their pointers.
    """
    spark = df.sparkSession
    generation = new_generation(spark, path)
    df.write.parquet(generation)

    def add(generations: list[str], facts: dict) -> tuple[list[str], str, dict]:
        if len(generations) < COMPACT:
            return [*generations, generation], key, facts
        whole = new_generation(spark, path)
        upsert(_rows(spark, path, generations, key), spark.read.parquet(generation), key).write.parquet(whole)
        return [whole], key, facts

    return advance(spark, path, add)[0][-1]


def mutate(spark: SparkSession, path: str, key: str, change: Callable[[DataFrame | None], DataFrame]) -> str:
    """Read, modify, write: change(rows), of None for a new store, gives rows that replace those of their keys.

    If another writer was first, change is asked again about the rows as they are then.
    """

    def again(generations: list[str], facts: dict) -> tuple[list[str], str, dict]:
        generation = new_generation(spark, path)
        change(_rows(spark, path, generations, key) if generations else None).write.parquet(generation)
        return [*generations, generation], key, facts

    return advance(spark, path, again)[0][-1]


def source_changed(spark: SparkSession, path: str, known: int) -> bool:
    """Whether the store has a pointer after the one of number known: a poll before each question."""
    return _pointer(spark, path)[0] != known


def version(spark: SparkSession, path: str) -> int:
    """Number of the newest pointer, 0 of a store that was never published."""
    return _pointer(spark, path)[0]


def current(spark: SparkSession, path: str, key: str | None = None) -> DataFrame:
    """The store's rows. Of several generations a key's rows are those of the last one that has it."""
    _, generations, own, _ = _pointer(spark, path)
    if not generations:
        raise FileNotFoundError(f"nothing was published at {path}")
    return _rows(spark, path, generations, key or own)


def _rows(spark: SparkSession, path: str, generations: list[str], key: str | None) -> DataFrame:
    if len(generations) == 1:
        return spark.read.parquet(generations[0])
    if key is None:
        raise ValueError(f"{path} has several generations; name the key")
    rows = None
    for k, generation in enumerate(generations):
        part = spark.read.parquet(generation).withColumn("_g", F.lit(k))
        rows = part if rows is None else rows.unionByName(part, allowMissingColumns=True)
    last = rows.groupBy(key).agg(F.max("_g").alias("_g"))
    return rows.join(last, [key, "_g"], "left_semi").drop("_g")


def publish_run(spark: SparkSession, path: str, run_id: str, tables: dict[str, DataFrame], failed: bool = False, facts: dict | None = None) -> dict:
    """Write the tables of a run, then one manifest that names them all with their rows; returns the manifest.

    A run is there with its manifest or not at all: tables of a run that died are never read. A run_id is published once;
    a second writer of it gets a FileExistsError and its tables stay unread.
    """
    if not re.fullmatch(r"[A-Za-z0-9][A-Za-z0-9._-]{0,99}", run_id):
        raise ValueError(f"{run_id!r} is no run id: letters, digits, dots, underscores and hyphens")
    if exists(spark, f"{path}/manifests/{run_id}.json"):
        raise FileExistsError(f"run {run_id} is published")
    folder, out = f"{path}/runs/{run_id}-{uuid.uuid4().hex}", {}
    for name, df in tables.items():
        df.write.parquet(f"{folder}/{name}")
        out[name] = {"path": f"{folder}/{name}", "rows": spark.read.parquet(f"{folder}/{name}").count(), "columns": df.columns}
    manifest = {"run_id": run_id, "failed": failed, "tables": out, "facts": facts or {}}
    if not _create(spark, f"{path}/manifests/{run_id}.json", json.dumps(manifest, sort_keys=True) + "\n"):
        raise FileExistsError(f"run {run_id} is published")
    return manifest


def manifest(spark: SparkSession, path: str, run_id: str) -> dict:
    """A run's manifest; FileNotFoundError for one that was never published."""
    if not exists(spark, f"{path}/manifests/{run_id}.json"):
        raise FileNotFoundError(f"run {run_id} was not published")
    return json.loads(spark.read.text(f"{path}/manifests/{run_id}.json").first()["value"])


def run_table(spark: SparkSession, path: str, run_id: str, name: str) -> DataFrame:
    """A table of a published run; an error if it does not have the rows that the manifest tells."""
    told = manifest(spark, path, run_id)["tables"][name]
    df = spark.read.parquet(told["path"])
    if df.count() != told["rows"]:
        raise ValueError(f"run {run_id}: {name} does not have its {told['rows']} rows")
    return df


def runs(spark: SparkSession, path: str) -> DataFrame:
    """(run_id, failed, name, rows): the tables of all published runs."""
    if not exists(spark, f"{path}/manifests"):
        return spark.createDataFrame([], "run_id string, failed boolean, name string, rows long")
    schema = "run_id string, failed boolean, tables map<string, struct<path:string,rows:bigint>>"
    return spark.read.schema(schema).json(f"{path}/manifests").select("run_id", "failed", F.explode("tables").alias("name", "t")).select("run_id", "failed", "name", F.col("t.rows").alias("rows"))


def load_strict(spark: SparkSession, path: str, key: str, rows: int | None = None) -> DataFrame:
    """The store, or an error: a pointer, no null or repeated key, and as many rows as told."""
    df = current(spark, path, key)
    found = df.agg(F.count("*").alias("n"), F.countDistinct(key).alias("keys"), F.count(F.when(F.col(key).isNull(), 1)).alias("nulls")).first()
    if found["nulls"] or found["keys"] != found["n"] or rows is not None and found["n"] != rows:
        raise ValueError(f"{path}: {found['n']} rows, {found['keys']} keys, {found['nulls']} without one, {rows} expected")
    return df


def restore_vectors(chunks: DataFrame, vecs: DataFrame, schemas: list[str]) -> DataFrame:
    """chunks (row_id, content) with vector of vecs (row_id, vector, content_md5, schema, generation); an error unless they fit.

    Every chunk has one vector, made from this content under an accepted schema and in one generation, of one dimension.
    """
    j = chunks.join(vecs.select("row_id", "vector", "content_md5", "schema", "generation"), "row_id", "full_outer")
    bad = F.col("content").isNull() | F.col("vector").isNull() | (F.md5(F.col("content").cast("binary")) != F.col("content_md5")) | ~F.col("schema").isin(schemas)
    found = j.agg(F.count(F.when(bad, 1)).alias("bad"), F.countDistinct("generation").alias("generations"), F.countDistinct(F.size("vector")).alias("sizes"), F.count("*").alias("n"), F.countDistinct("row_id").alias("ids")).first()
    if found["bad"] or found["generations"] > 1 or found["sizes"] > 1 or found["n"] != found["ids"]:
        raise ValueError(f"chunks and vectors differ: {found.asDict()}")
    return j.drop("content_md5", "schema", "generation")


def aligned(index: DataFrame, symbols: DataFrame, fields: list[str]) -> DataFrame:
    """One row: whether index and symbols agree in all fields at each place ord, and how many places do not."""
    a, b = index.select("ord", F.struct(*fields).alias("a")), symbols.select("ord", F.struct(*fields).alias("b"))
    differ = F.count(F.when(~F.col("a").eqNullSafe(F.col("b")), 1))
    return a.join(b, "ord", "full_outer").agg(F.count("*").alias("places"), differ.alias("differ"), (differ == 0).alias("aligned"))


def guard(store: DataFrame, expected: DataFrame, key: str, revision: str) -> None:
    """Compare and set: an error if a key's newest revision is not the expected one (key, revision)."""
    now = store.groupBy(key).agg(F.max(revision).alias("_now"))
    moved = expected.join(now, key, "left").where(~F.col(revision).eqNullSafe(F.col("_now"))).limit(5).collect()
    if moved:
        raise ValueError("changed since: " + ", ".join(str(r[key]) for r in moved))


def remember(spark: SparkSession, path: str, rows: DataFrame, model: str) -> None:
    """Add vectors (md5, vector) of a model to a cache."""
    rows.withColumn("model", F.lit(model)).write.mode("append").partitionBy("model").parquet(path)


def recall(spark: SparkSession, path: str, keys: DataFrame, model: str) -> DataFrame:
    """(md5, vector) of keys (md5) that the cache has for the model; of several entries of a key one."""
    if not exists(spark, path):
        return spark.createDataFrame([], "md5 string, vector array<double>")
    return spark.read.parquet(path).where(F.col("model") == model).join(keys.select("md5"), "md5", "left_semi").groupBy("md5").agg(F.first("vector").alias("vector"))


def fingerprint(*parts: Column) -> Column:
    """SHA-256 over named parts as canonical JSON."""
    return F.sha2(F.to_json(F.struct(*parts)), 256)


def append_log(rows: DataFrame, path: str) -> None:
    """Add rows to a log of JSON lines: interactions, metrics, raw analyses."""
    rows.write.mode("append").json(path)


def status(chunks: DataFrame) -> DataFrame:
    """One row: chunks, sources, types, share with vectors in whole per cent."""
    n = F.count("*")
    return chunks.agg(n.alias("chunks"), F.countDistinct("source").alias("sources"), F.array_join(F.array_sort(F.collect_set("type")), ",").alias("types"), F.floor(F.count("vector") * 100 / n).cast("long").alias("percent"))


def content_digest(rows: DataFrame, group: str, order: list[str], text_col: str) -> DataFrame:
    """(group, n, digest): MD5 over the rows' own digests and lengths in order, taken in blocks so that a group may be of any size."""
    each = F.concat(F.lpad(F.length(text_col).cast("string"), 8, "0"), F.md5(F.col(text_col).cast("binary")))
    return scans.digests(rows, group, order, each)


def diff(a: DataFrame, b: DataFrame, key: list[str], fields: list[str]) -> DataFrame:
    """One row: rows only in a, only in b, in both, and differences by field."""
    left = a.select(*key, *[F.col(c).alias(f"a_{c}") for c in fields], F.lit(1).alias("in_a"))
    right = b.select(*key, *[F.col(c).alias(f"b_{c}") for c in fields], F.lit(1).alias("in_b"))
    n = lambda c: F.count(F.when(c, 1))
    both = F.col("in_a").isNotNull() & F.col("in_b").isNotNull()
    return left.join(right, key, "full_outer").agg(n(F.col("in_b").isNull()).alias("only_a"), n(F.col("in_a").isNull()).alias("only_b"), n(both).alias("both"), *[n(both & ~F.col(f"a_{c}").eqNullSafe(F.col(f"b_{c}"))).alias(f"diff_{c}") for c in fields])


def audit(chunks: DataFrame, group: str, text_col: str) -> DataFrame:
    """(group, chunks, empty, short, distinct_texts, chars)."""
    n = lambda c: F.count(F.when(c, 1))
    size = F.length(text_col)
    return chunks.groupBy(group).agg(F.count("*").alias("chunks"), n(F.coalesce(size, F.lit(0)) == 0).alias("empty"), n(size < 50).alias("short"), F.countDistinct(text_col).alias("distinct_texts"), F.sum(size).alias("chars"))


def vector_health(vecs: DataFrame, vec_col: str) -> DataFrame:
    """One row: vectors, dimensions, and how many are missing, not finite, or of norm 0."""
    n = lambda c: F.count(F.when(c, 1))
    v = F.col(vec_col)
    odd = F.exists(v, lambda x: F.isnan(x) | (F.abs(x) == float("inf")))
    zero = F.forall(v, lambda x: x == 0)
    return vecs.agg(F.count("*").alias("vectors"), F.countDistinct(F.size(v)).alias("dimensions"), n(v.isNull()).alias("missing"), n(odd).alias("not_finite"), n(zero).alias("zero"))


def misses(texts: DataFrame, cache: DataFrame, text_col: str = "text") -> DataFrame:
    """Distinct texts whose digest the cache lacks."""
    keyed = texts.select(F.md5(F.col(text_col).cast("binary")).alias("md5"), F.col(text_col).alias("text")).dropDuplicates(["md5"])
    return keyed.join(cache.select("md5"), "md5", "left_anti")


def active_rules(rules: DataFrame, project: str, today: Column) -> DataFrame:
    return rules.where((F.col("scope") == "global") | (F.col("project") == project)).where(F.col("review_by") >= today)


def rule_problem(c: str | Column) -> Column:
    """Why a rule's text is refused, '' if it is not."""
    t = F.col(c) if isinstance(c, str) else c
    return F.when(F.trim(t) == "", "empty").when(t.contains("\n"), "lines").when(F.length(t) > 200, "long").when(t.rlike(r"^\d{4}-\d\d-\d\d[ T]\d\d:|^\[?(DEBUG|INFO|WARN|ERROR)\]?\s|Traceback|^\$ "), "log").otherwise("")


def over_cap(rules: DataFrame, today: Column, most: int = 20) -> DataFrame:
    """(project, active) of projects whose own and global active rules exceed the cap."""
    live = rules.where(F.col("review_by") >= today)
    shared = live.where("scope = 'global'").agg(F.count("*").alias("shared"))
    own = live.where("scope <> 'global'").groupBy("project").agg(F.count("*").alias("own"))
    return own.crossJoin(F.broadcast(shared)).select("project", (F.col("own") + F.col("shared")).alias("active")).where(F.col("active") > most)


def newest(rows: DataFrame, key: str, order: str, n: int) -> DataFrame:
    return rows.withColumn("_n", F.row_number().over(Window.partitionBy(key).orderBy(F.desc(order)))).where(F.col("_n") <= n).drop("_n")
