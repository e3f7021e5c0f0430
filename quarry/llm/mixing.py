"""Mixing sources to target weights: document rates whose expected domain token totals meet targets.

A classifier fitted on a labelled table gives each document posteriors over domains (soft membership). Nonnegative rates
r then minimise the weighted squares of (sum of tokens * posterior * r - target) by projected gradient steps, which are in
proportion to a document's tokens, so that few rows have to be repeated. A step of one document needs the residuals of the
domains only, so a pass sums them up in parallel; rates are recomputed from the
residuals of the last steps, and written out every few of them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from quarry.llm import textvec
from quarry.llm.common import annotate, annotated, lowest_hashes, map_rows, materialize, table

DOMAINS = ("clean", "low", "toxic")
#: Shares of the output's expected tokens by domain. The first domain keeps its tokens, the others are set by it.
TARGETS = (0.97, 0.02, 0.01)
#: Rates are nonnegative and have no upper bound: a rare domain's documents are repeated as often as its target needs.
MOST = np.inf
#: Most labelled rows that the classifier is fitted on, those with the lowest hash of their id.
SAMPLE = 8000
BUCKETS = 1 << 18
#: Words that the classifier sees: those in the most documents of the sample, three at least.
CHOSEN = 1 << 15
STEPS, RATE, RIDGE = 60, 0.3, 1e-5
#: Gradient steps of the rates at most, and the largest residual, as a share of the total, at which they end.
ROUNDS, ENOUGH = 100, 1e-4
#: Steps that a pass repeats for each row before the rates so far are written out.
REPLAYS = 10


def features(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Byte frequencies of each text, hashed distinct words of all texts, their offsets by text, and numbers of words."""
    dense = np.zeros((len(texts), 257), np.float32)
    normals = []
    for k, text in enumerate(texts):
        raw = np.frombuffer((text or "").encode("utf-8", "surrogatepass"), np.uint8)
        dense[k, :256] = np.sqrt(np.bincount(raw, minlength=256) / max(len(raw), 1))
        dense[k, 256] = 1
        normals.append(textvec.normal(text))
    words, offsets = textvec.word_hashes(normals)
    counts = np.diff(offsets)
    keys = np.unique(np.repeat(np.arange(len(texts), dtype=np.int64), counts) << 18 | (words & np.uint64(BUCKETS - 1)).astype(np.int64))
    return dense, (keys & (BUCKETS - 1)).astype(np.int32), np.searchsorted(keys >> 18, np.arange(len(texts) + 1)), counts


class Domains:
    """Softmax regression on byte frequencies and hashed words."""

    def __init__(self, k: int) -> None:
        self.dense, self.sparse = np.zeros((257, k), np.float32), np.zeros((BUCKETS, k), np.float32)

    def posteriors(self, dense: np.ndarray, words: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        z = dense @ self.dense
        sums = np.zeros((len(words) + 1, z.shape[1]))
        np.cumsum(self.sparse[words], axis=0, dtype=np.float64, out=sums[1:])
        z = z + sums[offsets[1:]] - sums[offsets[:-1]]
        z = np.exp(z - z.max(1, keepdims=True))
        return z / z.sum(1, keepdims=True)


def fit(dense: np.ndarray, words: np.ndarray, offsets: np.ndarray, y: np.ndarray, k: int) -> Domains:
    """Full-batch gradient descent with per-weight rates; without rows all domains are equally likely."""
    model = Domains(k)
    if not len(y):
        return model
    of = np.repeat(np.arange(len(y)), np.diff(offsets))
    hot = np.eye(k, dtype=np.float64)[y]
    seen, inner = np.unique(words, return_inverse=True)
    sd, ss = np.full((257, k), 1e-8), np.full((len(seen), k), 1e-8)
    for _ in range(STEPS):
        g = (model.posteriors(dense, words, offsets) - hot) / len(y)
        gd = dense.T @ g + RIDGE * model.dense
        gs = np.stack([np.bincount(inner, g[of, j], len(seen)) for j in range(k)], 1) + RIDGE * model.sparse[seen]
        sd += gd * gd
        ss += gs * gs
        model.dense -= RATE * gd / np.sqrt(sd)
        model.sparse[seen] -= RATE * gs / np.sqrt(ss)
    return model


def _featured(cols: dict) -> Iterator[dict]:
    dense, words, offsets, _ = features(cols["text"])
    yield {"id": cols["id"], "y": cols["y"], "dense": dense, "words": [words[a:b].tolist() for a, b in zip(offsets, offsets[1:], strict=False)]}


def _marked(batches: Iterator[pa.RecordBatch], chosen: np.ndarray) -> Iterator[pa.RecordBatch]:
    """A bit for each chosen word in place of a row's words."""
    for b in batches:
        words = b.column("words")
        of = np.repeat(np.arange(b.num_rows), np.array(words.value_lengths()))
        flat = words.flatten().to_numpy()
        at = np.minimum(np.searchsorted(chosen, flat), max(len(chosen) - 1, 0))
        bits = np.zeros((b.num_rows, len(chosen)), bool)
        if len(chosen):
            there = chosen[at] == flat
            bits[of[there], at[there]] = True
        yield pa.RecordBatch.from_arrays([b.column("y"), b.column("dense"), pa.array([x.tobytes() for x in np.packbits(bits, 1)], pa.binary())], names=["y", "dense", "bits"])


def train(docs: DataFrame, labels: DataFrame) -> Domains:
    """Fit on at most SAMPLE labelled documents: toxic ones, else those of low quality, else clean ones.

    The driver gets 257 numbers and a bit for each of the CHOSEN words from each of them, however long their texts are.
    """
    known = labels.where("doc_id IS NOT NULL AND quality IN (0, 1) AND toxic IN (0, 1)").select(F.col("doc_id").alias("id"), F.expr("CASE WHEN toxic = 1 THEN 2 WHEN quality = 0 THEN 1 ELSE 0 END").alias("y"))
    known = lowest_hashes(known, "id", SAMPLE).dropDuplicates(["id"])
    rows = docs.select(F.col("doc_id").alias("id"), "text").join(F.broadcast(known), "id").select("id", "y", "text")  # broadcast: SAMPLE rows at most
    got = materialize(map_rows(rows, _featured, "id long, y int, dense array<float>, words array<int>"), "sample")
    most = got.select(F.explode("words").alias("w")).groupBy("w").agg(F.count("*").alias("n")).where("n >= 3").orderBy(F.desc("n"), "w").limit(CHOSEN).collect()
    chosen = np.array(sorted(r["w"] for r in most), np.int32)
    x = got.select("y", "dense", "words").mapInArrow(lambda batches: _marked(batches, chosen), "y int, dense array<float>, bits binary").toArrow()
    y, packed = x["y"].to_numpy(), x["bits"].to_pylist()
    order = np.array(sorted(range(len(y)), key=lambda k: (packed[k], y[k])), int)  # not the order in which tasks end
    words = [chosen[np.flatnonzero(np.unpackbits(np.frombuffer(packed[k], np.uint8), count=len(chosen)))] for k in order]
    offsets = np.concatenate([[0], np.cumsum([len(w) for w in words])]).astype(np.int64)
    dense = np.array(x["dense"].to_pylist(), np.float32).reshape(-1, 257)
    return fit(dense[order], np.concatenate([np.zeros(0, np.int32), *words]), offsets, y[order], len(DOMAINS))


def _posteriors(cols: dict, model: Domains) -> Iterator[dict]:
    dense, words, offsets, counts = features(cols["text"])
    yield {"n_tokens": counts, "p": model.posteriors(dense, words, offsets)}


def rates(q: np.ndarray, steps: list[np.ndarray]) -> np.ndarray:
    """Rates after all steps, from 1; q: tokens times posteriors of each document."""
    return _walk(q, steps, np.ones(len(q)), np.ones(len(q)), 0)[0]


def _walk(q: np.ndarray, steps: list[np.ndarray], r: np.ndarray, ahead: np.ndarray, done: int) -> tuple[np.ndarray, np.ndarray]:
    """Rates r, and the point ahead of them at which the next step is taken, after steps that follow on done earlier ones.

    A step subtracts tokens * posterior * step, the squares' gradient, and cuts off at 0; the point ahead goes on in the last step's direction
    (accelerated projected gradient).
    """
    for k, s in enumerate(steps, done + 1):
        last, r = r, np.clip(ahead - q @ s, 0, MOST)
        ahead = r + k / (k + 3) * (r - last)
    return r, ahead


def _columns(b: pa.RecordBatch, k: int) -> tuple[np.ndarray, ...]:
    """Tokens times posteriors, r and ahead of a batch."""
    return _expected(b, k), b.column("r").to_numpy(), b.column("ahead").to_numpy()


def _expected(b: pa.RecordBatch, k: int) -> np.ndarray:
    return b.column("n_tokens").to_numpy().astype(float)[:, None] * b.column("p").flatten().to_numpy().reshape(-1, k)


def _advanced(state: DataFrame, steps: list[np.ndarray], done: int, k: int) -> DataFrame:
    """state after the steps, written out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            q, r, ahead = _columns(b, k)
            r, ahead = _walk(q, steps, r, ahead, done)
            yield pa.RecordBatch.from_arrays([b.column("n_tokens"), b.column("p"), pa.array(r), pa.array(ahead)], names=["n_tokens", "p", "r", "ahead"])

    return materialize(state.mapInArrow(run, _STATE), "rates")


_STATE = "n_tokens long, p array<double>, r double, ahead double"


def _sums(state: DataFrame, steps: list[np.ndarray], done: int, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Expected tokens by domain at the present rates and at the point ahead, and second moments of a document's expected tokens."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals, moments = np.zeros((2, k)), np.zeros((k, k))
        for b in batches:
            q, r, ahead = _columns(b, k)
            totals += [x @ q for x in _walk(q, steps, r, ahead, done)]
            moments += q.T @ q
        yield pa.RecordBatch.from_pydict({"v": [np.concatenate([totals.ravel(), moments.ravel()]).tolist()]}, schema=pa.schema([("v", pa.list_(pa.float64()))]))

    parts = state.mapInArrow(run, "v array<double>").select(F.posexplode("v").alias("i", "x")).groupBy("i").agg(F.sum("x").alias("x")).collect()
    v = np.zeros(2 * k + k * k)
    for row in parts:
        v[row["i"]] = row["x"]
    return v[:k], v[k : 2 * k], v[2 * k :].reshape(k, k)


def _goal(totals: np.ndarray, targets: tuple[float | None, ...]) -> np.ndarray:
    return np.array([total if share is None else share / targets[0] * totals[0] for share, total in zip(targets, totals, strict=True)])


def solve(members: DataFrame, targets: tuple[float | None, ...] = TARGETS) -> list[np.ndarray]:
    """Steps after which the expected shares meet the targets, or come as near as nonnegative rates can.

    The first domain keeps its tokens, and the others get tokens in proportion to it; one without a target keeps its own.
    The squares are weighted by the inverse of the moments, for which a step of length 1 always descends. The steps end
    where the targets are met, where a step changes nothing, or after ROUNDS; mix() returns the residual that is left.
    """
    return _solve(members, targets)[0]


def _solve(members: DataFrame, targets: tuple[float | None, ...]) -> tuple[list[np.ndarray], float]:
    """The steps, and the largest residual after them as a share of the total."""
    k = len(targets)
    state = members.select("n_tokens", "p", F.lit(1.0).alias("r"), F.lit(1.0).alias("ahead"))
    totals, ahead, moments = _sums(state, [], 0, k)
    goal = _goal(totals, targets)
    scale = max(goal.sum(), 1)
    inverse = np.linalg.pinv(moments, rcond=1e-9, hermitian=True)
    steps: list[np.ndarray] = []
    done = 0
    while (unmet := np.abs(totals - goal).max() / scale) > ENOUGH and len(steps) < ROUNDS:
        if len(steps) - done == REPLAYS:
            state, done = _advanced(state, steps[done:], done, k), len(steps)
        steps.append(inverse @ (ahead - goal))
        last = totals
        totals, ahead, _ = _sums(state, steps[done:], done, k)
        if max(np.abs(totals - last).max(), np.abs(ahead - last).max()) < 1e-9 * scale:
            break
    return steps, float(unmet)


def mix_rows(docs: DataFrame, labels: DataFrame, targets: tuple[float | None, ...] = TARGETS) -> DataFrame:
    """The columns of docs, as annotate() names them, with n_tokens, p, rate, copies and unmet of mix()."""
    k = len(DOMAINS)
    model = train(docs, labels)
    members = materialize(annotate(docs, _posteriors, "n_tokens long, p array<double>", model), "members")
    steps, unmet = _solve(members, targets)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(rates(_expected(b, k), steps))], names=[*b.schema.names, "rate"])

    rated = members.mapInArrow(run, StructType([*members.schema.fields, StructField("rate", DoubleType())]))
    chance = F.pmod(F.xxhash64(annotated(docs, "doc_id"), annotated(docs, "text"), F.lit("mix")), F.lit(1 << 30)) / float(1 << 30)
    return rated.withColumn("copies", F.floor(F.col("rate") + chance).cast("long")).withColumn("unmet", F.lit(unmet))


def repeated(rows: DataFrame, copies: str) -> DataFrame:
    """Each row as often as the column copies says; many copies are made in blocks, so no row becomes one long array."""
    block = F.lit(10_000).cast("long")
    blocks = rows.where(F.col(copies) > 0).withColumn("_block", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col(copies) - 1) / block))))
    own = F.least(F.col(copies) - F.col("_block") * block, block)
    return blocks.withColumn("_copy", F.explode(F.sequence(F.lit(1).cast("long"), own))).drop("_block", "_copy")


def mix(docs: DataFrame, labels: DataFrame, targets: tuple[float | None, ...] = TARGETS) -> DataFrame:
    """One row per row of docs: doc_id, n_tokens (words), p_clean, p_low, p_toxic, rate, copies, unmet.

    copies: rate rounded down or up by a hash of id and text, so that its expectation is the rate. unmet: the largest
    residual of a domain, as a share of all tokens of the mix; over ENOUGH where no nonnegative rates meet the targets or
    ROUNDS were too few. A null text counts as empty and has no tokens; its rate follows its posteriors all the same.
    Labels with nulls or of unknown documents are passed over; without labels the posteriors are equal. Null ids and
    repeated rows count as rows of their own. An empty table gives no rows; other columns are ignored.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    found = mix_rows(rows, labels, targets)
    return found.select(F.col("_c0").alias("doc_id"), "n_tokens", *[F.col("p")[i].alias(f"p_{d}") for i, d in enumerate(DOMAINS)], "rate", "copies", "unmet")


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
