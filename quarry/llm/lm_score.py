"""LM scoring: a log-bilinear neural model trained with noise-contrastive estimation scores whole texts.

The model's vocabulary is the most frequent training tokens and classes of all other tokens, by their last bytes. The
context vector is the sum of a vector of the last token and one of the token before it; its product with a token's vector,
plus the token's bias, is the score of the token. As exp(a + b) = exp(a) exp(b), the normalisers of all pairs of last
tokens are one matrix product of two tables of exponentials. Biases stay at the tokens' log frequencies. A rare token's
probability is that of its class times its count's share in the class; those counts cover the whole corpus and are joined in.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm.common import map_rows, materialize, table



@dataclass(frozen=True)
class Sizes:
    """Size bounds of the model: single tokens, classes of the others, width of vectors."""

    known: int = 3840
    classes: int = 256
    width: int = 16

    @property
    def out(self) -> int:
        return self.known + self.classes


SIZES = Sizes()
#: Training: positions in a batch, noise samples that a batch shares, rate, and the squared gradient below which a row's
#: steps are small.
BATCH, NOISE, RATE, DAMPING = 4096, 64, 0.1, 10.0
#: Passes of distributed training; each takes its own part of the documents, after which the tasks' models are averaged.
ROUNDS = 2
#: Most tokens whose counts go to every task, the most frequent ones; the counts of the others are joined. They are found by
#: a histogram of counts with STEPS steps for a doubling. Tokens of over LONGEST bytes are always joined, so what goes to
#: every task is bounded in bytes.
FREQUENT, STEPS, LONGEST = 200_000, 64, 64
#: Documents with this remainder of crc32(id) by FOLDS are held out of all training and counts.
FOLDS, HELD_OUT = 7, 2
END = b""  # the end token; no word is empty
_SPANS = 64


def tokens(text: str | None) -> list[bytes]:
    """Words of the text between ASCII white space, A to Z lower-cased, and the end token."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    words.append(END)
    return words


def class_of(token: bytes, classes: int) -> int:
    return zlib.crc32(token[-3:]) % classes


def _fold(id_col: str) -> Column:
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % FOLDS


def _counted(cols: dict) -> Iterator[dict]:
    counts: Counter = Counter()
    for text in cols["text"]:
        counts.update(tokens(text))
    yield {"token": list(counts.keys()), "c": list(counts.values())}


def count_tokens(train: DataFrame) -> DataFrame:
    """(token, c) over whole texts of train; tasks count their chunks first."""
    return map_rows(train.select("text"), _counted, "token binary, c long").groupBy("token").agg(F.sum("c").alias("c"))


class Model:
    """Vectors and biases; index sizes.out of the context tables is the start of a text."""

    def __init__(self, log_noise: np.ndarray, sizes: Sizes = SIZES, seed: int = 3) -> None:
        rng = np.random.default_rng(seed)
        self.sizes, self.log_noise = sizes, log_noise
        self.last, self.before, self.out = ((rng.standard_normal((n, sizes.width)) * 0.1).astype(np.float32) for n in (sizes.out + 1, sizes.out + 1, sizes.out))
        self.bias = log_noise.astype(np.float32).copy()
        self.log_z: np.ndarray | None = None

    def tables(self) -> tuple[np.ndarray, ...]:
        return self.last, self.before, self.out

    def pack(self) -> np.ndarray:
        return np.concatenate([x.ravel() for x in self.tables()])

    def unpack(self, flat: np.ndarray) -> None:
        at = 0
        for name in ("last", "before", "out"):
            x = getattr(self, name)
            setattr(self, name, flat[at : at + x.size].reshape(x.shape).astype(np.float32, copy=True))
            at += x.size

    def normalise(self) -> None:
        """Log of the sum of exponentials over all tokens, for each pair of last tokens, by blocks of pairs."""
        n = self.sizes.out + 1
        ahead = self.before @ self.out.T
        top = ahead.max(1)
        ahead = np.exp(ahead - top[:, None])
        self.log_z = np.empty((n, n), np.float32)
        for k in range(0, n, 512):
            base = self.last[k : k + 512] @ self.out.T + self.bias
            peak = base.max(1, keepdims=True)
            self.log_z[k : k + 512] = np.log(np.exp(base - peak) @ ahead.T + np.float32(1e-37)) + peak + top

    def log10(self, last: np.ndarray, before: np.ndarray, token: np.ndarray) -> np.ndarray:
        """log10 of the normalised probability of each token after its context."""
        q = self.last[last] + self.before[before]
        return (np.einsum("ij,ij->i", q, self.out[token]) + self.bias[token] - self.log_z[last, before]) / np.log(10)


def contexts(ids: np.ndarray, first: np.ndarray, start: int) -> tuple[np.ndarray, np.ndarray]:
    """Last token and the one before for each position, start outside the text; first: whether a text starts there."""
    last, before = np.full_like(ids, start), np.full_like(ids, start)
    last[1:] = ids[:-1]
    last[first] = start
    before[1:] = last[:-1]
    before[first] = start
    return last, before


def _scatter(rows: np.ndarray, values: np.ndarray, n: int) -> np.ndarray:
    return np.stack([np.bincount(rows, values[:, d], n) for d in range(values.shape[1])], 1)


class Trainer:
    """Noise-contrastive estimation with a rate per row that falls with its squared gradients."""

    def __init__(self, model: Model, seed: int) -> None:
        self.m, self.rng = model, np.random.default_rng(seed)
        self.noise = np.cumsum(np.exp(model.log_noise - model.log_noise.max()))
        self.noise /= self.noise[-1]
        self.squares = [np.full(len(x), DAMPING) for x in model.tables()]

    def step(self, last: np.ndarray, before: np.ndarray, token: np.ndarray) -> None:
        """Each position's token against NOISE tokens that the batch shares, drawn from the unigram distribution."""
        m = self.m
        n = m.sizes.out
        fake = np.searchsorted(self.noise, self.rng.random(NOISE)).clip(0, n - 1)
        q = m.last[last] + m.before[before]
        odds = np.log(NOISE)
        real = np.einsum("ij,ij->i", q, m.out[token]) + m.bias[token] - m.log_noise[token] - odds
        sham = q @ m.out[fake].T + (m.bias[fake] - m.log_noise[fake] - odds)
        g_real = -1 / (1 + np.exp(np.clip(real, -30, 30)))
        g_sham = 1 / (1 + np.exp(-np.clip(sham, -30, 30)))
        g_q = g_real[:, None] * m.out[token] + g_sham @ m.out[fake]
        g_out = _scatter(token, g_real[:, None] * q, n)
        np.add.at(g_out, fake, g_sham.T @ q)
        grads = _scatter(last, g_q, n + 1), _scatter(before, g_q, n + 1), g_out
        for x, g, s in zip(m.tables(), grads, self.squares, strict=True):
            s += (g * g).mean(1)
            x -= (RATE * g / np.sqrt(s)[:, None]).astype(np.float32)


def _encode(words: list[bytes], known: dict[bytes, int], classes: dict[bytes, int], sizes: Sizes) -> np.ndarray:
    """Numbers of tokens; classes holds those of endings so far."""
    return np.array([k if (k := known.get(w)) is not None else _class(w, classes, sizes) for w in words], np.int64)


def _class(token: bytes, seen: dict[bytes, int], sizes: Sizes) -> int:
    k = seen.get(token[-3:])
    if k is None:
        k = seen[token[-3:]] = sizes.known + class_of(token, sizes.classes)
    return k


def _train_part(batches: Iterator[pa.RecordBatch], model: Model, known: dict[bytes, int]) -> Iterator[pa.RecordBatch]:
    """A task's model after its documents, in slices by row of the parameters, and how many tokens it saw."""
    own = Model(model.log_noise, model.sizes)  # the one given may be shared by the tasks of a worker
    own.unpack(model.pack())
    fit, classes, seen = Trainer(own, 11), {}, 0
    held: list[np.ndarray] = []
    size = 0

    def train() -> None:
        nonlocal size
        ids = np.concatenate(held)
        first = np.zeros(len(ids), bool)
        first[np.cumsum([0] + [len(x) for x in held[:-1]])] = True
        last, before = contexts(ids, first, own.sizes.out)
        order = fit.rng.permutation(len(ids))
        for k in range(0, len(ids), BATCH):
            at = order[k : k + BATCH]
            fit.step(last[at], before[at], ids[at])
        held.clear()
        size = 0

    for batch in batches:
        for text in batch.column("text"):
            held.append(_encode(tokens(text.as_py()), known, classes, own.sizes))
            size += len(held[-1])
            seen += len(held[-1])
            if size >= 32 * BATCH:
                train()
    if held:
        train()
    if seen:
        parts = np.array_split(own.pack(), _SPANS)
        yield pa.RecordBatch.from_pydict({"span": list(range(_SPANS)), "seen": [seen] * _SPANS, "v": [x.tobytes() for x in parts]}, schema=pa.schema([("span", pa.int32()), ("seen", pa.int64()), ("v", pa.binary())]))


def _average(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Mean of each span of parameters over the tasks, weighted by tokens."""
    sums: dict[int, list] = {}
    for batch in batches:
        for span, seen, v in zip(*(batch.column(c).to_pylist() for c in ("span", "seen", "v")), strict=True):
            have = sums.setdefault(span, [0.0, 0])
            have[0] = have[0] + np.frombuffer(v, np.float32).astype(np.float64) * seen
            have[1] += seen
    yield pa.RecordBatch.from_pydict({"span": list(sums), "seen": [n for _, n in sums.values()], "v": [(x / n).astype(np.float32).tobytes() for x, n in sums.values()]}, schema=pa.schema([("span", pa.int32()), ("seen", pa.int64()), ("v", pa.binary())]))


def train(docs: DataFrame, top: list[tuple[bytes, int]], class_counts: np.ndarray, sizes: Sizes) -> tuple[Model, dict[bytes, int]]:
    """Train on all documents of docs (id, text), a part of them in each round; returns the model and its tokens."""
    known = {t: k for k, (t, _) in enumerate(top[: sizes.known])}
    counts = np.concatenate([np.array([c for _, c in top[: sizes.known]] + [0] * (sizes.known - len(known)), float), class_counts]) + 0.5
    model = Model(np.log(counts / counts.sum()), sizes)
    shared = docs.sparkSession.sparkContext
    for k in range(ROUNDS):
        part = docs.where(F.pmod(F.xxhash64("id", "text"), F.lit(ROUNDS)) == k).select("text")
        held = shared.broadcast((model, known))
        spans = part.mapInArrow(lambda batches, held=held: _train_part(batches, *held.value), "span int, seen long, v binary")
        # the parameters of a task move in spans and are averaged twice, so no task or driver holds all tasks' models
        kind = "span int, seen long, v binary"
        means = spans.repartition("span", F.spark_partition_id() % _SPANS).mapInArrow(_average, kind).repartition("span").mapInArrow(_average, kind).collect()
        if means:
            model = Model(model.log_noise, sizes)
            model.unpack(np.concatenate([np.frombuffer(v, np.float32) for _, v in sorted((r["span"], bytes(r["v"])) for r in means)]))
    model.normalise()
    return model, known


def frequent(counts: DataFrame) -> list[tuple[bytes, int]]:
    """The most frequent tokens of up to LONGEST bytes, FREQUENT at most, by falling count: all whose counts reach a step of the histogram."""
    counts = counts.where(F.octet_length("token") <= LONGEST)
    step = F.floor(F.log2("c") * STEPS).cast("int")
    cut, n = None, 0
    for row in sorted(counts.groupBy(step.alias("step")).agg(F.count("*").alias("n")).collect(), reverse=True):
        if n + row["n"] > FREQUENT:
            break
        cut, n = row["step"], n + row["n"]
    if cut is None:
        return []
    return sorted(((bytes(r["token"]), r["c"]) for r in counts.where(step >= cut).toLocalIterator()), key=lambda x: (-x[1], x[0]))


@dataclass
class Learned:
    """What scoring needs: the model, its tokens, frequent counts, all counts as a table, and sums by class."""

    model: Model
    index: dict[bytes, int]
    frequent: dict[bytes, int]
    counts: DataFrame
    total: int
    distinct: int
    class_n: np.ndarray
    class_v: np.ndarray


def learn(rows: DataFrame, sizes: Sizes = SIZES) -> Learned:
    """Counts over, and a model of, all rows (id, text)."""
    counts = materialize(count_tokens(rows), "counts")
    total, distinct = counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*")).first()
    top = frequent(counts)
    known = top[: sizes.known]
    rare = (F.octet_length("token") > LONGEST) | (F.col("c") < known[-1][1]) | ((F.col("c") == known[-1][1]) & (F.col("token") > F.lit(known[-1][0]))) if known else F.lit(True)
    of_class = (F.crc32(F.expr("substring(token, greatest(octet_length(token) - 2, 1), 3)")) % sizes.classes).cast("int")
    found = {r["k"]: (r["n"], r["v"]) for r in counts.where(rare).groupBy(of_class.alias("k")).agg(F.sum("c").alias("n"), F.count("*").alias("v")).collect()}
    class_n, class_v = (np.array([found.get(k, (0, 0))[i] for k in range(sizes.classes)], float) for i in (0, 1))
    model, index = train(rows, top, class_n, sizes)
    return Learned(model, index, dict(top), counts, total, distinct, class_n, class_v)


def score(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", sizes: Sizes = SIZES) -> DataFrame:
    """One row per row of docs: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score.

    Scores are log10 probabilities of the whole text with its end; null counts as empty, an empty text is its end alone.
    Rows whose crc32(id) has remainder HELD_OUT are not learned from; rows with a null id are held out as well. A document
    that occurs twice is scored twice (and counts twice). With nothing to learn from, all tokens are unknown. An empty table gives no
    rows; other columns are ignored.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    known = learn(rows.where(_fold("id") != HELD_OUT), sizes)
    total, distinct, counts = known.total, known.distinct, known.counts
    held = docs.sparkSession.sparkContext.broadcast((known.model, known.index, known.frequent, total, distinct, known.class_n, known.class_v))
    parts = materialize(map_rows(rows.select(F.monotonically_increasing_id().alias("row"), "id", "text"), _scored, "row long, id long, n_tokens long, n_known long, base double, score double, rare array<binary>, times array<int>", held), "scores")
    asked = parts.select("row", F.explode(F.arrays_zip("rare", "times")).alias("x")).select("row", F.col("x.rare").alias("token"), F.col("x.times").alias("times"))
    norm = float(np.log10(total + distinct + 1))
    c = F.coalesce(F.col("c"), F.lit(0))
    joined = asked.join(counts, "token", "left").groupBy("row").agg(
        F.sum(F.col("times") * F.when(c > 0, 1).otherwise(0)).alias("more_known"),
        F.sum(F.col("times") * (F.log10(c + 1) - norm)).alias("more_base"), F.sum(F.col("times") * F.log10(c + 1)).alias("more_score"),
    )
    return parts.drop("rare", "times").join(joined, "row", "left").select(
        F.col("id").alias(id_col), F.coalesce(_fold("id") == HELD_OUT, F.lit(True)).alias("held_out"), "n_tokens",
        (F.col("n_known") + F.coalesce("more_known", F.lit(0))).alias("n_known"), F.lit(total).cast("long").alias("train_tokens"),
        (F.col("base") + F.coalesce("more_base", F.lit(0.0))).alias("base_score"), (F.col("score") + F.coalesce("more_score", F.lit(0.0))).alias("score"),
    )


def _scored(cols: dict, held) -> Iterator[dict]:
    """Scores but for the counts of tokens that are not among the frequent ones; those tokens are returned."""
    model, known, frequent, total, distinct, class_n, class_v = held.value
    ids, lengths, n_known, base, extra, rare, times = [], [], [], [], [], [], []
    seen: dict[bytes, int] = {}
    sizes = model.sizes
    norm, log10 = np.log10(total + distinct + 1), np.log10
    for text in cols["text"]:
        words = tokens(text)
        lengths.append(len(words))
        ids.append(_encode(words, known, seen, sizes))
        c = np.array([frequent.get(w, 0) for w in words], np.int64)
        missing = Counter(w for w, n in zip(words, c.tolist(), strict=True) if not n)
        rare.append(list(missing.keys()))
        times.append(list(missing.values()))
        n_known.append(int((c > 0).sum()))
        base.append(float(log10(c[c > 0] + 1).sum() - norm * n_known[-1]))
        inner = (c > 0) & (ids[-1] >= sizes.known)
        extra.append(float(log10(c[inner] + 1).sum()))
    flat = np.concatenate(ids)
    starts = np.cumsum([0] + lengths[:-1])
    first = np.zeros(len(flat), bool)
    first[starts] = True
    logs = np.empty(len(flat))
    last, before = contexts(flat, first, sizes.out)
    for k in range(0, len(flat), BATCH):
        logs[k : k + BATCH] = model.log10(last[k : k + BATCH], before[k : k + BATCH], flat[k : k + BATCH])
    in_class = np.concatenate([np.zeros(sizes.known), log10(class_n + class_v + 1)])
    logs -= in_class[flat]
    yield {"row": cols["row"], "id": cols["id"], "n_tokens": lengths, "n_known": n_known, "base": base, "score": np.add.reduceat(logs, starts) + np.array(extra), "rare": rare, "times": times}


def op1_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score(table(spark, sf_dir, "documents"))
