"""Quality classifier: Bradley-Terry ranking of documents from preference pairs, then a threshold at a score quantile."""

from __future__ import annotations

from collections.abc import Iterator
from operator import eq

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm.common import annotate, lowest_hashes, map_rows, table

#: Most labelled rows that the fit uses, those with the lowest hash of their id.
SAMPLE = 8000
#: Preference pairs, and steps, rate and ridge of the fit.
PAIRS, STEPS, RATE, RIDGE = 6000, 200, 0.05, 1e-3
#: Documents whose crc32(id) has remainder 0 are held out: their labels are never read.
FOLDS = 5
#: Where the score's threshold lies: scores from 0.3 are of documents to keep.
CUT = 0.3


N_FEATURES = 256 + 17


def features(texts: list[str | None]) -> np.ndarray:
    """A row of style features per text: frequencies of bytes, and of words and lines of some forms."""
    out = np.zeros((len(texts), N_FEATURES), np.float32)
    for k, text in enumerate(texts):
        raw = (text or "").encode("utf-8", "surrogatepass")
        n = len(raw)
        counts = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
        out[k, :256] = np.sqrt(counts / max(n, 1))
        words, lines = raw.split(), raw.split(b"\n")
        w, ln = max(len(words), 1), max(len(lines), 1)
        upper, lower, digits = counts[65:91].sum(), counts[97:123].sum(), counts[48:58].sum()
        distinct, distinct_lines = len(set(words)), len(set(lines))
        out[k, 256:] = (
            np.log1p(n) / 10, np.log1p(w) / 10, n / w / 20, distinct / w, np.log1p(w / max(distinct, 1)), distinct_lines / ln, ln / w,
            upper / max(n, 1), upper / max(upper + lower, 1), digits / max(n, 1), (n - upper - lower - digits) / max(n, 1),
            counts[33:48].sum() / w, counts[58:65].sum() / w, counts[91:97].sum() / w, counts[123:127].sum() / w, counts[128:].sum() / max(n, 1),
            sum(map(eq, words, words[1:])) / w,
        )
    return out


class Ranker:
    """Raw scores w x of standardised rows, and scores from 0 to 1 that reach CUT where the raw ones reach cut."""

    def __init__(self, mean: np.ndarray, scale: np.ndarray, w: np.ndarray, cut: float) -> None:
        self.mean, self.scale, self.w, self.cut = mean, scale, w, cut

    def raw(self, x: np.ndarray) -> np.ndarray:
        return np.clip((x - self.mean) / self.scale, -8, 8) @ self.w

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.raw(x) - self.cut + np.log(CUT / (1 - CUT)), -30, 30)))


def fit(x: np.ndarray, y: np.ndarray, seed: int = 7) -> Ranker:
    """Ranks rows with y = 1 above rows with y = 0; its cut is the raw score at the quantile that label 0 takes up.

    Minimises the mean of log(1 + exp(-w (a - b))) over pairs of a preferred row a and another row b, by Adam. Without
    rows of both labels all weights are 0, and all rows are kept if there is no row with y = 0.
    """
    if not len(x) or (y == 1).all() or (y == 0).all():
        return Ranker(np.zeros(x.shape[1]), np.ones(x.shape[1]), np.zeros(x.shape[1]), 5.0 if len(x) and (y == 0).all() else -5.0)
    mean, scale = x.mean(0), x.std(0)
    scale = np.where(scale < 1e-4, np.inf, scale)  # a constant feature says nothing
    model = Ranker(mean, scale, np.zeros(x.shape[1]), 0.0)
    z = np.clip((x - mean) / scale, -8, 8)
    rng = np.random.default_rng(seed)
    diff = (z[rng.choice(np.flatnonzero(y == 1), PAIRS)] - z[rng.choice(np.flatnonzero(y == 0), PAIRS)]).astype(np.float32)
    w, m, v = (np.zeros(x.shape[1], np.float32) for _ in range(3))
    for t in range(1, STEPS + 1):
        g = RIDGE * w - (1 / (1 + np.exp(np.clip(diff @ w, -30, 30)))) @ diff / PAIRS
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        w = w - RATE * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    model.w = w.astype(np.float64)
    raw = np.sort(model.raw(x))
    k = int((y == 0).sum())
    model.cut = float((raw[k - 1] + raw[k]) / 2)
    return model


def _fold(id_col: str, n: int) -> Column:
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % n


def _featured(cols: dict) -> Iterator[dict]:
    yield {"y": cols["y"], "x": features(cols["text"])}


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> Ranker:
    """Fit on at most SAMPLE labelled documents outside the held-out fold; features are computed where the texts are."""
    known = (
        labels.where(F.col(id_col).isNotNull() & F.col(label_col).isin(0, 1) & (_fold(id_col, FOLDS) != 0))
        .select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("y"))
    )
    known = lowest_hashes(known, "id", SAMPLE).dropDuplicates(["id"])
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(F.broadcast(known), "id").select("y", "text")  # broadcast: SAMPLE rows at most
    got = map_rows(rows, _featured, "y int, x array<float>").toArrow()
    x = np.array(got["x"].to_pylist(), np.float64).reshape(-1, N_FEATURES)
    order = np.lexsort((*x.T[:3], got["y"].to_numpy()))  # not the order in which tasks end
    return fit(x[order], got["y"].to_numpy()[order])


def _scored(cols: dict, model: Ranker) -> Iterator[dict]:
    yield {"score": model.score(features(cols["text"]).astype(np.float64))}


def classify_rows(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> DataFrame:
    """The columns of docs, as annotate() names them, with score and predicted of classify()."""
    model = train(docs, labels, id_col, text_col, label_col)
    return annotate(docs, _scored, "score double", model, text_col=text_col).withColumn("predicted", (F.col("score") >= CUT).cast("int"))


def classify(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> DataFrame:
    """One row per row of docs: doc_id, held_out, score, predicted (1 if score >= CUT, else 0).

    A score depends on the text alone, whole; a null text counts as empty. Rows with a null id are held out. Labels that
    are null, not 0 or 1, or of unknown documents are passed over; of several labels of a document one counts. Without
    labels all documents score alike and are kept. An empty table gives no rows; other columns are ignored.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    scored = classify_rows(rows, labels.select(F.col(id_col).alias("id"), F.col(label_col).alias("y")), "id", "text", "y")
    fold = F.coalesce(_fold("_c0", FOLDS) == 0, F.lit(True))
    return scored.select(F.col("_c0").alias(id_col), fold.alias("held_out"), "score", "predicted")


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
