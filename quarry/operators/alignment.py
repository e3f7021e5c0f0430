"""Monotone alignment of rows: two sequences per key are paired in order, so no two pairs ever cross.

Sequences of equal length pair one to one, and one that is empty or a pair of too many rows pairs nothing; the JVM decides
these. What is left meets, a key at a time, in a dynamic programme over the likeness of texts.
"""

from __future__ import annotations

from collections import Counter
from difflib import SequenceMatcher
from itertools import accumulate

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.functions import text
from quarry.shipping import ensure_importable

# Costs of a gap and of an unlike pair, the least likeness of a pair, and the most comparisons of a key.
GAP, MISS, LEAST, CELLS = -0.6, -0.4, 0.5, 250_000
_PAIRS = "array<struct<row:bigint,other:bigint>>"
#: Share of the rows that a channel has to pair for its cells to count.
COVERED = 0.6


def likeness(a: str, b: str, matcher: SequenceMatcher | None = None, least: float = LEAST) -> float:
    """Ratcliff and Obershelp's ratio, or 0 where a cheap bound shows that it is under least; matcher: one that has b."""
    if a == b:
        return 1.0
    m = matcher or SequenceMatcher(None, "", b)
    m.set_seq1(a)
    return m.ratio() if m.real_quick_ratio() >= least and m.quick_ratio() >= least else 0.0


def pairs(left: list[str], right: list[str]) -> list[tuple[int, int]]:
    """Pairs (place, place) of the best alignment by Needleman and Wunsch; of equal ones, a pair before a gap on the right, a gap on the right before one on the left.

    Texts that both sides begin or end with, and that each has once, are paired in every best alignment: only what lies
    between is compared.
    """
    n, m, counts = len(left), len(right), (Counter(left), Counter(right))
    same = lambda i, j: left[i] == right[j] and counts[0][left[i]] == counts[1][left[i]] == 1
    lo = hi = 0
    while lo < min(n, m) and same(lo, lo):
        lo += 1
    while hi < min(n, m) - lo and same(n - 1 - hi, m - 1 - hi):
        hi += 1
    between = _best(left[lo : n - hi], right[lo : m - hi])
    return [*((i, i) for i in range(lo)), *((lo + i, lo + j) for i, j in between), *((n - i, m - i) for i in range(hi, 0, -1))]


def _best(left: list[str], right: list[str]) -> list[tuple[int, int]]:
    n, m = len(left), len(right)
    if not n or not m:
        return []
    like = [[0.0] * m for _ in left]
    for j, b in enumerate(right):
        matcher = SequenceMatcher(None, "", b)  # what it knows of b serves all of left
        for i, a in enumerate(left):
            like[i][j] = likeness(a, b, matcher)
    best = list(accumulate([0.0] + [GAP] * m))
    moves = []
    for i in range(n):
        row, move = [best[0] + GAP], []
        for j in range(m):
            options = (best[j] + (like[i][j] if like[i][j] >= LEAST else MISS), best[j + 1] + GAP, row[j] + GAP)
            move.append(options.index(max(options)))
            row.append(max(options))
        moves.append(move)
        best = row
    out, i, j = [], n - 1, m - 1
    while i >= 0 and j >= 0:
        step = moves[i][j]
        if step == 0 and like[i][j] >= LEAST:
            out.append((i, j))
        i, j = i - (step != 2), j - (step != 1)
    return out[::-1]


def align_rows(left: DataFrame, right: DataFrame, key: str, most: int = CELLS) -> DataFrame:
    """(key, strategy, n_left, n_right, pairs): for each key of left (key, row, text) its pairs (row, other), in order.

    strategy: count where both sides have as many rows, empty where right has none, too_large where the sides' product is
    over most, else dp. Blanks do not count in comparing, a null text counts as empty. Keys of right alone are left out;
    rows of a key are distinct, and a key's rows are those of one table, which meet in one task.
    """
    typed = lambda df: df.select(key, F.col("row").cast("long").alias("row"), F.coalesce("text", F.lit("")).alias("t"))
    both = _aligned(typed(left), typed(right), key, most)
    met = F.filter(F.zip_with("a", "partner", lambda x, p: F.struct(x["row"].alias("row"), F.get(F.col("b"), p)["row"].alias("other"))), lambda x: x["other"].isNotNull())
    return both.select(key, "strategy", "n_left", "n_right", met.cast(_PAIRS).alias("pairs"))


def _aligned(left: DataFrame, right: DataFrame, key: str, most: int = CELLS) -> DataFrame:
    """(key, strategy, n_left, n_right, a, b, partner): a key's rows (row, t, and what else they have) in order, and for each one of a the place in b of its partner or null."""
    ensure_importable(left.sparkSession)
    others = lambda df: [c for c in df.columns if c not in (key, "row", "t")]
    rows = lambda df, name: df.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("row", text.collapse_blanks("t").alias("t"), *others(df)))).alias(name))
    a, b = rows(left, "a"), rows(right, "b")
    both = a.join(b, key, "left").withColumn("b", F.coalesce("b", F.array().cast(b.schema["b"].dataType)))
    n, m = F.size("a").cast("long"), F.size("b").cast("long")
    strategy = F.when(n == m, "count").when(m == 0, "empty").when(n * m > most, "too_large").otherwise("dp")
    both = both.select(key, strategy.alias("strategy"), n.alias("n_left"), m.alias("n_right"), "a", "b")

    @F.pandas_udf("array<int>")
    def solve(a: pd.Series, b: pd.Series) -> pd.Series:
        out = []
        for x, y in zip(a, b, strict=True):
            if x is None:
                out.append(None)
                continue
            found = dict(pairs(list(x), list(y)))
            out.append([found.get(i) for i in range(len(x))])
        return pd.Series(out, dtype=object)

    texts = lambda c: F.when(F.col("strategy") == "dp", F.transform(c, lambda x: x["t"]))
    solved = both.withColumn("_dp", solve(texts("a"), texts("b")))
    places = F.transform("a", lambda x, i: F.when(F.col("strategy") == "count", i))
    return solved.withColumn("partner", F.coalesce("_dp", places)).drop("_dp")


def verdicts(cells: DataFrame, channel: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """Cells (key, row, col, text) against one channel's: (key, row, col, verdict), and blockers (key, blocker, detail).

    Rows are aligned by their cells in order of col. A cell is a match or differs from that of its row's partner, or is none
    where that row has no such cell; cells of rows without a partner are unanchored. A channel that pairs under COVERED of a
    key's rows says nothing about it: all none. Blanks do not count in comparing. Rows never cross.
    """
    cell = F.struct("col", F.coalesce("text", F.lit("")).alias("t"))
    flat = F.transform("c", lambda x: F.struct(x["col"].alias("col"), text.collapse_blanks(x["t"]).alias("t")))
    met = lambda df: df.groupBy(key, F.col("row").cast("long").alias("row")).agg(F.array_sort(F.collect_list(cell)).alias("c"))
    joined = lambda df: met(df).select(key, "row", F.array_join(F.transform("c", lambda x: x["t"]), " | ").alias("text"))
    whole = lambda df: met(df).select(key, "row", F.array_join(F.transform("c", lambda x: x["t"]), " | ").alias("t"), flat.alias("cells"))
    # a key's rows carry their cells, so that cells meet where their rows are aligned
    both = _aligned(whole(cells.where(F.col(key).isNotNull())), whole(channel), key)
    paired = F.size(F.filter("partner", lambda p: p.isNotNull()))
    both = both.withColumn("used", (paired > 0) & (paired >= COVERED * F.col("n_left")))

    def judged(x: Column, p: Column) -> Column:
        other = F.get(F.col("b"), p)["cells"]
        none = lambda c: F.struct(c["col"].alias("col"), F.when(F.col("used") & p.isNull(), "unanchored").otherwise("none").alias("verdict"))
        seen = lambda c: F.filter(F.when(F.col("used"), other), lambda y: y["col"] == c["col"])
        compared = lambda c: F.transform(seen(c), lambda y: F.struct(c["col"].alias("col"), F.when(c["t"] == y["t"], "match").otherwise("differ").alias("verdict")))
        found = F.flatten(F.transform(x["cells"], lambda c: F.when(F.size(seen(c)) > 0, compared(c)).otherwise(F.array(none(c)))))
        return F.transform(found, lambda v: F.struct(x["row"].alias("row"), v["col"].alias("col"), v["verdict"].alias("verdict")))

    judgements = both.select(key, F.inline(F.flatten(F.zip_with("a", "partner", judged))))
    aligned = align_rows(joined(cells), joined(channel), key)
    covered = (F.size("pairs") > 0) & (F.size("pairs") >= COVERED * F.col("n_left"))
    size = F.size("pairs").cast("long")
    found = F.array(
        F.when(~covered, F.struct(F.lit("row_alignment_failed").alias("blocker"), size.alias("detail"))),
        F.when(covered & (size < F.col("n_right")), F.struct(F.lit("missing_rows").alias("blocker"), (F.col("n_right") - size).alias("detail"))),
        F.when(covered & (size < F.col("n_left")), F.struct(F.lit("unanchored_rows").alias("blocker"), (F.col("n_left") - size).alias("detail"))),
    )
    blockers = aligned.select(key, F.inline(F.filter(found, lambda x: x.isNotNull())))
    return judgements, blockers
