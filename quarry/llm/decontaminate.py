"""Benchmark decontamination: q-gram lemma filter in overlapping diagonal bands, then banded alignment.

Benchmark items are cut into windows of WORDS words, one from each word on. A text region within e edits of a window of m
characters shares at least m - q + 1 - q e q-grams with it, all on diagonals (text position minus window position) no
more than e from the region's. So shared q-grams are counted in bands of diagonals of width 2 e + 1 that overlap by e at
each side, windows with too few in a band are dropped, and the rest are verified by an alignment inside the band. Windows
whose bound is not positive at Q are filtered by the shorter q-grams of SHORT_Q, at which it always is.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain, pairwise

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm import textvec
from quarry.llm.common import annotate, annotated, numbered, table

#: Characters (bytes) of a q-gram, most characters of a window, and the share of its characters that edits may change.
Q, WINDOW, EDITS = 10, 120, 0.08
#: Words of a window; one that would be longer than WINDOW is cut off there.
WORDS = 13
#: Characters of a q-gram for windows too short for Q: m - q (e + 1) is positive for all m from Q on.
SHORT_Q = 6
#: Benchmark text that goes to the executors at a time; a larger benchmark is taken in blocks of this size.
BLOCK_BYTES = 8 << 20
#: Places of q-grams in items that are looked at together.
POSTINGS = 2_000_000
_BITS = 22
_P = (np.uint32(0x9E3779B1), np.uint32(0x85EBCA6B), np.uint32(0xC2B2AE35), np.uint32(0x27D4EB2F))


def qgrams(a: np.ndarray, q: int = Q) -> np.ndarray:
    """32-bit hashes of all runs of q bytes, Q = 10 or SHORT_Q = 6."""
    h1 = a.astype(np.uint32) + np.uint32(1)
    h2 = h1[:-1] * _P[0] + h1[1:]
    h4 = h2[:-2] * _P[1] + h2[2:]
    h = (h4[:-4] * _P[2] + h4[4:])[:-2] * _P[3] + h2[8:] if q == Q else h4[:-2] * _P[3] + h2[4:]
    h ^= h >> np.uint32(15)
    h *= _P[1]
    return h ^ (h >> np.uint32(13))


def spans(b: bytes) -> list[tuple[int, int]]:
    """Start and end of the windows of an item: every run of WORDS words holds one, as does every long run of characters.

    An item of fewer words and of at most WINDOW characters is one window. In long words windows start at every 2 Q
    characters, so scripts without spaces are covered too.
    """
    a = np.frombuffer(b, np.uint8)
    ends = np.append(np.flatnonzero(a == 32), len(b))
    starts = np.append(0, ends[:-1] + 1)
    counts = (ends - starts - 1) // (2 * Q) + 1
    word = np.repeat(np.arange(len(starts)), counts)
    s = starts[word] + textvec._ranges(counts) * 2 * Q
    whole = word + WORDS <= len(starts)
    e = np.minimum(np.where(whole, ends[np.minimum(word + WORDS, len(ends)) - 1], len(b) + WINDOW), s + WINDOW)
    full = e <= len(b)
    s, e = s[full].tolist(), e[full].tolist()
    if not s or e[-1] < len(b):
        s.append(max(len(b) - WINDOW, 0))
        e.append(len(b))
    return sorted(set(zip(s, e, strict=True)))


class Windows:
    """Windows as byte strings, cut out of the items when asked for."""

    def __init__(self, texts: list[bytes], of: np.ndarray, start: np.ndarray, end: np.ndarray) -> None:
        self.texts, self.of, self.start, self.end = texts, of, start, end

    def __len__(self) -> int:
        return len(self.of)

    def __getitem__(self, w: int) -> bytes:
        if not 0 <= w < len(self.of):
            raise IndexError(w)
        return self.texts[self.of[w]][self.start[w] : self.end[w]]


class Grams:
    """Places of the q-grams of items, for the windows given by number."""

    def __init__(self, q: int, texts: list[bytes], windows: Windows, chosen: np.ndarray, edits: np.ndarray) -> None:
        self.q, self.number, self.most = q, chosen, int(edits.max(initial=0))
        self.start, self.end = windows.start[chosen], windows.end[chosen]
        self.key = windows.of[chosen] << 32 | self.start  # sorted, as windows are
        self.least = self.end - self.start - q + 1 - q * edits[chosen]
        used = np.unique(windows.of[chosen])
        grams = [qgrams(np.frombuffer(texts[t], np.uint8), q) for t in used]
        counts = np.array([len(g) for g in grams], np.int64)
        flat = np.concatenate(grams) if grams else np.zeros(0, np.uint32)
        order = np.argsort(flat, kind="stable")
        self.gram = flat[order]
        self.of = np.repeat(used, counts)[order].astype(np.int32)
        self.at = textvec._ranges(counts)[order].astype(np.int32)
        self.place = self.gram.astype(np.uint64) << np.uint64(32) | self.of.astype(np.uint64)  # sorted, as both are
        self.items, self.longest = len(texts), int(self.at.max(initial=0)) + 1
        self.bits = np.zeros(1 << _BITS, bool)
        self.bits[flat >> np.uint32(32 - _BITS)] = True

    def candidates(self, texts: list[bytes]) -> Iterator[tuple[int, int, int, int]]:
        """(text, window, lowest diagonal, shared q-grams) where a band shares enough of them."""
        starts = np.cumsum([0] + [len(b) + 1 for b in texts])
        hit, grams = self._dense(b"\n".join(texts))  # no q-gram of a window has a line end
        owner = np.searchsorted(starts, hit, "right") - 1
        cuts = np.flatnonzero(np.diff(owner, prepend=-1))
        for i, j in pairwise([*cuts, len(hit)]):
            d = int(owner[i])
            for w, low, n in self._bands(grams[i:j], hit[i:j] - starts[d]):
                yield d, w, low, n

    def _dense(self, buf: bytes) -> tuple[np.ndarray, np.ndarray]:
        """Positions and q-grams that are shared with the windows and lie where a window's least number of them could."""
        none = np.zeros(0, np.int64), np.zeros(0, np.uint32)
        if len(buf) < self.q or not len(self.gram):
            return none
        grams = qgrams(np.frombuffer(buf, np.uint8), self.q)
        hit = np.flatnonzero(self.bits[grams >> np.uint32(32 - _BITS)])
        span, least = int((self.end - self.start).max()) + 2 * self.most, int(self.least.min())
        for exact in (False, True):  # by the bits, then by the q-grams themselves
            if exact:
                at = np.minimum(np.searchsorted(self.gram, grams[hit]), len(self.gram) - 1)
                hit = hit[self.gram[at] == grams[hit]]
            if len(hit) < least:
                return none
            near = np.flatnonzero(hit[least - 1 :] - hit[: len(hit) - least + 1] < span)
            marks = np.zeros(len(hit) + 1, np.int64)
            np.add.at(marks, near, 1)
            np.add.at(marks, near + least, -1)
            hit = hit[np.cumsum(marks[:-1]) > 0]
        return hit, grams[hit]

    def _bands(self, grams: np.ndarray, at: np.ndarray, first: int = 0, end: int | None = None) -> list[tuple[int, int, int]]:
        """(window, lowest diagonal, shared q-grams) of bands with enough of them, widened by the most edits at either side.

        Where q-grams have more than POSTINGS places, items first to end - 1 are taken in halves, and then the text is, so
        that halves overlap by the length of a window.
        """
        end = self.items if end is None else end
        wide = grams.astype(np.uint64) << np.uint64(32)
        lo, hi = np.searchsorted(self.place, wide | np.uint64(first), "left"), np.searchsorted(self.place, wide | np.uint64(end), "left")
        n = hi - lo
        if n.sum() < self.least.min():
            return []
        if n.sum() > POSTINGS:
            if end - first > 1:
                middle = (first + end) // 2
                return self._bands(grams, at, first, middle) + self._bands(grams, at, middle, end)
            reach = WINDOW + 2 * self.most
            if at[-1] - at[0] > 4 * reach:
                middle = (int(at[0]) + int(at[-1])) // 2
                left, right = at < middle + reach, at >= middle - reach
                return self._bands(grams[left], at[left], first, end) + self._bands(grams[right], at[right], first, end)
        place = np.repeat(lo, n) + textvec._ranges(n)
        of, inside = self.of[place].astype(np.int64), self.at[place].astype(np.int64)
        longest = self.longest
        diagonal = np.repeat(at, n) - inside + longest  # of the item; not negative
        width = self.most + 1
        out: dict[tuple[int, int], int] = {}
        for shift in (0, width):  # bands of 2 * width, twice, half a band apart: any e + 1 neighbouring diagonals lie in one
            band = (diagonal + shift) // (2 * width)
            order = np.lexsort((inside, band, of))
            p, b, t = inside[order], band[order], of[order]
            fresh = np.append(True, (b[1:] != b[:-1]) | (t[1:] != t[:-1]))
            first = fresh | np.append(True, p[1:] != p[:-1])  # an item's q-gram counts once in a band
            p, b, t, fresh = p[first], b[first], t[first], fresh[first]
            group = np.cumsum(fresh) - 1
            sorted_at = group << 32 | p
            # each window that holds a hit is asked once, at its first one
            after = np.maximum(np.where(fresh, -1, np.append(-1, p[:-1])), p - WINDOW)
            a, z = np.searchsorted(self.key, t << 32 | after + 1, "left"), np.searchsorted(self.key, t << 32 | p, "right")
            k = np.repeat(np.arange(len(p)), z - a)
            w = np.repeat(a, z - a) + textvec._ranges(z - a)
            shared = np.searchsorted(sorted_at, group[k] << 32 | self.end[w] - self.q, "right") - k
            enough = np.flatnonzero(shared >= self.least[w])
            low = b[k[enough]] * 2 * width - shift - longest + self.start[w[enough]] - self.most
            for x, y, c in zip(self.number[w[enough]].tolist(), low.tolist(), shared[enough].tolist(), strict=True):
                out[x, y] = max(c, out.get((x, y), 0))
        return [(*x, c) for x, c in out.items()]


class Index:
    """Windows of benchmark items and the places of their q-grams."""

    def __init__(self, items: list[tuple[int | None, str]]) -> None:
        texts, self.item, of, start, end = [], [], [], [], []
        for item, text in items:
            if b := textvec.normal(text):
                found = spans(b)
                self.item += [item] * len(found)
                of += [len(texts)] * len(found)
                start += [s for s, _ in found]
                end += [e for _, e in found]
                texts.append(b)
        self.window = Windows(texts, np.array(of, np.int64), np.array(start, np.int64), np.array(end, np.int64))
        self.length = self.window.end - self.window.start
        self.edits = np.floor(self.length * EDITS).astype(np.int64)
        bound = self.length - Q + 1 - Q * self.edits
        self.grams = [Grams(q, texts, self.window, np.flatnonzero(chosen), self.edits) for q, chosen in ((Q, (self.length >= Q) & (bound > 0)), (SHORT_Q, (self.length >= Q) & (bound <= 0))) if chosen.any()]
        self.short = [(self.window[w], self.item[w]) for w in np.flatnonzero(self.length < Q)]  # too short for a q-gram: compared whole

    def matches(self, texts: list[bytes]) -> list[list[tuple[int, int, int, int]]]:
        """For each normalised text, (item, edits, start, end) of the best verified window of each item in it."""
        found: list[dict[int, tuple[int, int, int]]] = [{} for _ in texts]

        def keep(d: int, item: int, best: tuple[int, int, int]) -> None:
            if item not in found[d] or best < found[d][item]:
                found[d][item] = best

        for w, item in self.short:
            for d, b in enumerate(texts):
                if (k := (b" " + b + b" ").find(b" " + w + b" ")) >= 0:
                    keep(d, item, (0, k, k + len(w)))
        spread = 4 * int(self.edits.max(initial=0)) + 1
        rest = []
        for grams in self.grams:
            for d, w, low, n in grams.candidates(texts):
                if n == self.length[w] - grams.q + 1:  # all its q-grams: perhaps the window itself
                    k = texts[d].find(self.window[w], max(low, 0), max(low, 0) + spread + int(self.length[w]))
                    if k >= 0:
                        keep(d, self.item[w], (0, k, k + int(self.length[w])))
                rest.append((d, w, low))
        # an item found without edits has no better window, and those without edits have been tried
        rest = [(d, w, low) for d, w, low in rest if found[d].get(self.item[w], (1,))[0]]
        for i in range(0, len(rest), 512):
            part = rest[i : i + 512]
            ws = [w for _, w, _ in part]
            for (d, w, _), best in zip(part, align([self.window[w] for w in ws], [texts[d] for d, _, _ in part], [low for _, _, low in part], spread, self.edits[ws]), strict=True):
                if best is not None:
                    keep(d, self.item[w], best)
        return [[(item, *x) for item, x in sorted(f.items(), key=lambda y: (y[0] is not None, y[0] or 0))] for f in found]


def align(windows: list[bytes], texts: list[bytes], lows: list[int], spread: int, most: np.ndarray) -> list[tuple[int, int, int] | None]:
    """For each pair, the fewest edits of the window against a part of the text, and the part's start and end.

    None if over most. Only diagonals low to low + spread (text position minus window position) are filled in, for all
    pairs at a time.
    """
    n, width, rows = len(windows), spread + 1, max(map(len, windows))
    m = np.array([len(w) for w in windows])
    pattern = np.full((n, rows), 254, np.uint8)
    region = np.full((n, rows + width), 255, np.uint8)  # character d + i of a region is on diagonal low + d in row i + 1
    size, low = np.array([len(t) for t in texts])[:, None], np.array(lows)[:, None]
    for k, (w, t, lo) in enumerate(zip(windows, texts, lows, strict=True)):
        pattern[k, : len(w)] = np.frombuffer(w, np.uint8)
        part = np.frombuffer(t[max(lo, 0) : max(lo + region.shape[1], 0)], np.uint8)
        region[k, max(-lo, 0) : max(-lo, 0) + len(part)] = part
    far = 4 * rows
    steps = np.arange(width)[None]
    start = low + steps
    cost = np.where((start < 0) | (start > size), far, 0)  # row 0: the window may start anywhere in the band
    best: list[tuple[int, int, int] | None] = [None] * n
    for i in range(1, rows + 1):
        j = low + i + steps  # characters of the text used after this row, on each diagonal
        diag = cost + (region[:, i - 1 : i - 1 + width] != pattern[:, i - 1 : i])
        up, up_start = np.full_like(cost, far), np.zeros_like(start)  # a character of the window without a partner
        up[:, :-1], up_start[:, :-1] = cost[:, 1:] + 1, start[:, 1:]
        take = up < diag
        cost = np.where((j >= 0) & (j <= size), np.where(take, up, diag), far)
        start = np.where(take, up_start, start)
        ahead = np.minimum.accumulate(cost - steps, 1)  # characters of the text without partners, from the left
        better = ahead + steps < cost
        if better.any():
            source = np.maximum.accumulate(np.where(cost - steps == ahead, steps, 0), 1)
            start = np.where(better, np.take_along_axis(start, source, 1), start)
            cost = np.where(better & (j <= size), ahead + steps, cost)
        for k in np.flatnonzero(m == i):
            d = int(cost[k].argmin())
            if cost[k, d] <= most[k]:
                best[k] = (int(cost[k, d]), int(start[k, d]), int(lows[k] + i + d))
    return best


def _blocks(benchmark: DataFrame) -> Iterator[list[tuple[int | None, str]]]:
    """Items in blocks of BLOCK_BYTES; the driver holds one at a time."""
    block, size = [], 0
    items = benchmark.select(F.col("item_id").cast("long"), "text").where("text IS NOT NULL").distinct().orderBy("item_id", "text")
    for row in items.toLocalIterator():
        if block and size + len(row[1]) > BLOCK_BYTES:
            yield block
            block, size = [], 0
        block.append((row[0], row[1]))
        size += len(row[1])
    if block:
        yield block


EMPTY = "CAST(array() AS array<struct<item_ids:bigint,edits:int,starts:bigint,ends:bigint>>)"
_HITS = "item_ids array<long>, edits array<int>, starts array<long>, ends array<long>"


def _found(cols: dict, index) -> Iterator[dict]:
    hits = index.value.matches([textvec.normal(t) for t in cols["text"]])
    yield {"item_ids": [[x[0] for x in h] for h in hits], "edits": [[x[1] for x in h] for h in hits], "starts": [[x[2] for x in h] for h in hits], "ends": [[x[3] for x in h] for h in hits]}


def decontaminate_rows(docs: DataFrame, benchmark: DataFrame, text_col: str = "text") -> DataFrame:
    """The columns of docs, as annotate() names them, with contaminated, item_ids, edits, starts and ends of decontaminate()."""
    spark = docs.sparkSession
    blocks = _blocks(benchmark)
    first, second = next(blocks, []), next(blocks, None)
    if second is None:
        out = annotate(docs, _found, _HITS, spark.sparkContext.broadcast(Index(first)), text_col=text_col)
    else:  # a pass for each block over numbered rows, then the matches of each row together
        rows = numbered(docs.toDF(*[f"_c{k}" for k in range(len(docs.columns))]), "_row", "numbered")
        texts, found = rows.select("_row", annotated(docs, text_col).alias("text")), None
        for block in chain([first, second], blocks):
            part = annotate(texts, _found, _HITS, spark.sparkContext.broadcast(Index(block)))
            part = part.where("size(item_ids) > 0").select(F.col("_c0").alias("_row"), F.arrays_zip("item_ids", "edits", "starts", "ends").alias("h"))
            found = part if found is None else found.unionByName(part)
        found = found.groupBy("_row").agg(F.array_sort(F.flatten(F.collect_list("h"))).alias("h"))
        best = "filter(h, (x, i) -> i = 0 OR NOT h[i - 1].item_ids <=> x.item_ids)"
        out = rows.join(found, "_row", "left").drop("_row").withColumn("h", F.coalesce(F.expr(best), F.expr(EMPTY)))
        out = out.select("*", *[F.col("h")[c].alias(c) for c in ("item_ids", "edits", "starts", "ends")]).drop("h")
    return out.withColumn("contaminated", F.size("item_ids") > 0)


def decontaminate(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: doc_id, contaminated, item_ids and, for each item, edits, starts and ends of the match.

    Texts are compared as lower-cased words with single spaces, and starts and ends are bytes of that form. A document is
    contaminated if a window (WORDS words, WINDOW characters at most; a shorter item is one) of an item lies in it with at
    most EDITS of its characters edited. Items shorter than a q-gram must occur exactly, as whole words; items without
    words match nothing. Items with a null item_id match as the others do, and count as one item. Null and empty texts are
    clean. Null ids and repeated rows count as rows of their own. An empty table gives no rows, an empty benchmark only
    clean ones; other columns are ignored.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    return decontaminate_rows(rows, benchmark).select(F.col("_c0").alias(id_col), "contaminated", "item_ids", "edits", "starts", "ends")


def op7_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
