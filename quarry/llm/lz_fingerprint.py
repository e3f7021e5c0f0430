"""Fingerprints of texts by Lempel-Ziv phrases.

A text is parsed into phrases: each is the shortest piece that is no phrase of the text so far. The hashes of the set of
phrases fall into bins, and the fingerprint holds a few bits of each bin's least hash; an empty bin takes those of a bin
that is not empty, chosen by a fixed hash. The share of bins in which two fingerprints agree estimates the Jaccard
likeness of the phrase sets, which is high where one text helps to compress the other.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quarry.llm.common import materialize, table, text_chunks
from quarry.llm.textvec import mix

#: Bins of a fingerprint, each written as four hex digits.
BINS = 128
_SHIFT = np.uint64(64 - (BINS - 1).bit_length())
#: Odd multiplier of the phrases' polynomial hash.
BASE = 0x9E3779B97F4A7C15
_NONE = np.uint64(0xFFFFFFFFFFFFFFFF)
#: Code points whose phrases are hashed at a time.
BLOCK = 1 << 20
_powers = np.ones(1, np.uint64)


def phrases(text: str, start: int, seen: set[str]) -> list[int]:
    """Ends of the phrases of text from start on; seen, the phrases before it, gets them.

    What is left at the end is a phrase that was seen before and adds nothing to the set. Every beginning of a phrase is a
    phrase, so the search may start at any length: it grows while the piece is known and shrinks while a shorter one is not.
    """
    ends, size, length, add = [], len(text), 1, seen.add
    while start < size:
        end = start + length
        if end > size:
            end = size
        piece = text[start:end]
        if piece in seen:
            end += 1
            while end <= size and (piece := text[start:end]) in seen:
                end += 1
            if end > size:
                break
        else:
            while end - 1 > start and (shorter := text[start : end - 1]) not in seen:
                end -= 1
                piece = shorter
        add(piece)
        ends.append(end)
        length = end - start
        start = end
    return ends


def _powers_to(n: int) -> np.ndarray:
    global _powers
    if len(_powers) < n:
        size = 1 << n.bit_length()
        _powers = np.concatenate([np.ones(1, np.uint64), np.full(size - 1, BASE, np.uint64)]).cumprod()
    return _powers


def least_hashes(text: str, start: int, ends: list[int]) -> np.ndarray:
    """The least hash of each bin over the phrases text[start:ends[0]], text[ends[0]:ends[1]], ...; the largest number where a bin is empty."""
    least = np.full(BINS, _NONE)
    if not ends:
        return least
    codes = np.frombuffer(text[start : ends[-1]].encode("utf-32-le", "surrogatepass"), "<u4")
    ends_ = np.array(ends, np.int64) - start
    starts = np.concatenate([[0], ends_[:-1]])
    i = 0
    while i < len(starts):
        j = max(i + 1, int(np.searchsorted(ends_, starts[i] + BLOCK)))
        lengths = ends_[i:j] - starts[i:j]
        at = starts[i:j] - starts[i]
        place = np.arange(ends_[j - 1] - starts[i]) - np.repeat(at, lengths)
        values = (codes[starts[i] : ends_[j - 1]].astype(np.uint64) + np.uint64(1)) * _powers_to(int(lengths.max()))[place]
        h = mix(np.add.reduceat(values, at))
        np.minimum.at(least, (h >> _SHIFT).astype(np.int64), h)
        i = j
    return least


def signature(least: np.ndarray) -> np.ndarray:
    """The fingerprint's numbers; all 65535 for a text without phrases, which no other text has."""
    empty = least == _NONE
    if empty.all():
        return np.full(BINS, 0xFFFF, np.uint16)
    full, bins, step = least.copy(), np.flatnonzero(empty), 1
    while len(bins):
        other = (mix(bins.astype(np.uint64) * np.uint64(BASE) + np.uint64(step)) >> _SHIFT).astype(np.int64)
        found = ~empty[other]
        full[bins[found]] = least[other[found]]
        bins, step = bins[~found], step + 1
    return (mix(full) % np.uint64(0xFFFF)).astype(np.uint16)


def hexed(numbers: np.ndarray) -> str:
    return numbers.astype(">u2").tobytes().hex()


def numbers(fingerprint: str) -> np.ndarray:
    return np.frombuffer(bytes.fromhex(fingerprint), ">u2").astype(np.uint16)


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """Share of equal bins: an estimate of the Jaccard likeness of the phrase sets, from 0 to 1."""
    return float((a == b).mean())


def fingerprint(text: str) -> np.ndarray:
    """The fingerprint's numbers of a whole text."""
    return signature(least_hashes(text, 0, phrases(text, 0, set())))


def edited(text: str, following: str) -> str:
    """text with its last floor(n / 2) code points replaced by the first as many, or all, of following."""
    k = len(text) // 2
    return text[: len(text) - k] + following[:k]


def both_fingerprints(text: str, other: str) -> tuple[np.ndarray, np.ndarray]:
    """The fingerprints of a text and of its edited text, whose common beginning is parsed once."""
    head = text[: len(text) - len(text) // 2]
    seen: set[str] = set()
    ends = phrases(head, 0, seen)
    at, least = ends[-1] if ends else 0, least_hashes(head, 0, ends)
    out = []
    for whole, known in ((text, seen.copy()), (other, seen)):
        out.append(signature(np.minimum(least, least_hashes(whole, at, phrases(whole, at, known)))))
    return out[0], out[1]


_OUT = pa.schema([
    ("doc_id", pa.int64()), ("n_chars", pa.int64()), ("edited_sha256", pa.string()), ("fingerprint", pa.string()), ("edited_fingerprint", pa.string()),
    ("near_edited", pa.float64()), ("near_next", pa.float64()),
])
_DDL = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def _row(doc_id: int | None, text: str, following: str) -> tuple[list, np.ndarray]:
    """A document's result but for near_next, and its fingerprint's numbers."""
    changed = edited(text, following)
    own, other = both_fingerprints(text, changed)
    return [doc_id, len(text), hashlib.sha256(changed.encode("utf-8", "surrogatepass")).hexdigest(), hexed(own), hexed(other), likeness(own, other)], own


def _columns(rows: list[list], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, x.type) for c, x in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)


def lz_fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row of docs: doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next.

    The next document is that with the next smaller id; null ids come last and rows with the same id follow each other as
    in the table; after the last comes the first, so a single document is its own next. A null text counts as empty; the
    edited text of an empty one is empty. Texts without phrases (the empty one) are wholly alike, and not at all like any
    other. An empty table gives no rows; other columns are ignored.

    Rows are dealt by ranges of ids. A task goes through its range once and holds two documents at a time; only the first
    and the last document of each range meet in a small join, since the last one's next is in another range.
    """
    carried = pa.schema([("part", pa.int32()), ("kind", pa.string()), *_OUT, ("text", pa.string())])

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, ready, waiting, last = TaskContext.get().partitionId(), [], None, None
        for batch in batches:
            ids, texts = batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()
            for i, j in text_chunks(texts):
                for doc_id, text in zip(ids[i:j], texts[i:j], strict=True):
                    if last is None:
                        yield _columns([[part, "first", None, len(text), None, hexed(fingerprint(text)), None, None, None, text]], carried)
                    else:
                        row, own = _row(*last, text)
                        if waiting:
                            ready.append([part, "row", *waiting[0], likeness(waiting[1], own), None])
                        waiting = row, own
                    last = doc_id, text
                if ready:
                    yield _columns(ready, carried)
                    ready = []
        if last:
            if waiting:
                yield _columns([[part, "row", *waiting[0], likeness(waiting[1], fingerprint(last[1])), None]], carried)
            yield _columns([[part, "last", last[0], len(last[1]), None, None, None, None, None, last[1]]], carried)

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                row, own = _row(r["doc_id"], r["text"], r["following"])
                yield _columns([[*row, likeness(own, numbers(r["next_fingerprint"]))]], _OUT)

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"), F.monotonically_increasing_id().alias("row"))
    order = [F.col("doc_id").desc_nulls_last(), F.col("row")]
    ranges = rows.repartitionByRange(*order).sortWithinPartitions(*order).select("doc_id", "text")
    walked = materialize(ranges.mapInArrow(walk, f"part int, kind string, {_DDL}, text string"), "phrases")
    whole = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    firsts = walked.where("kind = 'first'")
    # a row per range, without its text
    after = firsts.select("part", F.coalesce(F.lead("part").over(Window.orderBy("part")), F.first("part").over(whole)).alias("next"))
    following = firsts.select(F.col("part").alias("next"), F.col("text").alias("following"), F.col("fingerprint").alias("next_fingerprint"))
    ends = walked.where("kind = 'last'").select("part", "doc_id", "text").join(after, "part").join(following, "next")
    return walked.where("kind = 'row'").select(*_OUT.names).unionByName(ends.select("doc_id", "text", "following", "next_fingerprint").mapInArrow(finish, _DDL))


def op12_lz_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lz_fingerprints(table(spark, sf_dir, "documents"))
