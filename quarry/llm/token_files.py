"""Token-ID output: documents' ids in independent zstandard frames with a trailing seek table and per-frame checksums.

File format: zstandard frames, one after the other, each of the ids of some whole documents as little-endian unsigned
integers; then a skippable frame with the documents' index; then the seek table of the public zstandard seekable
format, a skippable frame with each frame's compressed size, decompressed size and checksum (the low 32 bits of XXH64
of the decompressed bytes), a count and a magic number. The index is the table's last frame, of decompressed size 0. A
reader takes the tail, then only the frames it needs.
"""

from __future__ import annotations

import os
import re
import struct
import uuid
import zlib
from array import array
from collections.abc import Iterable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quarry.llm.common import fresh_path, materialize, table, text_chunks

# Fixed values of the public formats: magic numbers of zstandard's skippable frames and of its seek table's end.
SKIPPABLE, SEEK_TABLE, SEEK_END = 0x184D2A50, 0x184D2A5E, 0x8F92EAB1
#: Bytes of ids in a frame, after which it ends at the next document.
FRAME = 1 << 17
LEVEL = 3
#: Files whose starts are summed up in one task.
FILES = 1024
#: Ends each document.
END_ID = 0
#: Bytes of a generation of the encoder's memory. It holds two: when one is full, it replaces the one before.
#: A piece counts as its characters and PIECE; one of over LONGEST characters is forgotten after the texts at hand.
MEMORY, PIECE, LONGEST = 128 << 20, 200, 64
#: Words that are encoded as one text.
TOGETHER = 200
# A word of Latin letters (with the blank or line end before it) and the marks after it are matches of their own.
_MARKED = re.compile(r"([ \n]?[A-Za-zÀ-ÖØ-öø-ɏ]+)([.,;:!?*#$%&|]+)")
_OTHER_SPACE = re.compile(r"[^\S \n]|\0")
_RUNS = ("  ", "\n\n", " \n", "\n ")


class Encoder:
    """Ids of whole texts from the tokenizers library, with the ids of frequent pieces remembered.

    A byte-level BPE tokenizer encodes each match of its pattern by itself, so a text's ids are those of its matches in
    order. Where no two white-space characters meet, no match crosses a line end or goes on after a blank: the text then
    falls into words with their blanks, which repeat. Other texts are encoded whole, as are those in which the string of
    an added token occurs.
    """

    def __init__(self, path: str) -> None:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # a task has one core
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.added = [x.content for x in self.tokenizer.get_added_tokens_decoder().values()]
        self.kind = np.dtype("<u2" if self.tokenizer.get_vocab_size() <= 1 << 16 else "<u4")
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=False)
        self.lengths = np.zeros(1 + max(vocabulary.values(), default=0), np.int64)  # bytes of each id: a letter of a byte-level token is a byte
        for token, i in vocabulary.items():
            self.lengths[i] = len(token)
        # pieces of this generation and of the one before
        self.memory: tuple[dict[str, bytes], dict[str, bytes]] = ({}, {})
        self.size, self.long = 0, set()

    def encode(self, texts: list[str]) -> list[bytes]:
        """Each text's ids as little-endian integers of type self.kind."""
        new, old = self.memory
        for p in self.long:
            new.pop(p, None)
        self.long.clear()
        if self.size > MEMORY:
            self.memory, self.size = ({}, new), 0
        cut = [self._cut(t) for t in texts]
        self._learn(set(chain.from_iterable(x for x in cut if x is not None)))
        odd = iter(self._ids([t for t, x in zip(texts, cut, strict=True) if x is None]))
        known = self.memory[0].__getitem__
        return [next(odd) if x is None else b"".join(map(known, x)) for x in cut]

    def _cut(self, text: str) -> list[str] | None:
        """Words with the blank or line end before them, if all white space is single ones between words, and no added token occurs."""
        if not text or text[0] in " \n" or text[-1] in " \n" or _OTHER_SPACE.search(text) or any(x in text for x in _RUNS) or any(x in text for x in self.added):
            return None
        return text.replace(" ", "\0 ").replace("\n", "\0\n").split("\0")

    def _learn(self, pieces: set[str]) -> None:
        """Fill up this generation's memory for pieces."""
        new, old = self.memory
        before, missing = len(new), []
        for p in pieces.difference(new):
            if (ids := old.get(p)) is None:
                missing.append(p)
            else:
                new[p] = ids
        marked = {p: m for p in missing if (m := _MARKED.fullmatch(p))}
        if marked:
            self._learn({part for m in marked.values() for part in m.groups()})
            new.update((p, new[m[1]] + new[m[2]]) for p, m in marked.items())
            missing = [p for p in missing if p not in new]
        led, bare = [p for p in missing if p[0] in " \n"], [p for p in missing if p[0] not in " \n"]
        new.update(zip(led, self._words(led, ""), strict=True))
        new.update(zip(bare, self._words(bare, "\n"), strict=True))
        if len(new) > before:
            self.long.update(p for p in chain(marked, missing) if len(p) > LONGEST)  # the generation before has none
            self.size += (len(new) - before) * (PIECE + LONGEST)

    def _words(self, words: list[str], before: str) -> list[bytes]:
        """Ids of words, many in one text, which falls apart at the blank or line end in front of each; before: one to add and leave out again."""
        out, skip = [], len(before)
        parts = [words[k : k + TOGETHER] for k in range(0, len(words), TOGETHER)]
        for part, found in zip(parts, self.tokenizer.encode_batch_fast(["".join([before + w for w in x]) for x in parts], add_special_tokens=False), strict=True):
            ids = np.array(found.ids, np.int64)
            ends = np.cumsum(self.lengths[np.minimum(ids, len(self.lengths) - 1)])
            whole = np.cumsum([skip + len(w.encode("utf-8", "surrogatepass")) for w in part])
            to = np.searchsorted(ends, whole)
            start = np.concatenate([[0], to[:-1] + 1])
            if to[-1] < len(ends) and (ends[to] == whole).all() and (not skip or (ends[start] == np.concatenate([[0], whole[:-1]]) + 1).all()):
                raw, width = ids.astype(self.kind).tobytes(), self.kind.itemsize
                out += [raw[i * width : j * width] for i, j in zip((start + skip).tolist(), (to + 1).tolist(), strict=True)]
            else:
                out += self._ids(part)
        return out

    def _ids(self, texts: list[str]) -> list[bytes]:
        code = "H" if self.kind.itemsize == 2 else "I"
        return [array(code, found.ids).tobytes() for found in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]


def write_frames(out, documents: Iterable[tuple[int | None, bytes]], kind: np.dtype, frame: int = FRAME) -> tuple[int, int]:
    """Write documents (id, ids with the end id) to a binary file in the format above; the numbers of documents and ids."""
    press = zstandard.ZstdCompressor(level=LEVEL)
    table_rows, ids, lengths, frames, held, size = [], [], [], [], [], 0

    def flush() -> None:
        nonlocal size
        raw = b"".join(held)
        packed = press.compress(raw)
        out.write(packed)
        table_rows.append(struct.pack("<III", len(packed), len(raw), xxhash.xxh64_intdigest(raw) & 0xFFFFFFFF))
        held.clear()
        size = 0

    for doc_id, raw in documents:
        if held and size + len(raw) > frame:
            flush()
        ids.append(-(1 << 63) if doc_id is None else doc_id)
        lengths.append(len(raw) // kind.itemsize)
        frames.append(len(table_rows))
        held.append(raw)
        size += len(raw)
    if held:
        flush()
    index = struct.pack("<IQ", kind.itemsize, len(ids)) + np.array(ids, "<i8").tobytes() + np.array(lengths, "<u8").tobytes() + np.array(frames, "<u4").tobytes()
    index = press.compress(index)
    out.write(struct.pack("<II", SKIPPABLE, len(index)) + index)
    table_rows.append(struct.pack("<III", len(index) + 8, 0, xxhash.xxh64_intdigest(b"") & 0xFFFFFFFF))
    entries = b"".join(table_rows)
    out.write(struct.pack("<II", SEEK_TABLE, len(entries) + 9) + entries + struct.pack("<IBI", len(table_rows), 0x80, SEEK_END))
    return len(ids), int(sum(lengths))


class TokenFile:
    """Reader of one file: the index from its tail, then the frames of the documents asked for, checksums checked."""

    def __init__(self, source) -> None:
        self.source = source
        end = source.seek(0, 2)
        frames, flags, magic = struct.unpack("<IBI", self._at(end - 9, 9))
        if magic != SEEK_END or flags != 0x80 or not frames:
            raise ValueError("no seek table at the end of the file")
        entries = np.frombuffer(self._at(end - 9 - 12 * frames, 12 * frames), "<u4").reshape(-1, 3)
        index_size, entries = int(entries[-1, 0]) - 8, entries[:-1]
        self.sizes, self.raw_sizes, self.sums = entries[:, 0].astype(np.int64), entries[:, 1].astype(np.int64), entries[:, 2]
        self.starts = np.cumsum(self.sizes) - self.sizes
        raw = zstandard.ZstdDecompressor().decompress(self._at(int(self.sizes.sum()) + 8, index_size))
        width, n = struct.unpack("<IQ", raw[:12])
        self.kind = np.dtype(f"<u{width}")
        self.ids, self.lengths = np.frombuffer(raw, "<i8", n, 12), np.frombuffer(raw, "<u8", n, 12 + 8 * n).astype(np.int64)
        self.frames = np.frombuffer(raw, "<u4", n, 12 + 16 * n).astype(np.int64)

    def _at(self, start: int, n: int) -> bytes:
        self.source.seek(start)
        return self.source.read(n)

    def frame(self, k: int) -> bytes:
        raw = zstandard.ZstdDecompressor().decompress(self._at(int(self.starts[k]), int(self.sizes[k])), max_output_size=int(self.raw_sizes[k]))
        if xxhash.xxh64_intdigest(raw) & 0xFFFFFFFF != self.sums[k]:
            raise ValueError(f"frame {k} is damaged")
        return raw

    def __iter__(self) -> Iterator[tuple[int | None, np.ndarray]]:
        """All documents in order, one frame in memory at a time."""
        at, now, raw = 0, -1, b""
        for doc_id, n, k in zip(self.ids.tolist(), self.lengths.tolist(), self.frames.tolist(), strict=True):
            if k != now:
                at, now, raw = 0, k, self.frame(k)
            yield None if doc_id == -(1 << 63) else doc_id, np.frombuffer(raw, self.kind, n, at)
            at += n * self.kind.itemsize

    def read(self, doc_id: int) -> np.ndarray:
        """Ids of one document; only its frame is decompressed."""
        found = np.flatnonzero(self.ids == doc_id)
        if not len(found):
            raise KeyError(doc_id)
        k = self.frames[found[0]]
        first = np.flatnonzero(self.frames == k)[0]
        return np.frombuffer(self.frame(int(k)), self.kind, int(self.lengths[found[0]]), int(self.lengths[first : found[0]].sum()) * self.kind.itemsize)


_encoders: dict[str, Encoder] = {}


def _encoder(path: str) -> Encoder:
    """One encoder per worker process."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def write_token_files(docs: DataFrame, folder: str, tokenizer: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encode docs into files in folder, by ascending id; returns the manifest (part, path, n_docs, n_tokens, start).

    A task writes one file under a name of its own; only files that the manifest lists count, so a task that runs again
    leaves at most an unlisted file. start: the ids of all documents in earlier files.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        encoder = _encoder(tokenizer or default_tokenizer())
        end = np.array([END_ID], encoder.kind).tobytes()

        def documents(first: pa.RecordBatch) -> Iterator[tuple[int | None, bytes]]:
            for batch in chain([first], batches):
                ids, texts = batch.column("id").to_pylist(), batch.column("text").to_pylist()
                for i, j in text_chunks(texts):
                    for doc_id, raw in zip(ids[i:j], encoder.encode([t or "" for t in texts[i:j]]), strict=True):
                        yield doc_id, raw + end

        first = next((b for b in batches if b.num_rows), None)
        if first is None:
            return
        part = TaskContext.get().partitionId()
        store, root = fs.FileSystem.from_uri(folder)
        store.create_dir(root, recursive=True)
        name = f"part-{part:06d}-{uuid.uuid4().hex}.tok"
        with store.open_output_stream(f"{root}/{name}", compression=None) as out:
            n_docs, n_tokens = write_frames(out, documents(first), encoder.kind)
        yield pa.RecordBatch.from_pydict({"part": [part], "path": [f"{folder}/{name}"], "n_docs": [n_docs], "n_tokens": [n_tokens]}, schema=pa.schema([("part", pa.int32()), ("path", pa.string()), ("n_docs", pa.int64()), ("n_tokens", pa.int64())]))

    # the row's place in the table deals out many rows with the same id
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"), F.monotonically_increasing_id().alias("row"))
    rows = rows.repartitionByRange("id", "row").sortWithinPartitions("id", "row").select("id", "text")
    files = materialize(rows.mapInArrow(run, "part int, path string, n_docs long, n_tokens long"), "manifest")
    files = files.withColumn("block", F.floor(F.col("part") / FILES))
    sums = files.groupBy("block").agg(F.sum("n_tokens").alias("n"))
    before = lambda x, w: F.coalesce(F.sum(x).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    sums = sums.select("block", before("n", Window.orderBy("block")).alias("base"))  # a row per FILES files
    within = files.withColumn("within", before("n_tokens", Window.partitionBy("block").orderBy("part")))
    return within.join(sums, "block").withColumn("start", F.col("base") + F.col("within")).drop("block", "base", "within")


def read_token_files(manifest: DataFrame) -> DataFrame:
    """Per document of the files: doc_id, start, n_tokens, ids_crc32."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        schema = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64())])
        for batch in batches:
            for path, at in zip(batch.column("path").to_pylist(), batch.column("start").to_pylist(), strict=True):
                store, name = fs.FileSystem.from_uri(path)
                with store.open_input_file(name) as source:
                    file = TokenFile(source)
                    starts = at + np.cumsum(file.lengths) - file.lengths
                    ids, sums = [], []
                    for doc_id, x in file:
                        ids.append(doc_id)
                        sums.append(zlib.crc32(x.astype("<u4").tobytes()))
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(starts, pa.int64()), pa.array(file.lengths, pa.int64()), pa.array(sums, pa.int64())], schema=schema)

    return manifest.select("path", "start").repartition(max(1, manifest.count())).mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def token_output(docs: DataFrame, tokenizer: str | None = None) -> DataFrame:
    """Write docs as token files under the shared folder and read them back: doc_id, start, n_tokens, ids_crc32.

    A null text counts as empty; each document ends with id 0. Null ids come first, and rows with the same id follow each
    other as in the table. Where the string of an added token occurs, the tokenizer gives that token's id. An empty table
    writes no file and gives no rows; other columns are ignored.
    """
    return read_token_files(write_token_files(docs, fresh_path(docs.sparkSession, "tokens"), tokenizer))


def op6_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_output(table(spark, sf_dir, "documents"))
