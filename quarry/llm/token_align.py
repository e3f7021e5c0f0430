"""Alignment of two tokenizers' ids over a corpus by a dictionary of groups.

Both tokenizers cut a text's bytes into tokens. Byte offsets where tokens of both end cut the tokens into groups. Equal
groups recur, so each distinct group is interned once with its frequency; links are expanded once per distinct group and
counted with that frequency, and what the counts say about a group comes back to the documents by the group's key.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
from collections import Counter
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quarry.llm.common import materialize, table, text_chunks

#: Groups whose results go to all tasks: at most so many of the most frequent. The others are joined.
FREQUENT = 200_000
#: A group's text of up to KEY characters is its own key, a longer one's digest is.
KEY = 64
#: Pieces that a worker remembers count as their characters and PIECE bytes; MEMORY bytes in each of two generations.
MEMORY, PIECE = 48 << 20, 300
#: Words that are encoded as one text.
TOGETHER = 200
# Fixed value: the pattern of byte-level tokenizers, which a blank inside a text always begins a match of.
BYTE_LEVEL = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
# A run of blanks and line ends with the word after it; the last one also takes what blanks are left.
_PIECES = re.compile(r"[ \n]*[^ \n]+(?:[ \n]+\Z)?")
_OTHER_SPACE = re.compile(r"[^\S \n]")


class Aligner:
    """Groups of whole texts, with those of frequent pieces remembered.

    No token of either tokenizer goes on from a word into the blank or line end after it, and neither looks past such a
    place, so a text's groups are those of its pieces in order. Where a text has other white space, or the vocabularies
    hold tokens that could cross such a place, the text is one piece.
    """

    def __init__(self, a_path: str, b_path: str) -> None:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # a task has one core
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(a_path)
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=b_path)
        to_byte = {c: b for b, c in enumerate(_byte_letters())}
        self.a_bytes = {i: bytes(map(to_byte.__getitem__, s)) for s, i in self.a.get_vocab(with_added_tokens=False).items()}
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.b_bytes = [bytes([int(s[3:5], 16)]) if self.b.is_byte(i) else s.replace("▁", " ").encode() for i, s in enumerate(pieces)]
        with open(a_path, encoding="utf-8") as f:
            model = json.load(f)
        plain = model.get("normalizer") is None and (model.get("pre_tokenizer") or {}).get("type") == "ByteLevel" and not model["pre_tokenizer"].get("add_prefix_space")
        self.cuts = plain and not any(re.search("[^▁]▁|\n", s) for s in pieces) and self.b.encode("\n", out_type=str) == ["▁", "<0x0A>"]
        self.ranked = self._ranked(model, to_byte) if self.cuts else None
        size = 1 + max(self.a_bytes, default=0)
        self.a_names = np.array([[f"{i}," for i in range(size)], [f"{i}|" for i in range(size)]], object)  # within a group, and at its end
        self.b_names = np.array([[f"{i}." for i in range(len(pieces))], [f"{i};" for i in range(len(pieces))]], object)
        self.a_lengths, self.b_lengths = np.zeros(size, np.int64), np.array(list(map(len, self.b_bytes)))
        for i, raw in self.a_bytes.items():
            self.a_lengths[i] = len(raw)
        self.bare = self.b.piece_to_id("▁")
        # groups of pieces of this generation and of the one before, each with `;` after it; '' where the bytes differ
        self.memory: list[dict[str, str]] = [{}, {}]
        self.size = 0

    def _ranked(self, model: dict, to_byte: dict[str, int]):
        """tiktoken's encoder over A's own vocabulary, if its ids rise with its merges, as they do where ids are ranks; else None."""
        import tiktoken

        vocab, merges = model["model"]["vocab"], model["model"]["merges"]
        made = [vocab["".join(m) if isinstance(m, list) else m.replace(" ", "", 1)] for m in merges]
        special = {x["content"] for x in model.get("added_tokens") or ()}
        if made != sorted(made) or model["model"].get("ignore_merges") or len(made) + 256 + len(special.intersection(vocab)) != len(vocab):
            return None
        ranks = {bytes(map(to_byte.__getitem__, s)): i for s, i in vocab.items() if s not in special}
        return tiktoken.Encoding("a", pat_str=BYTE_LEVEL, mergeable_ranks=ranks, special_tokens={})

    def groups(self, texts: list[str]) -> Iterator[str]:
        """For each text, not empty, its groups: A ids with `,` and B ids with `.` between them, a `;` after each group; '' where bytes differ."""
        if self.size > MEMORY:
            self.memory, self.size = [{}, self.memory[0]], 0
        cut = [self._cut(t) for t in texts]
        known, old = self.memory
        missing = []
        for piece in set(chain.from_iterable(cut)).difference(known):
            if (found := old.get(piece)) is None:
                missing.append(piece)
            else:
                known[piece] = found
            self.size += len(piece) + PIECE
        own = self._align(missing)
        long = {p: own.pop(p) for p in missing if len(p) > 64}  # a whole text or a long word is not remembered
        known.update(own)
        look = known.__getitem__ if not long else lambda p: long[p] if p in long else known[p]
        for x in cut:
            found = list(map(look, x))
            yield "".join(found) if all(found) else ""

    def _cut(self, text: str) -> list[str]:
        if not self.cuts or not text.strip(" \n") or _OTHER_SPACE.search(text):
            return [" " + text]
        if "\0" in text or text[-1] in " \n" or text[0] in " \n" or any(run in text for run in ("  ", "\n\n", " \n", "\n ")):
            return _PIECES.findall(" " + text)
        return (" " + text.replace(" ", "\0 ").replace("\n", "\0\n")).split("\0")

    def _align(self, pieces: list[str]) -> dict[str, str]:
        """Groups of each piece; words are encoded many at a time."""
        ready: dict[str, str] = {}
        if self.ranked:
            words = [p for p in pieces if len(p) <= 64 and not p[-1].isspace()]
            for k in range(0, len(words), TOGETHER):
                ready.update(self._together(words[k : k + TOGETHER]))
        odd = [p for p in pieces if p not in ready]
        # B adds a blank of its own, so a piece's first one goes; before a line end there is none, so the added one goes
        asked = [p[1:] if p[0] == " " else p for p in odd]
        for piece, a, b in zip(odd, self.a.encode_batch_fast(odd, add_special_tokens=False), self.b.encode(asked, num_threads=1), strict=True):
            if piece[0] != " ":
                b = b[1:] if b and b[0] == self.bare else []
            ready[piece] = "".join(self._names(piece, a.ids, b)[0])
        return ready

    def _together(self, words: list[str]) -> dict[str, str]:
        """Groups of words, none of which ends in white space, from one text of them all; nothing where bytes differ."""
        words = [" -", *words]  # so that the text begins with a blank
        text = "".join(words)
        names, a_ends, b_ends = self._names(text, self.ranked.encode_ordinary(text), self.b.encode(text[1:]))
        ends = np.cumsum([len(w.encode()) for w in words])
        if not names or not (np.isin(ends, a_ends).all() and np.isin(ends, b_ends).all()):
            return {}
        to = (np.searchsorted(a_ends, ends) + np.searchsorted(b_ends, ends) + 2).tolist()
        return {w: "".join(names[i:j]) for w, i, j in zip(words[1:], to, to[1:], strict=False)}

    def _names(self, text: str, a: list[int], b: list[int]) -> tuple[list[str], np.ndarray, np.ndarray]:
        """The ids of a text in the order of its groups, each with what follows it; none where either's bytes are not the text's.

        Group by group come the A ids, then the B ids: an id's place is its number plus that of the other side's ids before it.
        """
        raw = text.encode()
        if b"".join([self.a_bytes.get(i, b"") for i in a]) != raw or b"".join(map(self.b_bytes.__getitem__, b)) != raw:
            return [], np.zeros(0, np.int64), np.zeros(0, np.int64)
        a, b = np.array(a, np.int64), np.array(b, np.int64)
        a_ends, b_ends = np.cumsum(self.a_lengths[a]), np.cumsum(self.b_lengths[b])
        both = np.intersect1d(a_ends, b_ends, assume_unique=True)
        a_to, b_to = np.searchsorted(a_ends, both) + 1, np.searchsorted(b_ends, both) + 1
        out = np.empty(len(a) + len(b), object)
        a_group, b_group = np.searchsorted(both, a_ends), np.searchsorted(both, b_ends)  # a token belongs to the next common end
        out[np.arange(len(a)) + np.concatenate([[0], b_to])[a_group]] = self.a_names[(a_ends == both[a_group]).astype(np.int64), a]
        out[np.arange(len(b)) + a_to[b_group]] = self.b_names[(b_ends == both[b_group]).astype(np.int64), b]
        return out.tolist(), a_ends, b_ends


def _byte_letters() -> str:
    """The letter of each byte in byte-level vocabularies: printable bytes as they are, the others from code point 256 on."""
    own = {*range(33, 127), *range(161, 173), *range(174, 256)}
    rest = iter(range(256, 512))
    return "".join(chr(b if b in own else next(rest)) for b in range(256))


_aligners: dict[tuple[str, str], Aligner] = {}


def _aligner(a: str, b: str) -> Aligner:
    """One per worker process."""
    if (a, b) not in _aligners:
        _aligners[a, b] = Aligner(a, b)
    return _aligners[a, b]


def default_tokenizers() -> tuple[str, str]:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


def document_groups(docs: DataFrame, a: str | None = None, b: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row of docs a row with doc_id, n_a, n_b, n_groups and groups_sha256, and a row with each distinct group and its
    number n in the document; row ties them together, and group is null in the former."""
    schema = pa.schema([("row", pa.int64()), ("doc_id", pa.int64()), ("n_a", pa.int64()), ("n_b", pa.int64()), ("n_groups", pa.int64()), ("groups_sha256", pa.string()), ("group", pa.string()), ("n", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        paths = default_tokenizers()
        aligner = _aligner(a or paths[0], b or paths[1])
        for batch in batches:
            texts, own_rows = batch.column("text").to_pylist(), batch.column("row").to_pylist()
            for i, j in text_chunks(texts):
                found = aligner.groups([t for t in texts[i:j] if t])
                summary, names, counts, sizes = [], [], [], []
                for t in texts[i:j]:
                    text = next(found) if t else ""
                    if not text:
                        summary.append((0, 0, 0, ""))
                        sizes.append(0)
                        continue
                    n, n_a, n_b = map(text.count, ";,.")
                    text = text[:-1].replace(".", ",")
                    summary.append((n + n_a, n + n_b, n, hashlib.sha256(text.encode()).hexdigest()))
                    distinct = Counter(text.split(";"))
                    names.extend(distinct)
                    counts.extend(distinct.values())
                    sizes.append(len(distinct))
                m = j - i
                rows, none = batch.column("row").slice(i, m), lambda k, kind: pa.nulls(k, kind)
                yield pa.RecordBatch.from_arrays([rows, batch.column("doc_id").slice(i, m), *(pa.array(c, k) for c, k in zip(zip(*summary, strict=True), (pa.int64(), pa.int64(), pa.int64(), pa.string()), strict=True)), none(m, pa.string()), none(m, pa.int64())], schema=schema)
                if names:
                    k = len(names)
                    of = pa.array([r for r, s in zip(own_rows[i:j], sizes, strict=True) for _ in range(s)], pa.int64())
                    yield pa.RecordBatch.from_arrays([of, *(none(k, pa.int64()) for _ in range(4)), none(k, pa.string()), pa.array(names, pa.string()), pa.array(counts, pa.int64())], schema=schema)

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), F.monotonically_increasing_id().alias("row"))
    return rows.mapInArrow(run, "row long, doc_id long, n_a long, n_b long, n_groups long, groups_sha256 string, `group` string, n long")


def _key(group: str) -> Column:
    return F.when(F.length(group) <= KEY, F.col(group)).otherwise(F.sha2(group, 256))


def group_dictionary(groups: DataFrame) -> DataFrame:
    """Each distinct group once: key, frequency, documents, and its links as an array of (a, b).

    The tokens of a group that end together are its last ones, so a group has one link.
    """
    last = lambda side: F.element_at(F.split(F.element_at(F.split("group", r"\|"), side), ","), -1).cast("int")
    once = groups.groupBy("group").agg(F.sum("n").alias("frequency"), F.count("*").alias("documents"))
    return once.select(_key("group").alias("key"), "frequency", "documents", F.array(F.struct(last(1).alias("a"), last(2).alias("b"))).alias("links"))


def link_counts(dictionary: DataFrame) -> DataFrame:
    """Each linked pair (a, b) with its count and whether no pair with the same b has a higher one.

    Of two tokens that end together the shorter one's bytes end the longer one's, and a token has only so many ends: the
    number of pairs is bounded by the vocabularies' bytes (some 600,000 here), whatever the corpus.
    """
    pairs = dictionary.select("frequency", F.explode("links").alias("link")).groupBy("link.a", "link.b").agg(F.sum("frequency").alias("count"))
    return pairs.withColumn("best", F.col("count") == F.max("count").over(Window.partitionBy("b")))


def group_results(dictionary: DataFrame, links: DataFrame) -> DataFrame:
    """Per distinct group: key, frequency, and of one occurrence n_links, n_best and count_sum."""
    each = dictionary.select("key", "frequency", F.explode("links").alias("link")).select("key", "frequency", "link.a", "link.b")
    found = each.join(F.broadcast(links), ["a", "b"])  # bounded by the vocabularies, see link_counts
    return found.groupBy("key").agg(F.first("frequency").alias("frequency"), F.count("*").alias("n_links"), F.sum(F.col("best").cast("long")).alias("n_best"), F.sum("count").alias("count_sum"))


def _least_frequency(results: DataFrame, most: int) -> float:
    """A frequency that at most so many groups reach; from a histogram with 16 steps for each doubling."""
    step = F.floor(F.log2("frequency") * 16)
    total, cut = 0, None
    for r in sorted(results.groupBy(step.alias("step")).count().collect(), reverse=True):  # at most 16 * 63 rows
        total += r["count"]
        if total > most:
            break
        cut = r["step"]
    return float("inf") if cut is None else cut / 16


def align_tokens(docs: DataFrame, a: str | None = None, b: str | None = None, id_col: str = "doc_id", text_col: str = "text", frequent: int = FREQUENT) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Per row of docs (doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256); the dictionary; the links.

    a, b: files of a byte-level BPE tokenizer of the tokenizers library and of a sentencepiece model that adds a blank.
    A text that is null or empty, or that a tokenizer changes, has no tokens: zeros and an empty groups_sha256. Repeated
    ids are rows of their own, null ids stay null, and an empty table gives no rows; other columns are ignored.

    A row per document and distinct group comes back to the documents. The most frequent groups' results go to all tasks
    (at most `frequent` of them, with keys of at most 64 characters); the other groups are joined by key, and each of
    those holds at most one part in `frequent` of all occurrences, so no key is hot.
    """
    stored = materialize(document_groups(docs, a, b, id_col, text_col), "groups")
    groups = stored.where("group IS NOT NULL").select("row", "group", _key("group").alias("key"), "n")
    dictionary = materialize(group_dictionary(groups), "dictionary")
    links = materialize(link_counts(dictionary), "links")
    results = materialize(group_results(dictionary, links), "results")
    high = F.log2("frequency") >= F.lit(_least_frequency(results, frequent))
    columns = ["n_links", "n_best", "count_sum"]
    known = F.broadcast(results.where(high).select("key", *columns, F.lit(True).alias("known")))
    several = [F.sum(F.col(c) * F.col("n")).alias(c) for c in columns]
    asked = groups.select("row", "key", "n").join(known, "key", "left")
    often = asked.where("known").groupBy("row").agg(*several)
    seldom = asked.where("known IS NULL").select("row", "key", "n").join(results.where(~high).select("key", *columns).hint("shuffle_hash"), "key").groupBy("row").agg(*several)
    sums = often.unionByName(seldom).groupBy("row").agg(*[F.sum(c).alias(c) for c in columns])
    zero = [F.coalesce(c, F.lit(0)).alias(c) for c in columns]
    out = stored.where("group IS NULL").join(sums, "row", "left").select("doc_id", "n_a", "n_b", "n_groups", *zero, "groups_sha256")
    return out, dictionary, links


def op13_token_align(spark: SparkSession, sf_dir: str) -> DataFrame:
    return align_tokens(table(spark, sf_dir, "documents"))[0]
