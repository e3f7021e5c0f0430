from __future__ import annotations

import io
import random
import zlib

import numpy as np
import pytest

from quarry.llm import token_files as T


@pytest.fixture(scope="module")
def encoder():
    return T.Encoder(T.default_tokenizer())


@pytest.fixture(scope="module")
def plain():
    """The library's tokenizer as it comes from the file."""
    from tokenizers import Tokenizer

    return Tokenizer.from_file(T.default_tokenizer())


def test_encoder_against_the_library(encoder, plain):
    rng = random.Random(2)
    texts = ["a  b", "  a", "a\n\n b \n", "", " x y", "a b  ", "<|endoftext|> hi", "a <|endoftext|>", "x<|endoftext|>y z", "<|endoftext", "|endoftext|>", "don't 'll a\tb", " ", "\n", "word, Word! été... x²³ ½% a_b"]
    texts += ["".join(rng.choice("ab1 \n\t.,é'漢 ²%") for _ in range(rng.randrange(14))) for _ in range(3000)]
    texts += ["".join(rng.choice(["a", " ", "\n", "<|endoftext|>", "<|", "endoftext", "|>"]) for _ in range(rng.randrange(9))) for _ in range(1000)]
    assert any(50256 in plain.encode(t, add_special_tokens=False).ids for t in texts)
    got = [np.frombuffer(x, encoder.kind).tolist() for k in range(0, len(texts), 100) for x in encoder.encode(texts[k : k + 100])]
    assert got == [x.ids for x in plain.encode_batch(texts, add_special_tokens=False)]


def test_memory_is_bounded(plain, monkeypatch):
    monkeypatch.setattr(T, "MEMORY", 1500)
    e = T.Encoder(T.default_tokenizer())
    for k in range(30):
        text = f"the word number{k} and the word again{k % 3} {'long' * 40}{k} end, {'x' * 100}."
        assert np.frombuffer(e.encode([text])[0], e.kind).tolist() == plain.encode(text, add_special_tokens=False).ids
    e.encode([])
    assert all(len(p) <= T.LONGEST for pieces in e.memory for p in pieces)
    assert sum(map(len, e.memory)) < 60


def test_layout_is_that_of_the_public_seekable_format():
    import struct

    import xxhash
    import zstandard

    out = io.BytesIO()
    T.write_frames(out, [(k, bytes([k, 0] * 300)) for k in range(9)], np.dtype("<u2"), frame=1000)
    raw = out.getvalue()
    n, flags, magic = struct.unpack("<IBI", raw[-9:])
    assert (flags, magic) == (0x80, 0x8F92EAB1)
    table = len(raw) - 9 - 12 * n - 8
    assert struct.unpack("<II", raw[table : table + 8]) == (0x184D2A5E, 12 * n + 9)
    at, body = 0, b""
    for k in range(n):
        packed, size, check = struct.unpack("<III", raw[table + 8 + 12 * k : table + 20 + 12 * k])
        frame = b"" if not size else zstandard.ZstdDecompressor().decompress(raw[at : at + packed], max_output_size=size)
        assert len(frame) == size and xxhash.xxh64_intdigest(frame) & 0xFFFFFFFF == check
        at, body = at + packed, body + frame
    assert at == table and body == b"".join(bytes([k, 0] * 300) for k in range(9)) and n > 3


def test_file_round_trip_and_random_access():
    rng, kind = np.random.default_rng(1), np.dtype("<u2")
    docs = [(i if i else None, rng.integers(0, 60_000, n).astype(kind)) for i, n in enumerate([3, 0, 5000, 1, 70_000, 12])]
    out = io.BytesIO()
    assert T.write_frames(out, ((i, x.tobytes()) for i, x in docs), kind, frame=4096) == (6, sum(len(x) for _, x in docs))
    file = T.TokenFile(out)
    assert all(a == b and (x == y).all() for (a, x), (b, y) in zip(file, docs, strict=True))
    assert (file.read(4) == docs[4][1]).all() and (file.read(5) == docs[5][1]).all() and len(file.sizes) > 2
    with pytest.raises(KeyError):
        file.read(77)


def test_damage_is_noticed():
    out = io.BytesIO()
    T.write_frames(out, [(1, b"\1\0" * 500)], np.dtype("<u2"))
    raw = bytearray(out.getvalue())
    file = T.TokenFile(io.BytesIO(raw))
    file.sums = file.sums + 1
    with pytest.raises(ValueError):
        list(file)
    with pytest.raises(ValueError):
        T.TokenFile(io.BytesIO(raw[:-3]))


def test_frames_are_plain_zstandard():
    import zstandard

    out = io.BytesIO()
    T.write_frames(out, [(1, b"\1\0\2\0"), (2, b"\3\0")], np.dtype("<u2"))
    assert zstandard.ZstdDecompressor().stream_reader(io.BytesIO(out.getvalue())).read() == b"\1\0\2\0\3\0"


def test_rows(odd_docs, no_docs, plain):
    rows = T.token_output(odd_docs).orderBy("start").collect()
    docs = sorted(((r["doc_id"], r["text"] or "") for r in odd_docs.collect()), key=lambda x: (x[0] is not None, x[0]))
    at = 0
    for row, (i, text) in zip(rows, docs, strict=True):
        ids = plain.encode(text, add_special_tokens=False).ids + [0]
        assert (row["doc_id"], row["start"], row["n_tokens"], row["ids_crc32"]) == (i, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        at += len(ids)
    assert T.token_output(no_docs).count() == 0


def test_starts_over_blocks_of_files(spark, plain, monkeypatch):
    monkeypatch.setattr(T, "FILES", 2)
    docs = spark.createDataFrame([(k % 40 if k % 3 else None, f"text number {k}" * (k % 7)) for k in range(200)], "doc_id long, text string")
    rows = T.token_output(docs).orderBy("start").collect()
    at = 0
    for r in rows:
        assert r["start"] == at
        at += r["n_tokens"]
    assert len(rows) == 200 and [r["doc_id"] for r in rows] == sorted((r["doc_id"] for r in rows), key=lambda x: (x is not None, x or 0))
