"""Vectorised word and shingle hashes of texts.

A word is a maximal run of ASCII letters and digits or non-ASCII characters, lower-cased. Hashes are 64 bits wide and
the same in every process.
"""

from __future__ import annotations

from collections.abc import Iterable

import numpy as np

#: Fixed odd multipliers of the polynomial and mixing hashes.
P_BYTE, P_WORD = 0x9E3779B97F4A7C15 | 1, 0xC2B2AE3D27D4EB4F | 1
MIX = (np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53))
_SPACE = bytes(c if c >= 128 or chr(c).isalnum() else 32 for c in range(256))
_SEGMENT = 1 << 22
_powers: list[np.ndarray] = []


def normal(text: str | None) -> bytes:
    """Lower-cased words with one space between them, in UTF-8."""
    return b" ".join((text or "").lower().encode("utf-8", "surrogatepass").translate(_SPACE).split())


def mix(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint64(33))
    h = h * MIX[0]
    h ^= h >> np.uint64(33)
    h = h * MIX[1]
    return h ^ (h >> np.uint64(33))


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    if not _powers or len(_powers[0]) < n:
        size = max(n, 1 << 16)
        inverse = pow(P_BYTE, -1, 1 << 64)
        _powers[:] = [np.concatenate([np.ones(1, np.uint64), np.full(size, p, np.uint64)]).cumprod() for p in (P_BYTE, inverse)]
    return _powers[0], _powers[1]


def word_hashes(normals: Iterable[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words of all texts in order, and offsets: text i has words offsets[i] to offsets[i + 1] - 1.

    normals: texts as normal() returns them. Longer ones are hashed in segments that end between words.
    """
    found, counts = [], []
    pending: list[bytes] = []
    normals = list(normals)

    def flush() -> None:
        if pending:
            found.append(_hash_spaced(b" ".join(pending)))
            pending.clear()

    size = 0
    for b in normals:
        counts.append(b.count(b" ") + 1 if b else 0)
        while len(b) > _SEGMENT:
            cut = b.find(b" ", _SEGMENT)
            if cut < 0:
                break
            flush()
            found.append(_hash_spaced(b[:cut]))
            b, size = b[cut + 1 :], 0
        if b:
            pending.append(b)
            size += len(b)
            if size > _SEGMENT:
                flush()
                size = 0
    flush()
    flat = np.concatenate(found) if found else np.zeros(0, np.uint64)
    return flat, np.concatenate([[0], np.cumsum(counts, dtype=np.int64)]).astype(np.int64)


def _hash_spaced(buf: bytes) -> np.ndarray:
    a = np.frombuffer(buf, np.uint8)
    ends = np.flatnonzero(a == 32)
    starts = np.concatenate([[0], ends + 1])
    ends = np.concatenate([ends, [len(a)]])
    up, down = _power(len(a) + 1)
    sums = np.zeros(len(a) + 1, np.uint64)
    np.cumsum((a.astype(np.uint64) + np.uint64(1)) * up[: len(a)], out=sums[1:])
    return mix((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64))


def shingles(words: np.ndarray, offsets: np.ndarray, n: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of n words within each text, and their offsets by text.

    A text of 1 to n - 1 words has one shingle, of all its words; one without words has none.
    """
    counts = np.diff(offsets)
    acc = np.zeros(max(len(words) - n + 1, 0), np.uint64)
    for k in range(n):
        acc = acc * np.uint64(P_WORD) + words[k : k + len(acc)]
    acc = mix(acc)
    full = np.maximum(counts - n + 1, 0)
    out = np.where((counts > 0) & (full == 0), 1, full)
    starts = np.concatenate([[0], np.cumsum(out)])
    if (out == full).all():
        take = np.repeat(offsets[:-1] - starts[:-1], full) + np.arange(starts[-1])
        return acc[take], starts
    flat = np.empty(starts[-1], np.uint64)
    long = full > 0
    inner = np.repeat(offsets[:-1][long], full[long]) + _ranges(full[long])
    flat[np.repeat(starts[:-1][long], full[long]) + _ranges(full[long])] = acc[inner]
    for i in np.flatnonzero(out > full):
        h = np.uint64(counts[i])
        for w in words[offsets[i] : offsets[i + 1]]:
            h = np.uint64((int(h) * P_WORD + int(w)) & 0xFFFFFFFFFFFFFFFF)
        flat[starts[i]] = mix(np.array([h]))[0]
    return flat, starts


def _ranges(counts: np.ndarray) -> np.ndarray:
    """0 to c - 1 for each c of counts, one after the other."""
    ends = np.cumsum(counts)
    return np.arange(ends[-1] if len(ends) else 0) - np.repeat(ends - counts, counts)
