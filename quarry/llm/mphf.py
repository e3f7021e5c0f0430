"""Minimal perfect hash functions over sets of digests, built and probed with numpy.

Keys go through levels of bit arrays: a key that is alone in its bit of a level is placed there, the others go on to the
next level. A placed key's slot is the rank of its bit among all set bits, so n keys fill slots 0 to n - 1.
"""

from __future__ import annotations

import numpy as np

GAMMA = 1.5
_SEEDS = np.random.default_rng(20240229).integers(1, 1 << 63, 64, dtype=np.uint64) | np.uint64(1)


def _place(keys: np.ndarray, level: int, bits: int) -> np.ndarray:
    """Bit of each key; keys: rows of 4 unsigned 64-bit words."""
    s = _SEEDS[level % 32]
    h = (keys[:, 0] ^ s) * np.uint64(0x9E3779B97F4A7C15) + keys[:, 1] * _SEEDS[32 + level % 32]
    h ^= (keys[:, 2] + np.uint64(level)) ^ (keys[:, 3] >> np.uint64(7))
    h ^= h >> np.uint64(31)
    h *= np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(32)
    return (h % np.uint64(bits)).astype(np.int64)


def words(digests: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(digests), np.uint64).reshape(-1, 4)


def build(digests: list[bytes]) -> tuple[list[int], bytes, np.ndarray]:
    """Level sizes in bits, the packed bits of all levels, and the slot of each of the distinct 32-byte digests."""
    keys, left = words(digests), np.arange(len(digests))
    slots = np.full(len(digests), -1, np.int64)
    sizes, packed, used = [], [], 0
    while len(left):
        if len(sizes) > 500:
            raise ValueError("digests must be distinct")
        bits = max(64, int(GAMMA * len(left)) + 7 & ~7)
        at = _place(keys[left], len(sizes), bits)
        alone = np.bincount(at, minlength=bits) == 1
        placed = alone[at]
        rank = np.cumsum(alone) - 1
        slots[left[placed]] = used + rank[at[placed]]
        used += int(placed.sum())
        sizes.append(bits)
        packed.append(np.packbits(alone))
        left = left[~placed]
    return sizes, b"".join(x.tobytes() for x in packed), slots


def probe(sizes: list[int], packed: bytes, digests: list[bytes]) -> np.ndarray:
    """Slot of each digest; -1 where no level has its bit. A digest outside the set may get any slot: compare bytes."""
    out = np.full(len(digests), -1, np.int64)
    if not digests or not sizes:
        return out
    keys, left, start, used = words(digests), np.arange(len(digests)), 0, 0
    for level, bits in enumerate(sizes):
        n = (bits + 7) // 8
        alone = np.unpackbits(np.frombuffer(packed, np.uint8, n, start), count=bits).astype(bool)
        at = _place(keys[left], level, bits)
        hit = alone[at]
        rank = np.cumsum(alone)
        out[left[hit]] = used + rank[at[hit]] - 1
        used += int(rank[-1])
        left, start = left[~hit], start + n
        if not len(left):
            break
    return out
