"""A minimal perfect hash over distinct 128-bit keys: cascaded bit arrays with a rank directory.

Each level places keys at hashed positions; a position hit once keeps its bit, the rest go to the next level.
A key's slot is the rank of its bit, so slots run from 0 to n - 1 without gaps.
"""

from __future__ import annotations

import numpy as np

from .common import mix

GAMMA = 2.0
MAX_LEVELS = 64


def _position(h1: np.ndarray, h2: np.ndarray, level: int, size: int) -> np.ndarray:
    x = mix(h1 + np.uint64((level * 0x9E3779B97F4A7C15) & 0xFFFFFFFFFFFFFFFF) ^ h2 * np.uint64(0xD6E8FEB86659FD93))
    return ((x >> np.uint64(32)) * np.uint64(size)) >> np.uint64(32)


def build(h1: np.ndarray, h2: np.ndarray) -> tuple[list[int], np.ndarray]:
    """Level sizes in bits and all levels' words. Keys (h1, h2) must be distinct and fewer than 2**31."""
    left, sizes, words = np.arange(len(h1)), [], []
    while len(left):
        if len(sizes) == MAX_LEVELS:
            raise ValueError("keys of a perfect hash must be distinct")
        size = max(64, -(-int(len(left) * GAMMA) // 64) * 64)
        at = _position(h1[left], h2[left], len(sizes), size).astype(np.int64)
        alone = np.bincount(at, minlength=size)[at] == 1
        bits = np.zeros(size, dtype=np.uint8)
        bits[at[alone]] = 1
        sizes.append(size)
        words.append(np.packbits(bits, bitorder="little").view("<u8"))
        left = left[~alone]
    return sizes, np.concatenate(words) if words else np.empty(0, dtype="<u8")


def directory(words: np.ndarray) -> np.ndarray:
    """Bits set before each word."""
    return np.concatenate([[0], np.cumsum(np.bitwise_count(words), dtype=np.int64)[:-1]]).astype(np.uint32) if len(words) else np.empty(0, dtype=np.uint32)


def slots(sizes: list[int], words: np.ndarray, ranks: np.ndarray, h1: np.ndarray, h2: np.ndarray) -> np.ndarray:
    """The slot of each key; -1 where no level holds it, and any slot for some keys that were never in."""
    out = np.full(len(h1), -1, dtype=np.int64)
    left, base = np.arange(len(h1)), 0
    for level, size in enumerate(sizes):
        if not len(left):
            break
        at = _position(h1[left], h2[left], level, size)
        word = base + (at >> np.uint64(6)).astype(np.int64)
        bit = at & np.uint64(63)
        hit = (words[word] >> bit) & np.uint64(1) == 1
        below = words[word[hit]] & ((np.uint64(1) << bit[hit]) - np.uint64(1))
        out[left[hit]] = ranks[word[hit]] + np.bitwise_count(below).astype(np.int64)
        left, base = left[~hit], base + size // 64
    return out
