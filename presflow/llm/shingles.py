"""Word shingles as sorted arrays of 64-bit hashes, and min-wise signatures of them."""

from __future__ import annotations

import numpy as np
import xxhash

from .common import claim

WORDS = 5
#: Coordinates of a signature.
COORDINATES = 64
_BASE = np.uint64(0x9E3779B97F4A7C15)
_TABLE_ENTRIES = 200_000


class _Hashes(dict):
    """Hashes of words; cleared when large."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= _TABLE_ENTRIES:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value


_hashes = _Hashes()


def shingles(text: bytes, n: int = WORDS) -> np.ndarray:
    """Distinct shingles of n words, A-Z in lower case; fewer words make one shingle of them all, no word none."""
    claim("shingles", _hashes.clear)
    words = text.lower().split()  # of bytes: lowers A-Z alone, splits at \x20 and \x09-\x0D
    if not words:
        return np.zeros(0, np.uint64)
    if len(words) < n:
        return np.array([xxhash.xxh3_64_intdigest(b" ".join(words), seed=len(words))], np.uint64)
    h = np.fromiter(map(_hashes.__getitem__, words), np.uint64, len(words))
    out = h[: len(h) - n + 1].copy()
    for i in range(1, n):
        out = out * _BASE + h[i : len(h) - n + 1 + i]
    out = (out ^ out >> np.uint64(31)) * np.uint64(0xBF58476D1CE4E5B9)
    return np.unique(out ^ out >> np.uint64(29))


def _factors(n: int) -> np.ndarray:
    return np.random.default_rng(64).integers(1, 1 << 63, n, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


_made = {COORDINATES: _factors(COORDINATES)}


def signature(s: np.ndarray, coordinates: int = COORDINATES) -> np.ndarray:
    """So many numbers of 32 bits; two sets agree in each with a chance of their similarity."""
    if (factors := _made.get(coordinates)) is None:
        factors = _made[coordinates] = _factors(coordinates)
    least = np.full(coordinates, np.iinfo(np.uint64).max, np.uint64)
    step = max(1, (1 << 18) // coordinates)
    for at in range(0, len(s), step):
        least = np.minimum(least, (s[at : at + step, None] * factors).min(0))
    return (least >> np.uint64(32)).astype(np.uint32)


def linked(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    """100 * intersection >= percent * union, for sorted sets."""
    small, large = (a, b) if len(a) <= len(b) else (b, a)
    if 100 * len(small) < percent * len(large):
        return False
    at = np.searchsorted(large, small)
    at[at == len(large)] = 0
    both = int((large[at] == small).sum())
    return 100 * both >= percent * (len(a) + len(b) - both)
