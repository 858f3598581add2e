"""Hashes of stretches of symbols in numpy: polynomials modulo 2^64 from running sums, and a finaliser."""

from __future__ import annotations

import numpy as np

CACHED_WORDS = 200_000


def mixed(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every bit of the input moves every bit of the output."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class WordHashes(dict):
    """word -> 64-bit hash, kept for the words seen lately."""

    def __missing__(self, word: bytes) -> int:
        import xxhash

        if len(self) > CACHED_WORDS:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value


class Powers:
    """Hashes to an odd base; the hash of a stretch comes from two running sums, whatever its length."""

    def __init__(self, base: int):
        self.base, self.inverse = np.uint64(base), np.uint64(pow(base, -1, 2**64))
        self.up = self.down = np.ones(1, np.uint64)

    def _reach(self, n: int) -> None:
        if len(self.up) < n:
            n = max(n, 1 << 16)
            self.up, self.down = (
                np.concatenate([np.ones(1, np.uint64), np.cumprod(np.full(n, b, np.uint64), dtype=np.uint64)])
                for b in (self.base, self.inverse)
            )

    def sums(self, symbols: np.ndarray) -> np.ndarray:
        self._reach(len(symbols) + 1)
        out = np.zeros(len(symbols) + 1, np.uint64)
        np.cumsum(symbols * self.up[: len(symbols)], out=out[1:], dtype=np.uint64)
        return out

    def many(self, sums: np.ndarray, n: int) -> np.ndarray:
        """Hashes of all stretches of n symbols."""
        return (sums[n:] - sums[:-n]) * self.down[: len(sums) - n]

    def some(self, sums: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Hashes of the stretches from start to end, end exclusive."""
        return (sums[end] - sums[start]) * self.down[start]
