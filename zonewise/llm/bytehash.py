"""Vectorised hashing of byte strings: rolling 64-bit hashes of all k-grams and the window minima that pick sample points.

Everything works on blocks of bounded size, so a text of any length needs the same memory.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np

_U = np.uint64


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser: spreads every input bit over the whole word."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


@lru_cache(maxsize=8)
def _powers(n: int, base: int) -> tuple[np.ndarray, np.ndarray]:
    up, down = np.full(n, base, np.uint64), np.full(n, pow(base, -1, 1 << 64), np.uint64)
    up[0] = down[0] = 1
    return np.cumprod(up), np.cumprod(down)


@lru_cache(maxsize=8)
def _letters(seed: int) -> np.ndarray:
    return mix(np.arange(1, 257, dtype=np.uint64) * _U(0x9E3779B97F4A7C15) + _U(seed))


class Rolling:
    """Hashes of any substring of one block in constant time: polynomial sums modulo 2**64 over random letter values."""

    def __init__(self, data: np.ndarray, seed: int):
        n = len(data)
        size = 1 << max(16, int(n).bit_length())
        up, self._down = _powers(size, (2 * seed + 1) * 0x5851F42D4C957F2D % (1 << 64) | 1)
        self._sums = np.zeros(n + 1, np.uint64)
        np.cumsum(_letters(seed)[data] * up[:n], out=self._sums[1:])

    def grams(self, k: int) -> np.ndarray:
        """Hash of every substring of length k, by start."""
        s = self._sums
        return mix((s[k:] - s[:-k]) * self._down[: len(s) - k])

    def at(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((self._sums[end] - self._sums[start]) * self._down[start] + (end - start).astype(np.uint64))


def window_minima(keys: np.ndarray, w: int) -> np.ndarray:
    """Position of the smallest key in every window of w keys; ties go to the leftmost. At most 2**24 keys."""
    n = len(keys)
    packed = (keys & _U(0xFFFFFFFFFF000000)) | np.arange(n, dtype=np.uint64)
    full = np.full(-(-n // w) * w, _U(0xFFFFFFFFFFFFFFFF))
    full[:n] = packed
    rows = full.reshape(-1, w)
    ahead = np.minimum.accumulate(rows, axis=1).reshape(-1)
    back = np.minimum.accumulate(rows[:, ::-1], axis=1)[:, ::-1].reshape(-1)
    return (np.minimum(back[: n - w + 1], ahead[w - 1 : n]) & _U(0xFFFFFF)).astype(np.int64)
