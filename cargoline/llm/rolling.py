"""Hashes of all substrings of one length, and of single substrings, from one pass over the bytes."""

from __future__ import annotations

import numpy as np

_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_TABLE = np.random.default_rng(42).integers(0, 1 << 64, 256, dtype=np.uint64)
_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2**64."""
    size = 1 << max(16, (n - 1).bit_length())
    if size not in _POWERS:
        _POWERS.clear()
        made = []
        for b in (_BASE, _INVERSE):
            p = np.full(size, b, dtype=np.uint64)
            p[0] = 1
            made.append(np.multiply.accumulate(p))
        _POWERS[size] = tuple(made)
    up, down = _POWERS[size]
    return up[:n], down[:n]


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(32))


class Rolling:
    """Prefix sums of a polynomial over the bytes; equal substrings have equal hashes wherever they stand."""

    def __init__(self, data: np.ndarray):
        up, self._down = _powers(len(data) + 1)
        self._sums = np.zeros(len(data) + 1, dtype=np.uint64)
        np.cumsum(_TABLE[data] * up[:-1], out=self._sums[1:])

    def grams(self, size: int) -> np.ndarray:
        """Hash of every substring of ``size`` bytes."""
        return mixed((self._sums[size:] - self._sums[:-size]) * self._down[: len(self._sums) - size])

    def between(self, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
        """Hashes of substrings from ``start`` to ``stop``; those of different lengths are not comparable."""
        return mixed((self._sums[stop] - self._sums[start]) * self._down[start])


def sliding_argmin(values: np.ndarray, width: int) -> np.ndarray:
    """Leftmost place of the smallest of every ``width`` neighbouring values, by the upper bits of the values."""
    bits = np.uint64(max(1, int(len(values) - 1).bit_length()))
    low = (np.uint64(1) << bits) - np.uint64(1)
    v = (values & ~low) | np.arange(len(values), dtype=np.uint64)
    step = 1
    while step * 2 <= width:
        v = np.minimum(v[:-step], v[step:])
        step *= 2
    rest = width - step
    if rest:
        v = np.minimum(v[:-rest], v[rest:])
    return (v & low).astype(np.int64)
