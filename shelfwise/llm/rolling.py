"""Vectorised hashes of substrings, and the best place in each window."""

from __future__ import annotations

import sys

import numpy as np
from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])

_U = np.uint64
_BASE, _WORD_BASE = 0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F
_M1, _M2 = _U(0xFF51AFD7ED558CCD), _U(0xC4CEB9FE1A85EC53)


def mix(x: np.ndarray) -> np.ndarray:
    """Spreads every bit of 64-bit values over all bits."""
    x = x ^ (x >> _U(33))
    x *= _M1
    x ^= x >> _U(29)
    x *= _M2
    x ^= x >> _U(32)
    return x


_TABLE = mix(np.arange(1, 257, dtype=np.uint64) * _U(_BASE))
_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    have = _POWERS.get(base)
    if have is None or len(have[0]) < n:
        size = 1 << max(10, (n - 1).bit_length())
        pair = []
        for b in (base, pow(base, -1, 1 << 64)):
            p = np.full(size, b, np.uint64)
            p[0] = 1
            pair.append(np.cumprod(p))
        have = _POWERS[base] = (pair[0], pair[1])
    return have


class Hashes:
    """Hash of any range of a sequence of 64-bit symbols, from prefix sums."""

    def __init__(self, symbols: np.ndarray, base: int = _BASE):
        power, self.inverse = _powers(base, len(symbols) + 1)
        self.prefix = np.zeros(len(symbols) + 1, np.uint64)
        np.cumsum(symbols * power[: len(symbols)], out=self.prefix[1:])

    @classmethod
    def of_bytes(cls, data: np.ndarray) -> Hashes:
        return cls(_TABLE[data])

    @classmethod
    def of_words(cls, words: np.ndarray) -> Hashes:
        return cls(words, _WORD_BASE)

    def fixed(self, length: int) -> np.ndarray:
        """Of [i, i + length) for every i."""
        n = max(0, len(self.prefix) - length)
        return mix((self.prefix[length:] - self.prefix[:n]) * self.inverse[:n])

    def ranges(self, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
        """Of [start, stop); ranges of other lengths differ."""
        raw = (self.prefix[stop] - self.prefix[start]) * self.inverse[start]
        return mix(raw + (stop - start).astype(np.uint64) * _U(_BASE))


def sliding_min(values: np.ndarray, width: int) -> np.ndarray:
    if len(values) < width:
        return values[:0]
    have = 1
    while 2 * have <= width:
        values = np.minimum(values[:-have], values[have:])
        have *= 2
    rest = width - have
    return np.minimum(values[:-rest], values[rest:]) if rest else values


def split_words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of each word ``[^\\x20\\x09-\\x0D]+``, and the first word of each text."""
    solid = np.ones(len(data) + 1, bool)
    solid[:-1] = (data != 32) & ((data < 9) | (data > 13))
    solid[-1] = False
    first = np.zeros(len(data) + 1, bool)
    first[offsets] = True
    start = solid.copy()
    start[1:] &= ~solid[:-1] | first[1:]
    starts = np.flatnonzero(start)
    stop = solid[:-1] & (~solid[1:] | first[1:])
    return starts, np.flatnonzero(stop) + 1, np.searchsorted(starts, offsets)


def word_symbols(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    return Hashes.of_bytes(data).ranges(starts, ends)
