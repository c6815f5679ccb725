"""Simple-8b word-aligned coding of integer ids, vectorised over sub-blocks.

A 64-bit word holds a 4-bit selector and 60 bits of payload; the selector names
how many values of which width the payload packs. A block is cut into
sub-blocks of ``SUB`` values that start at a word border of their own, so all
sub-blocks are packed and unpacked in step. Values of ``escape_bits`` and more
are kept beside the words and stand as 0 in them.
"""

from __future__ import annotations

import sys

import numpy as np
from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])

SUB = 1024
# Fixed values of the format: values in a word and bits of each, by selector.
COUNTS = (240, 120, 60, 30, 20, 15, 12, 10, 8, 7, 6, 5, 4, 3, 2, 1)
WIDTHS = (0, 0, 1, 2, 3, 4, 5, 6, 7, 8, 10, 12, 15, 20, 30, 60)


def _widest(bits: np.ndarray) -> dict[int, np.ndarray]:
    """For each count c, the greatest of the c entries from each place on, along rows."""

    def joined(a: np.ndarray, b: np.ndarray, shift: int) -> np.ndarray:
        out = a.copy()
        np.maximum(out[:, :-shift], b[:, shift:], out=out[:, :-shift])
        return out

    m = {1: bits}
    for c in sorted(COUNTS)[1:]:
        a = max(x for x in m if x < c)
        b = next(x for x in sorted(m) if x + a >= c)
        m[c] = joined(m[a], m[b], c - b)
    return m


_SHORT = np.repeat(np.arange(18, dtype=np.uint8), np.r_[1, 1 << np.arange(17)])  # of values below 2 ** 17


def _bit_lengths(grid: np.ndarray) -> np.ndarray:
    top = int(grid.max()).bit_length() if grid.size else 0
    if top <= 17:
        return _SHORT[grid]
    bits = np.zeros(grid.shape, np.uint8)
    for b in range(top):
        bits += grid >= np.uint64(1 << b)
    return bits


def encode(values: np.ndarray, escape_bits: int = 20):
    """(words, first word of each sub-block, escaped places, escaped values)."""
    values = np.asarray(values, np.uint64)
    places = np.flatnonzero(values >> np.uint64(escape_bits))
    escaped = values[places]
    rows = -(-len(values) // SUB)
    grid = np.zeros((rows, SUB + 240), np.uint64)
    flat = np.zeros(rows * SUB, np.uint64)
    flat[: len(values)] = values
    flat[places] = 0
    grid[:, :SUB] = flat.reshape(rows, SUB)
    bits = _bit_lengths(grid)
    choice = np.full(grid.shape, len(COUNTS) - 1, np.uint8)
    widest = _widest(bits)
    for s in range(len(COUNTS) - 1):  # what fits one selector fits all later ones
        choice -= (widest[COUNTS[s]] <= WIDTHS[s]).view(np.uint8)
    sizes = np.full(rows, SUB)
    if rows:
        sizes[-1] = len(values) - (rows - 1) * SUB
    step = np.array(COUNTS, np.int64)
    row, at = np.arange(rows), np.zeros(rows, np.int64)
    starts = []
    while len(row):
        starts.append((row, at))
        at = at + step[choice[row, at]]
        live = at < sizes[row]
        row, at = row[live], at[live]
    if not starts:
        return np.zeros(0, np.uint64), np.zeros(1, np.int64), places, escaped
    row, at = np.concatenate([r for r, _ in starts]), np.concatenate([a for _, a in starts])
    order = np.lexsort((at, row))
    row, at = row[order], at[order]
    selector = choice[row, at]
    words = selector.astype(np.uint64) << np.uint64(60)
    for s in np.unique(selector):
        if WIDTHS[s]:
            own = np.flatnonzero(selector == s)
            lanes = np.arange(COUNTS[s])
            packed = grid[row[own, None], at[own, None] + lanes] << (lanes * WIDTHS[s]).astype(np.uint64)
            words[own] |= np.bitwise_or.reduce(packed, axis=1)
    return words, np.searchsorted(row, np.arange(rows + 1)), places, escaped


def decode(words: np.ndarray, firsts: np.ndarray, n: int, places=(), escaped=()) -> np.ndarray:
    rows = len(firsts) - 1
    if n == 0:
        return np.zeros(0, np.uint64)
    selector = (words >> np.uint64(60)).astype(np.int64)
    counts = np.array(COUNTS, np.int64)[selector]
    total = np.r_[0, np.cumsum(counts)]
    row = np.repeat(np.arange(rows), np.diff(firsts))
    at = total[:-1] - total[firsts[:-1]][row]
    grid = np.zeros((rows, SUB + 240), np.uint64)
    for s in np.unique(selector):
        if WIDTHS[s]:
            own = np.flatnonzero(selector == s)
            lanes = np.arange(COUNTS[s])
            mask = np.uint64((1 << WIDTHS[s]) - 1)
            values = (words[own, None] >> (lanes * WIDTHS[s]).astype(np.uint64)) & mask
            grid[row[own, None], at[own, None] + lanes] = values
    out = grid[:, :SUB].reshape(-1)[:n]
    out[np.asarray(places, np.int64)] = np.asarray(escaped, np.uint64)
    return out
