"""Removal of word sequences seen in an earlier document: recompression.

Two rounds name runs and pairs of neighbouring symbols. In a round, equal
neighbours join to a run, and each symbol falls to a left or a right class by a
bit of its name; a left one followed by a right one join to a pair. A name is a
hash of what it stands for, so every task gives equal substrings equal names
without exchanging a dictionary, and inside a repeat the same borders survive.
The border that outlives most rounds within a window is its anchor, the symbols
around it are its rank; spans of windows with one rank are compared and settled
as ``repeats`` says.
"""

from __future__ import annotations

import hashlib
import sys
from collections.abc import Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame

from shelfwise.llm.batches import record, slices
from shelfwise.llm.repeats import NULL_ID, covered, documents, repeated_spans, spans_of, valid_windows
from shelfwise.llm.rolling import Hashes, mix, sliding_min, split_words, word_symbols

cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: Words on each side of a border that its name and its fate in two rounds rest on.
REACH = 3

_OUT = pa.schema(
    [("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept_sha256", pa.string())]
)


def _joins(left: np.ndarray, right: np.ndarray, bit: int) -> np.ndarray:
    """Whether two neighbouring symbols join in a round: equal ones, or left class before right class."""
    one = np.uint64(1)
    return (left == right) | (((left >> np.uint64(bit)) & one == 0) & ((right >> np.uint64(bit)) & one == 1))


def survived(words: np.ndarray, hashes: Hashes) -> np.ndarray:
    """For the border before each word, the rounds (0 to 2) it outlives within its reach."""
    n = len(words)
    level = np.zeros(n, np.uint64)
    if n < 2:
        return level
    stands = np.ones(n, bool)
    stands[1:] = ~_joins(words[:-1], words[1:], 7)
    level[stands] = 1
    borders = np.flatnonzero(stands)
    x, b, y = borders[:-2], borders[1:-1], borders[2:]
    near = (b - x < REACH) & (y - b < REACH)
    x, b, y = x[near], b[near], y[near]
    level[b[~_joins(hashes.ranges(x, b), hashes.ranges(b, y), 11)]] = 2
    return level


def _reach(width: int) -> tuple[int, int]:
    return (width + 1) // 2, width // 2


def _scan(width: int):
    def scan(data: np.ndarray, offsets: np.ndarray):
        starts, ends, first = split_words(data, offsets)
        none = np.zeros(0, np.int64)
        if len(starts) < width:
            return none.view(np.uint64), none.view(np.uint64), none, none, none, none, none, none
        words = word_symbols(data, starts, ends)
        hashes = Hashes.of_words(words)
        around = hashes.fixed(2 * REACH)  # of the border at i + REACH
        level = survived(words, hashes)[REACH : REACH + len(around)]
        bits = np.uint64(len(words).bit_length())
        places = np.arange(len(around), dtype=np.uint64)
        order = ((np.uint64(2) - level) << np.uint64(62)) | (mix(around) >> np.uint64(2) >> bits << bits) | places
        best = sliding_min(order, width - 2 * REACH + 1)
        anchor = (best & ((np.uint64(1) << bits) - np.uint64(1))).astype(np.int64)
        low, high = spans_of(anchor, valid_windows(first, width, len(anchor)))
        doc = np.searchsorted(first, low, side="right") - 1
        border = anchor[low] + REACH
        before, behind = _reach(width)
        left = hashes.ranges(np.maximum(border - before, 0), border + REACH)
        right = hashes.ranges(border - REACH, np.minimum(border + width - behind, len(words)))
        name = hashes.ranges(low, high + width)
        return around[anchor[low]], name, doc, low - first[doc], high - first[doc], border - low, left, right

    return scan


def _names(width: int):
    half = width // 2

    def names(data, offsets, doc, start):
        starts, ends, first = split_words(data, offsets)
        hashes = Hashes.of_words(word_symbols(data, starts, ends))
        at = first[doc] + start
        return hashes.ranges(at, at + half), hashes.ranges(at + half, at + width)

    return names


def _remove(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            rows = []
            for key, text, spans in zip(part.column("key").to_pylist(), part.column("text"), part.column("spans")):
                words = text.as_buffer().to_pybytes().split()
                gone = covered(spans.values.to_numpy() if spans.is_valid else None, width, len(words))
                kept = b" ".join(compress(words, (~gone).tolist()))
                rows.append(
                    (None if key == NULL_ID else key, len(words), int(gone.sum()), hashlib.sha256(kept).hexdigest())
                )
            yield record(_OUT, *zip(*rows))

    return run


def remove_seen(df: DataFrame, width: int = 13, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256: one row per row of ``df``.

    Removes each word that a window of ``width`` words covers whose sequence
    also starts in a document of smaller id; ``width`` is from 8 to 255. Words
    are runs of characters other than ASCII white space. Null text has no words;
    shorter texts lose nothing; rows of equal id do not count against each
    other. A null id is smaller than any other and stays null; an empty table
    gives no rows; further columns are ignored.
    """
    if not 8 <= width <= 255:
        raise ValueError("width must be from 8 to 255")
    docs = documents(df, id_col, text_col)
    spans = repeated_spans(docs, _scan(width), _names(width), _reach(width), True, "recompression")
    return (
        docs.join(spans, ["key", "mark"], "left")
        .select("key", "text", "spans")
        .mapInArrow(_remove(width), "doc_id long, n_words long, n_removed long, kept_sha256 string")
    )
