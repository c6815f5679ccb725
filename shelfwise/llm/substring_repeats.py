"""Removal of long byte strings that occur more than once: hashes of anchored spans.

Sampled positions are ranked by a hash of ``width / 4`` bytes; Spark sorts them
by it and a hash of their whole span, and those with a unique rank drop out.
Spans that equal another are settled together, see ``repeats``. What is left to
decide, at single windows, is decided by the hashes of their two halves. This
takes the place of prefix doubling: no rounds, no ranking of pairs of ranks.
"""

from __future__ import annotations

import hashlib
import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame

from shelfwise.llm.batches import record, slices
from shelfwise.llm.repeats import NULL_ID, covered, documents, repeated_spans, spans_of, valid_windows
from shelfwise.llm.rolling import Hashes, mix, sliding_min

cloudpickle.register_pickle_by_value(sys.modules[__name__])

_OUT = pa.schema(
    [("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()),
     ("kept_sha256", pa.string())]
)


def _reach(width: int) -> tuple[int, int]:
    return width // 4, width // 2


def _scan(width: int):
    quarter = width // 4

    def scan(data: np.ndarray, offsets: np.ndarray):
        if len(data) < width:
            none = np.zeros(0, np.int64)
            return none.view(np.uint64), none.view(np.uint64), none, none, none, none, none, none
        hashes = Hashes.of_bytes(data)
        rank = hashes.fixed(quarter)
        bits = np.uint64(len(data).bit_length())
        places = np.arange(len(rank), dtype=np.uint64)
        best = sliding_min((mix(rank) >> bits << bits) | places, width - quarter + 1)
        anchor = (best & ((np.uint64(1) << bits) - np.uint64(1))).astype(np.int64)
        low, high = spans_of(anchor, valid_windows(offsets, width, len(anchor)))
        doc = np.searchsorted(offsets, low, side="right") - 1
        a = anchor[low]
        before, behind = _reach(width)
        left = hashes.ranges(np.maximum(a - before, 0), a + quarter)
        right = hashes.ranges(a, np.minimum(a + width - behind, len(data)))
        name = hashes.ranges(low, high + width)
        return rank[a], name, doc, low - offsets[doc], high - offsets[doc], a - low, left, right

    return scan


def _names(width: int):
    half = width // 2

    def names(data, offsets, doc, start):
        hashes, at = Hashes.of_bytes(data), offsets[doc] + start
        return hashes.ranges(at, at + half), hashes.ranges(at + half, at + width)

    return names


def _remove(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            rows = []
            for key, text, spans in zip(
                part.column("key").to_pylist(), part.column("text"), part.column("spans")
            ):
                data = np.frombuffer(text.as_buffer(), np.uint8) if len(text.as_buffer()) else np.zeros(0, np.uint8)
                gone = covered(spans.values.to_numpy() if spans.is_valid else None, width, len(data))
                runs = int(np.count_nonzero(gone[1:] & ~gone[:-1])) + int(len(gone) > 0 and gone[0])
                kept = data[~gone].tobytes() if runs else data
                rows.append(
                    (None if key == NULL_ID else key, len(data), int(gone.sum()), runs, hashlib.sha256(kept).hexdigest())
                )
            yield record(_OUT, *zip(*rows))

    return run


def remove_repeats(df: DataFrame, width: int = 200, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256: one row per row of ``df``.

    Removes each UTF-8 byte that a string of ``width`` bytes covers which starts
    at another place too, in any document, the same one included (overlaps
    count). ``width`` is from 8 to 255. Null text counts as empty; texts shorter
    than ``width`` lose nothing; repeated rows lose all that is long enough. A
    null id stays null, an empty table gives no rows, further columns are
    ignored.
    """
    if not 8 <= width <= 255:
        raise ValueError("width must be from 8 to 255")
    docs = documents(df, id_col, text_col)
    spans = repeated_spans(docs, _scan(width), _names(width), _reach(width), False, "substring")
    return (
        docs.join(spans, ["key", "mark"], "left")
        .select("key", "text", "spans")
        .mapInArrow(_remove(width), "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")
    )
