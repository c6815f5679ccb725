"""Repeated windows of fixed length in a corpus, found from sampled positions.

Every window of ``width`` symbols names one position inside it, its anchor, by
a rule that looks at the window alone; equal windows name the same one. The
windows of a document that share an anchor form a span. A row per span, not per
window, goes through the shuffle: the anchor's rank (a name of the symbols
around it), the name of all the span covers, and its place.

One sort by (rank, name) settles most spans. A rank that occurs once repeats
nothing. Spans with equal names are copies of each other, window by window. Only
where one rank has several names are windows looked at one by one, and of each
name only those spans that another could still match.

Ranks and names are 64-bit hashes and are only ever compared together, so a
wrong match needs two of them to collide at once.
"""

from __future__ import annotations

import sys
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfwise.llm.batches import bytes_of, offsets_of, slices, staged, tasks
from shelfwise.llm.rolling import mix

cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: Bytes of text in one vectorised step.
STEP_BYTES = 1 << 20
#: Stands for a null id: no other long is smaller.
NULL_ID = -(2**63)

SETTLED, OPEN, PARTNER = 0, 1, 2  # repeated; to be looked at; repeated, but may match open ones

SENT, DONE, HEAD = 0, 1, 2  # as found; already settled; stands for equal spans already settled

_SPAN_DDL = "rank long, name long, key long, mark long, span long, state long, left long, right long"
_FOUND_DDL = "kind byte, rank long, key long, mark long, span long, left long, right long, at long"
_WINDOW_DDL = "first long, second long, key long, mark long, span long"


def documents(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(key, mark, text): rows that repeat an id are told apart by a hash of their text."""
    text = F.coalesce(df[text_col].cast("string"), F.lit(""))
    return df.select(
        F.coalesce(df[id_col].cast("long"), F.lit(NULL_ID)).alias("key"),
        F.xxhash64(text).alias("mark"),
        text.alias("text"),
    )


def spans_of(anchor: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and last window of each span; ``last`` tells valid windows."""
    n = len(anchor)
    valid = last
    same = np.zeros(n + 1, bool)
    if n > 1:
        same[1:n] = valid[1:] & valid[:-1] & (anchor[1:] == anchor[:-1])
    return np.flatnonzero(valid & ~same[:-1]), np.flatnonzero(valid & ~same[1:])


def valid_windows(offsets: np.ndarray, width: int, n: int) -> np.ndarray:
    """Which of the first n window starts lie whole in one text."""
    step = np.zeros(n + 1, np.int64)
    stop = np.maximum(offsets[1:] - width + 1, offsets[:-1])
    own = stop > offsets[:-1]
    np.add.at(step, offsets[:-1][own], 1)
    np.add.at(step, stop[own], -1)
    return np.cumsum(step[:-1]) > 0


def _longs(*arrays) -> list[pa.Array]:
    return [pa.array(np.ascontiguousarray(a).view(np.int64) if a.dtype == np.uint64 else a) for a in arrays]


_SPAN_NAMES = ["rank", "name", "key", "mark", "span", "state", "left", "right"]


def _settled_here(rank, name, key, ordered: bool) -> np.ndarray:
    """State of each span from those found beside it, so that a frequent one is sent once per step.

    ordered: spans of a larger key than an equal one's are done. Else, of equal
    spans all are done but one, which is sent as known to repeat.
    """
    state = np.zeros(len(rank), np.int64)
    order = np.lexsort((key, name, rank))
    same = (rank[order][1:] == rank[order][:-1]) & (name[order][1:] == name[order][:-1])
    head = np.r_[True, ~same]
    first = order[np.maximum.accumulate(np.where(head, np.arange(len(order)), 0))]
    if ordered:
        state[order[key[order] > key[first]]] = DONE
    else:
        state[order[1:][same]] = DONE
        state[first[1:][same]] = HEAD
    return state


def _emit_spans(scan: Callable, ordered: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, limit=STEP_BYTES):
            column = part.column("text")
            rank, name, doc, low, high, at, left, right = scan(bytes_of(column), offsets_of(column))
            if not len(rank):
                continue
            key, mark = part.column("key").to_numpy()[doc], part.column("mark").to_numpy()[doc]
            span = (low << 8) | (high - low)
            state = _settled_here(rank, name, key, ordered)
            # What is done only passes through, anywhere.
            done = state == DONE
            rank = np.where(done, mix(mark.view(np.uint64) ^ span.view(np.uint64)), rank)
            name = np.where(done, np.uint64(0), name)
            state |= at << 8
            for a in range(0, len(rank), 50_000):
                s = slice(a, a + 50_000)
                yield pa.RecordBatch.from_arrays(
                    _longs(rank[s], name[s], key[s], mark[s], span[s], state[s], left[s], right[s]), names=_SPAN_NAMES
                )

    return run


def _settle(ordered: bool):
    """Rows sorted by rank, name (and key): settled spans, and those to look at.

    ordered: a span repeats if an equal one stands in a document of smaller key;
    else if any equal one exists. Only one name's rows of one document are ever
    held back, so a rank of any number of rows streams through.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        carry = None  # the rows of the last name, while it has one row only (not ordered)
        at = None  # rank, name, its first key, number of names of that rank so far
        held: list[np.ndarray] = []  # open rows of the only name of a rank so far

        def out(kind, rows):
            if len(rows):
                yield pa.RecordBatch.from_arrays(
                    [pa.array(kind.astype(np.int8))] + _longs(*(rows[:, i] for i in (0, 2, 3, 4, 6, 7)), rows[:, 5] >> 8),
                    names=["kind", "rank", "key", "mark", "span", "left", "right", "at"],
                )

        def step(rows: np.ndarray, final: bool):
            nonlocal carry, at, held
            if carry is not None:
                rows = np.concatenate([carry, rows])
                carry = None
            if not len(rows):
                return
            n = len(rows)
            rank, name, key = rows[:, 0], rows[:, 1], rows[:, 2]
            new_rank = np.r_[at is None or rank[0] != at[0], rank[1:] != rank[:-1]]
            new_name = new_rank | np.r_[at is None or name[0] != at[1], name[1:] != name[:-1]]
            if not ordered and not final and new_name[-1]:
                carry, rows = rows[-1:].copy(), rows[:-1]
                n -= 1
                rank, name, key, new_rank, new_name = rank[:n], name[:n], key[:n], new_rank[:n], new_name[:n]
                if not n:
                    return
            heads = np.flatnonzero(new_name)
            if ordered:
                first = np.where(np.cumsum(new_name) > 0, key[np.maximum.accumulate(np.where(new_name, np.arange(n), 0))], 0)
                if at is not None and not new_name[0]:
                    first[: heads[0] if len(heads) else n] = at[2]
                repeats = key > first
                looked = ~repeats
            else:
                size = np.diff(np.r_[heads, n])
                repeats = np.ones(n, bool)
                repeats[heads[(size == 1) & (rows[heads, 5] & 255 != HEAD)]] = False
                looked = new_name
                first = key
            # Names of the rank up to each row, those of earlier batches included.
            names = np.cumsum(new_name)
            base = np.where(new_rank, names - 1, -1)
            base = np.maximum.accumulate(base)
            seen = np.where(base >= 0, names - base, names + (at[3] if at is not None else 0))
            ends = np.r_[np.flatnonzero(new_rank)[0 if not new_rank[0] else 1 :] - 1, n - 1] if new_rank.any() else np.array([n - 1])
            group = np.cumsum(new_rank) - (1 if new_rank[0] else 0)
            total = seen[ends][group]
            kind = np.where(repeats, PARTNER, OPEN) if not ordered else np.full(n, OPEN)
            # What was held back belongs to the rank that goes on here, or to none.
            if held:
                if not new_rank[0] and total[0] > 1:
                    old = np.concatenate(held)
                    yield from out(old[:, -1], old[:, :-1])
                    held = []
                elif new_rank[0] or new_rank.any():
                    held = []
            many = looked & (total > 1)
            yield from out(np.full(int(repeats.sum()), SETTLED), rows[repeats])
            yield from out(kind[many], rows[many])
            if total[-1] == 1:
                own = looked & (group == group[-1])
                held.append(np.column_stack([rows[own], kind[own]]))
            at = (rank[-1], name[-1], first[-1], seen[-1])

        empty = True
        for batch in batches:
            if batch.num_rows:
                empty = False
                rows = np.column_stack([batch.column(c).to_numpy() for c in _SPAN_NAMES])
                done = rows[:, 5] & 255 == DONE
                yield from out(np.full(int(done.sum()), SETTLED), rows[done])
                yield from step(rows[~done], False)
        if not empty or carry is not None:
            rest, carry = carry, None
            if rest is not None:
                yield from step(rest, True)

    return run


def _windows(names: Callable):
    """Open spans of a document, with its text, to a row per window."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, limit=STEP_BYTES // 4):
            column = part.column("text")
            lists = part.column("spans")
            inside = lists.flatten()
            span = inside.field("span").to_numpy()
            doc = np.repeat(np.arange(part.num_rows), np.diff(offsets_of_list(lists)))
            count = (span & 255) + 1
            each = np.repeat(np.arange(len(span)), count)
            start = (span >> 8)[each] + np.arange(len(each)) - np.repeat(np.cumsum(count) - count, count)
            doc = doc[each]
            first, second = names(bytes_of(column), offsets_of(column), doc, start)
            # The rank goes into the first name: 128 bits tell windows apart.
            first = mix(first ^ inside.field("rank").to_numpy()[each].view(np.uint64))
            span = (start << 8) | (inside.field("kind").to_numpy()[each] == OPEN)
            key, mark = part.column("key").to_numpy()[doc], part.column("mark").to_numpy()[doc]
            for a in range(0, len(start), 50_000):
                s = slice(a, a + 50_000)
                yield pa.RecordBatch.from_arrays(
                    _longs(first[s], second[s], key[s], mark[s], span[s]),
                    names=["first", "second", "key", "mark", "span"],
                )

    return run


def offsets_of_list(lists: pa.ListArray) -> np.ndarray:
    raw = np.frombuffer(lists.buffers()[1], np.int32)[lists.offset : lists.offset + len(lists) + 1]
    return raw.astype(np.int64) - int(raw[0])


def _confirm(ordered: bool):
    """Windows sorted by both names (and key): the open ones that repeat."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = None  # first, second, key of the first row of the window seen last
        wait = None  # its first row, while it is the only one (not ordered)

        def out(rows):
            if len(rows):
                yield pa.RecordBatch.from_arrays(
                    _longs(rows[:, 2], rows[:, 3], rows[:, 4] >> 8 << 8), names=["key", "mark", "span"]
                )

        for batch in batches:
            if not batch.num_rows:
                continue
            rows = np.column_stack([batch.column(c).to_numpy() for c in ("first", "second", "key", "mark", "span")])
            new = np.ones(len(rows), bool)
            new[1:] = (rows[1:, :2] != rows[:-1, :2]).any(axis=1)
            if last is not None:
                new[0] = tuple(rows[0, :2]) != last[:2]
            heads = np.flatnonzero(new)
            own = rows[:, 4] & 1 == 1
            if ordered:
                first = rows[np.maximum.accumulate(np.where(new, np.arange(len(rows)), 0)), 2]
                if not new[0]:
                    first[: heads[0] if len(heads) else len(rows)] = last[2]
                yield from out(rows[own & (rows[:, 2] > first)])
                last = (*rows[-1, :2], first[-1])
            else:
                repeats = np.ones(len(rows), bool)
                size = np.diff(np.r_[heads, len(rows)])
                repeats[heads[size == 1]] = False
                if wait is not None:
                    if not new[0]:
                        yield from out(wait)
                    wait = None
                yield from out(rows[own & repeats])
                if len(heads) and size[-1] == 1 and own[-1]:
                    wait = rows[-1:].copy()
                last = (*rows[-1, :2], 0)

    return run


def _trimmed(looked: DataFrame, reach: tuple[int, int]) -> DataFrame:
    """Spans without the windows that cannot repeat.

    A window that begins ``reach[0]`` or more symbols before the anchor holds
    the span's left part, one that begins ``reach[1]`` or fewer before it the
    right part. A part that no other span of the rank has ends those windows.
    """
    for side in ("left", "right"):
        count = looked.groupBy("rank", side).agg((F.count("*") == 1).alias(f"{side}_alone"))
        looked = looked.join(count, ["rank", side])
    low = F.shiftright("span", 8)
    high, anchor = low + F.col("span").bitwiseAND(255), low + F.col("at")
    low_left = F.when(F.col("left_alone"), F.greatest(low, anchor - reach[0] + 1)).otherwise(low)
    high_left = F.when(F.col("right_alone"), F.least(high, anchor - reach[1] - 1)).otherwise(high)
    kept = looked.withColumns({"low_left": low_left, "high_left": high_left}).where("low_left <= high_left")
    return kept.withColumn("span", F.shiftleft("low_left", 8) + F.col("high_left") - F.col("low_left"))


def repeated_spans(
    docs: DataFrame, scan: Callable, names: Callable, reach: tuple[int, int], ordered: bool, label: str
) -> DataFrame:
    """(key, mark, spans): for each document, the windows that repeat.

    ``docs`` is what ``documents`` gives. ``scan`` turns bytes and offsets of
    some texts into spans: rank, name, text, first and last window, how far the
    anchor lies behind the first window, and names of the left and right part
    that ``reach`` speaks of. ``names`` gives two names of each listed window,
    that together stand for all its symbols.
    """
    parts = tasks(docs)
    order = ["rank", "name"] + ["key"] * ordered
    found = staged(
        docs.mapInArrow(_emit_spans(scan, ordered), _SPAN_DDL)
        .repartition(parts, "rank")
        .sortWithinPartitions(*order)
        .mapInArrow(_settle(ordered), _FOUND_DDL),
        label + "-spans",
    )
    looked = found.where(F.col("kind") != SETTLED)
    if not ordered:  # partners matter only to open spans of their rank
        looked = looked.join(found.where(F.col("kind") == OPEN).select("rank").distinct(), "rank", "left_semi")
    looked = (
        _trimmed(looked, reach).groupBy("key", "mark")
        .agg(F.collect_list(F.struct("rank", "span", "kind")).alias("spans"))
    )
    order = ["first", "second"] + ["key"] * ordered
    more = staged(
        docs.join(looked, ["key", "mark"])
        .select("key", "mark", "text", "spans")
        .mapInArrow(_windows(names), _WINDOW_DDL)
        .repartition(parts, "first")
        .sortWithinPartitions(*order)
        .mapInArrow(_confirm(ordered), "key long, mark long, span long"),
        label + "-windows",
    )
    return (
        found.where(F.col("kind") == SETTLED)
        .select("key", "mark", "span")
        .unionByName(more)
        .groupBy("key", "mark")
        .agg(F.collect_list("span").alias("spans"))
    )


def covered(spans, width: int, n: int) -> np.ndarray:
    """Which of n symbols a listed window covers."""
    step = np.zeros(n + 1, np.int64)
    if spans is not None and len(spans):
        low = spans >> 8
        np.add.at(step, low, 1)
        np.add.at(step, np.minimum(low + (spans & 255) + width, n), -1)
    return np.cumsum(step[:-1]) > 0
