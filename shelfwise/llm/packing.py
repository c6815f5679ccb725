"""Best-fit packing of token sequences, after a Martello-Toth reduction.

Only the length of a piece matters to a packing, and there are at most
``capacity`` lengths. So the instance is a histogram of lengths, whatever the
number of documents: it is reduced and packed as whole batches of equal
sequences, and the result is a short list of patterns (how often, which lengths
in which order). Pieces find their place by their rank among pieces of the same
length, without ever meeting in one task.
"""

from __future__ import annotations

import sys
import zlib
from bisect import bisect_left, bisect_right, insort
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from shelfwise.llm.batches import record, slices, staged, texts_of
from shelfwise.llm.pretokens import Encoder

cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: Pieces of one length that are numbered in one task.
RANKED_TOGETHER = 20_000
#: Encoded units that a worker keeps, some 40 MB: packing comes last in a pipeline whose other stages have filled the executor.
KEPT_UNITS = 300_000

_PIECES = pa.schema(
    [("doc_id", pa.int64()), ("row", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()),
     ("length", pa.int64()), ("ids_crc32", pa.int64())]
)
_PIECES_DDL = "doc_id long, row long, piece int, start long, length long, ids_crc32 long"

Pattern = tuple[int, tuple[tuple[int, int], ...]]  # how often; (length, times) in order of place


def cut_pieces(vocabulary: str, end_id: int, capacity: int):
    """Function for mapInArrow: (key, text) to the pieces of each document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder.of_process(vocabulary, KEPT_UNITS)
        end, step = end_id.to_bytes(4, "little"), 4 * capacity
        for part in slices(batches):
            rows = []
            keys, marks = part.column("key").to_pylist(), part.column("row").to_pylist()
            for key, row, ids in zip(keys, marks, encoder.ids(part.column("text").to_pylist())):
                ids += end
                for n, a in enumerate(range(0, len(ids), step)):
                    own = ids[a : a + step]
                    rows.append((key, row, n, a // 4, len(own) // 4, zlib.crc32(own)))
            yield record(_PIECES, *zip(*rows))

    return run


def reduce_instance(counts: dict[int, int], capacity: int) -> tuple[list[Pattern], dict[int, int]]:
    """Fixes sequences that dominate every other way to place their largest piece.

    For the largest piece j with rest r = capacity - j, from large to small:
    nothing fits: {j}. A piece of exactly r: {j, r}. At most one more piece
    fits: {j, k} with the largest k that fits. At most two more fit: {j, k} if
    k is at least the largest pair sum, or {j, k, b} if b, the largest beside
    k, is at least the smaller half of every pair that fits.
    Returns the fixed patterns and what remains.
    """
    left = {size: n for size, n in counts.items() if n > 0}
    sizes = sorted(left)
    fixed: list[Pattern] = []

    def take(times: int, *parts: int) -> None:
        need = defaultdict(int)
        for p in parts:
            need[p] += 1
        fixed.append((times, tuple(sorted(need.items(), reverse=True))))
        for p, n in need.items():
            left[p] -= n * times
            if not left[p]:
                del left[p]
                sizes.pop(bisect_left(sizes, p))

    def smallest(n: int) -> list[int]:
        """The n smallest pieces that remain beside the one under view."""
        out: list[int] = []
        for s in sizes:
            out += [s] * min(n - len(out), left[s] - (s == j))
            if len(out) >= n:
                break
        return out

    for j in sorted(sizes, reverse=True):
        while j in left:
            rest = capacity - j
            small = smallest(3)
            if not small or small[0] > rest:
                take(left[j] if not small or j > rest else 1, j)
                continue
            at = bisect_right(sizes, rest) - 1
            while at >= 0 and sizes[at] == j and left[j] < 2:
                at -= 1
            k = sizes[at]
            pairs = left[j] // 2 if k == j else min(left[j], left[k])
            if k == rest or len(small) < 2 or small[0] + small[1] > rest:
                take(pairs, j, k)
                continue
            if len(small) > 2 and sum(small) <= rest:
                break  # three more can fit: no rule applies
            beside = [s for s in sizes if s <= rest - small[0] and left[s] - (s == j) > 0]
            best_sum = second = 0
            for a in beside:
                at_b = bisect_right(beside, min(a, rest - a)) - 1
                if at_b >= 0 and beside[at_b] == a and left[a] - (a == j) < 2:
                    at_b -= 1
                if at_b >= 0:
                    best_sum, second = max(best_sum, a + beside[at_b]), max(second, beside[at_b])
            if k >= best_sum:
                take(1, j, k)
                continue
            fits = [s for s in sizes if s <= rest - k and left[s] - (s == j) - (s == k) > 0]
            if fits and fits[-1] >= second:
                take(1, j, k, fits[-1])
                continue
            break
    return fixed, left


def best_fit(counts: dict[int, int], capacity: int) -> list[Pattern]:
    """Best fit, largest first, over batches of sequences with the same content."""
    open_by_room: dict[int, list[list]] = defaultdict(list)  # room -> [times, content]
    rooms: list[int] = []

    def put(room: int, times: int, content: tuple) -> None:
        if times:
            if room not in open_by_room:
                insort(rooms, room)
            open_by_room[room].append([times, content])

    for size in sorted(counts, reverse=True):
        n = counts[size]
        while n:
            at = bisect_left(rooms, size)
            if at == len(rooms):
                each = capacity // size
                put(capacity - each * size, n // each, ((size, each),))
                put(capacity - n % each * size, min(1, n % each), ((size, n % each),))
                break
            room = rooms[at]
            times, content = open_by_room[room].pop()
            if not open_by_room[room]:
                del open_by_room[room]
                rooms.pop(at)
            each = room // size
            full = min(times, n // each)
            put(room - each * size, full, content + ((size, each),))
            n -= full * each
            times -= full
            if times and n:  # fewer pieces than one sequence takes
                put(room - n * size, 1, content + ((size, n),))
                times, n = times - 1, 0
            put(room, times, content)
    return [(t, c) for room in rooms for t, c in open_by_room[room]]


def pack_lengths(counts: dict[int, int], capacity: int) -> list[Pattern]:
    fixed, rest = reduce_instance(counts, capacity)
    return fixed + best_fit(rest, capacity)


def _places(patterns: list[Pattern]) -> tuple[np.ndarray, ...]:
    """For ranks of each length: first rank, pieces per sequence, first sequence, first offset."""
    taken: dict[int, int] = defaultdict(int)
    rows, base = [], 0
    for times, content in patterns:
        offset = 0
        for size, each in content:
            rows.append((size, taken[size], each, base, offset))
            taken[size] += times * each
            offset += size * each
        base += times
    table = np.array(sorted(rows), np.int64).reshape(-1, 5)
    return tuple(np.ascontiguousarray(table[:, i]) for i in range(5))


def _place(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        size, first, each, base, offset = shared.value
        start = np.searchsorted(size, np.arange(size.max() + 2 if len(size) else 1))
        for batch in batches:
            length = batch.column("length").to_numpy()
            rank = batch.column("rank").to_numpy()
            at = np.empty(len(length), np.int64)
            for s in np.unique(length):
                own = length == s
                at[own] = start[s] + np.searchsorted(first[start[s] : start[s + 1]], rank[own], side="right") - 1
            inside = rank - first[at]
            names = ("doc_id", "piece", "start", "length", "ids_crc32")
            yield pa.RecordBatch.from_arrays(
                [batch.column(n) for n in names]
                + [pa.array(base[at] + inside // each[at]), pa.array(offset[at] + inside % each[at] * length)],
                names=[*names, "sequence_id", "offset"],
            )

    return run


def pack(
    df: DataFrame,
    vocabulary: str,
    end_id: int = 1,
    capacity: int = 4096,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset: one row per piece.

    Null text counts as empty: a piece with the end id alone. Repeated rows are
    packed each for itself, a null id stays null, an empty table gives no rows,
    further columns are ignored. Documents above ``capacity`` ids, and only
    they, are cut.
    """
    pieces = staged(
        texts_of(df, id_col, text_col)
        .withColumn("row", F.monotonically_increasing_id())
        .mapInArrow(cut_pieces(vocabulary, end_id, capacity), _PIECES_DDL),
        "pieces",
    )
    spark = df.sparkSession
    # One row per length: at most ``capacity`` rows come to the driver.
    counts = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}
    shared = spark.sparkContext.broadcast(_places(pack_lengths(counts, capacity)))
    parts = 1 + max(counts.values(), default=0) // RANKED_TOGETHER
    dealt = pieces.withColumn("part", F.pmod(F.xxhash64("row", "piece"), F.lit(parts)))
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = (
        dealt.groupBy("length", "part")
        .agg(F.count("*").alias("n"))
        .select("length", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    )
    within = Window.partitionBy("length", "part").orderBy("row", "piece")
    ranked = (
        dealt.withColumn("at", F.row_number().over(within) - 1)
        .join(starts, ["length", "part"])
        .withColumn("rank", F.col("before") + F.col("at"))
    )
    return ranked.mapInArrow(
        _place(shared),
        "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long",
    )
