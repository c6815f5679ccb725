"""How far the sources of a language differ in their words, by bitmaps of count levels.

Terms of a language are dealt to chunks and numbered there. For each source and
each number of occurrences, a bitmap holds the terms that occur so often in it.
How far two sources differ in a term depends on their two counts only, so a pair
needs no walk over terms: AND and popcount of two levels give how many terms
have those counts, multiplied by what such a term adds. Terms that a source does
not have are in no bitmap; their number is what is left over of the other levels.
As in other compressed bitmaps, a level of few terms is kept as a list of its bits.
"""

from __future__ import annotations

import sys
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shelfwise.llm.batches import record, slices, staged
from shelfwise.llm.terms import LETTERS, raw, terms

cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: Terms of a chunk, on average.
CHUNK_TERMS = 16_384
#: Terms in a level from which it is a bitmap.
DENSE = 24
#: Sources that are compared with as many others in one place.
SOURCES = 32
#: Counted entries that a task holds before it hands them on.
HELD = 400_000
#: Rates are parts of so many.
UNIT = 1_000_000_000

_COUNTED = pa.schema(
    [("lang", pa.string()), ("source", pa.string()), ("term", pa.binary()), ("n", pa.int64()), ("docs", pa.int64())]
)
_LEVELS = pa.schema(
    [("lang", pa.string()), ("chunk", pa.int64()), ("source", pa.string()),
     ("dense", pa.list_(pa.int64())), ("bitmaps", pa.list_(pa.binary())), ("sizes", pa.list_(pa.int32())),
     ("counts", pa.list_(pa.int64())), ("bits", pa.list_(pa.int32()))]
)
_LEVELS_DDL = (
    "lang string, chunk long, source string, dense array<long>, bitmaps array<binary>, sizes array<int>, "
    "counts array<long>, bits array<int>"
)
_SUMS = pa.schema([("lang", pa.string()), ("source", pa.string()), ("item", pa.string()), ("value", pa.int64())])


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Occurrences and documents by language, source and term, added up while they fit; a row without term for each group."""
    held: dict[tuple, tuple[Counter, Counter]] = {}

    def rows():
        for (lang, source), (often, docs) in held.items():
            names = [None, *often]
            yield record(
                _COUNTED, [lang] * len(names), [source] * len(names), names,
                [0, *often.values()], [0, *(docs[t] for t in often)],
            )
        held.clear()

    for part in slices(batches):
        for lang, source, data in zip(part.column("lang").to_pylist(), part.column("source").to_pylist(), raw(part.column("text"))):
            often, docs = held.setdefault((lang, source), (Counter(), Counter()))
            own: set = set()
            for words in terms(data, LETTERS):
                often.update(words)
                own.update(words)
            docs.update(own)
        if sum(len(often) for often, _ in held.values()) > HELD:
            yield from rows()
    yield from rows()


def _levels(key: tuple, table: pa.Table) -> pa.Table:
    """The levels of one source in one chunk."""
    n, bit = table.column("n").to_numpy(), table.column("bit").to_numpy()
    order = np.argsort(n, kind="stable")
    n, bit = n[order], bit[order]
    starts = np.flatnonzero(np.r_[True, n[1:] != n[:-1]])
    ends = np.r_[starts[1:], len(n)]
    dense, bitmaps, sizes, rest = [], [], [], np.ones(len(n), bool)
    for a, b in zip(starts.tolist(), ends.tolist()):
        if b - a >= DENSE:
            marks = np.zeros(int(bit[a:b].max()) // 8 * 8 + 8, bool)
            marks[bit[a:b]] = True
            dense.append(int(n[a]))
            bitmaps.append(np.packbits(marks, bitorder="little").tobytes())
            sizes.append(b - a)
            rest[a:b] = False
    lang, chunk, source = (k.as_py() for k in key)
    return pa.table(
        [[lang], [chunk], [source], [dense], [bitmaps], [sizes], [n[rest].tolist()], [bit[rest].tolist()]], schema=_LEVELS
    )


def rates(counts: np.ndarray, total: int, width: int) -> np.ndarray:
    """1 + floor(UNIT (count + 2) / (total + 2 width)), exact."""
    if counts.max(initial=0) < 2**32:
        return 1 + UNIT * (counts + 2) // (total + 2 * width)
    return (1 + UNIT * (counts.astype(object) + 2) // (total + 2 * width)).astype(np.int64)


def difference(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    return (p - q) * (p - q) // (p + q)


class Levels:
    """One source in one chunk of ``size`` terms."""

    def __init__(self, row: dict, size: int):
        words = -(-size // 64)
        self.source, self.total, self.width = row["source"], row["total"], row["width"]
        self.dense = np.array(row["dense"] or [], np.int64)
        self.sizes = np.array(row["sizes"] or [], np.int64)
        self.bits, self.counts = np.array(row["bits"] or [], np.int64), np.array(row["counts"] or [], np.int64)
        whole = bytearray(8 * words * len(self.dense))
        #: The level of each term, from 1; 0 for terms that are in no bitmap, -1 for those of the lists.
        self.level = np.zeros(64 * words, np.int32)
        for i, data in enumerate(row["bitmaps"] or []):
            whole[8 * words * i : 8 * words * i + len(data)] = data
            marks = np.unpackbits(np.frombuffer(data, np.uint8), bitorder="little").view(bool)
            self.level[: len(marks)][marks] = i + 1
        self.level[self.bits] = -1
        self.bitmaps = np.frombuffer(bytes(whole), np.uint64).reshape(len(self.dense), words)
        self.often = np.zeros(64 * words, np.int64)
        self.often[self.bits] = self.counts
        self.rates = rates(np.r_[0, self.dense], self.total, self.width)

    def rate(self, bits: np.ndarray) -> np.ndarray:
        level = self.level[bits]
        return np.where(level < 0, rates(self.often[bits], self.total, self.width), self.rates[np.maximum(level, 0)])


def pair_value(a: Levels, b: Levels, size: int) -> int:
    """The sum over all ``size`` terms of the chunk."""
    # Terms of few-term levels, of either side, are looked up one by one.
    single = np.union1d(a.bits, b.bits)
    value = int(difference(a.rate(single), b.rate(single)).sum())
    # Joint cells of the others; row and column 0 are the terms that a side does not have.
    cells = np.zeros((len(a.dense) + 1, len(b.dense) + 1), np.int64)
    for i, bitmap in enumerate(a.bitmaps):
        cells[i + 1, 1:] = np.bitwise_count(bitmap & b.bitmaps).sum(1)
    apart_a = np.bincount(a.level[b.bits][a.level[b.bits] > 0], minlength=len(a.dense) + 1)[1:]
    apart_b = np.bincount(b.level[a.bits][b.level[a.bits] > 0], minlength=len(b.dense) + 1)[1:]
    cells[1:, 0] = a.sizes - cells[1:, 1:].sum(1) - apart_a
    cells[0, 1:] = b.sizes - cells[1:, 1:].sum(0) - apart_b
    cells[0, 0] = size - len(single) - cells.sum()
    return value + int((cells * difference(a.rates[:, None], b.rates[None, :])).sum())


def _pairs(key: tuple, table: pa.Table) -> pa.Table:
    """All pairs of two blocks of sources in one chunk, or within one block."""
    lang, _, left, right = (k.as_py() for k in key)
    rows = table.to_pylist()
    size = rows[0]["size"] or 0
    ours = [Levels(r, size) for r in rows if r["own"] == left]
    others = ours if left == right else [Levels(r, size) for r in rows if r["own"] == right]
    out = []
    for i, a in enumerate(ours):
        for b in others[i + 1 :] if left == right else others:
            value = pair_value(a, b, size)
            out += [(lang, a.source, b.source, value), (lang, b.source, a.source, value)]
    return pa.Table.from_batches([record(_SUMS, *zip(*out))]) if out else _SUMS.empty_table()


def _rate(count: Column, total: Column, width: Column) -> Column:
    """The same as ``rates``, in columns."""
    wide = lambda c: c.cast("decimal(19,0)")
    return F.lit(1) + F.call_function("div", F.lit(UNIT).cast("decimal(10,0)") * wide(count + 2), wide(total + 2 * width))


def source_divergence(
    df: DataFrame, least: int = 10, top: int = 10, text_col: str = "text", lang_col: str = "lang", source_col: str = "source"
) -> DataFrame:
    """lang, source, part, item, value, rank.

    Terms are runs of letters and characters beyond ASCII, A-Z lower-cased. A
    language keeps the V terms in at least ``least`` of its documents. With N
    occurrences of these in a source, or in the language, a term of ``count``
    has the rate ``p = 1 + floor(10^9 (count + 2) / (N + 2 V))``; two rates
    differ by ``floor((p - q)^2 / (p + q))``.

    ``part`` is ``pair``: for each other source of the language, the sum over
    its kept terms, all ranks; or ``term``: the ``top`` kept terms that the
    source has at a higher rate than its language, with their difference. Ranks
    go by falling value, then by item in UTF-8.

    Null text, language and source are ''. Rows count each, repeated ones too; a
    source without terms has all counts 0, a language without kept terms has all
    values 0. An empty table gives no rows; further columns are ignored. Texts
    are read whole, and all sums are of integers.
    """
    empty = lambda c: F.coalesce(df[c].cast("string"), F.lit(""))
    rows = df.select(empty(lang_col).alias("lang"), empty(source_col).alias("source"), empty(text_col).alias("text"))
    counted = staged(
        rows.mapInArrow(_count, "lang string, source string, term binary, n long, docs long")
        .groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs")),
        "counted",
    )
    named = counted.where("term IS NOT NULL")
    kept = named.groupBy("lang", "term").agg(F.sum("docs").alias("docs"), F.sum("n").alias("whole")).where(F.col("docs") >= least)
    kept = staged(kept.drop("docs"), "kept")
    langs = kept.groupBy("lang").agg(F.count("*").alias("width"), F.sum("whole").alias("lang_total"))
    langs = langs.withColumn("chunks", F.ceil(F.col("width") / CHUNK_TERMS))
    # A chunk has about CHUNK_TERMS terms, so numbering them takes a small window.
    place = Window.partitionBy("lang", "chunk").orderBy("term")
    numbered = kept.join(langs, "lang").withColumn("chunk", F.pmod(F.xxhash64("term"), "chunks"))
    numbered = numbered.select("lang", "term", "whole", "chunk", (F.row_number().over(place) - 1).alias("bit"))
    numbered = staged(numbered, "terms")
    own = staged(named.drop("docs").join(numbered, ["lang", "term"]), "own")

    totals = own.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    sources = (
        counted.where("term IS NULL").select("lang", "source")
        .join(totals, ["lang", "source"], "left").join(langs, "lang", "left")
        .select("lang", "source", F.coalesce("total", F.lit(0)).alias("total"), F.coalesce("width", F.lit(0)).alias("width"), "chunks", "lang_total")
    )
    blocks = sources.groupBy("lang").agg(F.ceil(F.count("*") / SOURCES).alias("blocks"))
    # One row per source: what all that follows is joined with.
    sources = staged(sources.join(blocks, "lang").withColumn("own", F.pmod(F.xxhash64("source"), "blocks")), "sources")

    levels = own.select("lang", "chunk", "source", "n", "bit").groupBy("lang", "chunk", "source").applyInArrow(_levels, _LEVELS_DDL)
    sizes = numbered.groupBy("lang", "chunk").agg(F.count("*").alias("size"))
    cells = (
        sources.where("width > 0").withColumn("chunk", F.explode(F.expr("sequence(0, chunks - 1)")))
        .join(sizes, ["lang", "chunk"]).join(levels, ["lang", "chunk", "source"], "left")
        .withColumn("other", F.explode(F.expr("sequence(0, blocks - 1)")))
        .select("*", F.least("own", "other").alias("left"), F.greatest("own", "other").alias("right"))
        .drop("lang_total", "chunks", "blocks", "other")
    )
    sums = (
        cells.groupBy("lang", "chunk", "left", "right").applyInArrow(_pairs, "lang string, source string, item string, value long")
        .groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))
    )
    names = sources.select("lang", "source")
    pairs = (
        names.join(names.withColumnRenamed("source", "item"), "lang").where("source <> item")
        .join(sums, ["lang", "source", "item"], "left")
        .select("lang", "source", F.lit("pair").alias("part"), "item", F.coalesce("value", F.lit(0)).alias("value"))
    )
    p, q = _rate(F.col("n"), F.col("total"), F.col("width")), _rate(F.col("whole"), F.col("lang_total"), F.col("width"))
    words = (
        own.join(sources, ["lang", "source"]).select("lang", "source", "term", p.alias("p"), q.alias("q")).where("p > q")
        .select("lang", "source", F.lit("term").alias("part"), F.col("term").cast("string").alias("item"),
                F.expr("(p - q) * (p - q) div (p + q)").alias("value"))
    )
    order = Window.partitionBy("lang", "source", "part").orderBy(F.desc("value"), "item")
    rank = F.row_number().over(order)
    return pairs.withColumn("rank", rank).unionByName(words.withColumn("rank", rank).where(F.col("rank") <= top))
