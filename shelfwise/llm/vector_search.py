"""Exact top-k inner products by columnar branch and bound.

Vectors are kept in blocks in vertical layout: a slice for every few
dimensions, dimension by dimension, beside the norm that remains from each slice
on. A search adds up inner products slice by slice. What is still to come is at
most the product of the remaining norms, so a candidate that cannot reach a
query's k-th best score any more is dropped, and the survivors are moved
together before the next slice is read.

Rows that are queries and rows that are candidates are dealt to a grid of
cells; a cell holds a bounded number of both and returns k rows a query.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext, cloudpickle
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shelfwise.llm.batches import record, staged, tasks

cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: Vectors in a block, and dimensions in a slice.
BLOCK, SLICE = 2_048, 16
#: Vectors and queries in a cell, at most about.
CELL_VECTORS, CELL_QUERIES = 32_768, 16_384
#: Queries that look at a block together.
TOGETHER = 512
#: Share of (query, candidate) pairs alive below which single pairs are carried on.
SPARSE = 1 / 16
#: Sums of doubles below it are exact.
EXACT = 2.0**52

_BLOCKS = pa.schema(
    [("block", pa.int64()), ("query", pa.bool_()), ("n", pa.int32()), ("ids", pa.binary()), ("no_id", pa.binary()),
     ("rows", pa.binary()), ("kind", pa.string()), ("slices", pa.list_(pa.binary())), ("norms", pa.list_(pa.binary()))]
)
_BLOCKS_DDL = (
    "block long, query boolean, n int, ids binary, no_id binary, rows binary, kind string, "
    "slices array<binary>, norms array<binary>"
)
_FOUND = pa.schema(
    [("block", pa.int64()), ("row", pa.int32()), ("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.int64())]
)


def _whole(x: float, scale: int) -> int:
    """floor(scale * x), also where a double cannot hold it."""
    above, below = float(x).as_integer_ratio()
    return above * scale // below


def _row(block: int, query: bool, ids, no_id, rows, x: np.ndarray, scale: int) -> tuple:
    """One row of the layout. ``x``: dimensions times vectors, not yet scaled."""
    with np.errstate(over="ignore"):
        v = np.floor(x * scale)
    most = np.abs(v).max(initial=0)
    kind = "<i2" if most < 2**15 else "<i4" if most < 2**31 else "<f8" if most < EXACT else "raw"
    cuts = range(0, max(1, len(x)), SLICE)
    norms = []
    with np.errstate(over="ignore"):
        for a in cuts:
            norms.append(np.sqrt((v[a:] * v[a:]).sum(0)).astype("<f8").tobytes())
    stored = x.astype("<f8") if kind == "raw" else v.astype(kind)
    return (
        block, query, len(ids), ids.astype("<i8").tobytes(), no_id.tobytes(), rows.astype("<i4").tobytes(), kind,
        [np.ascontiguousarray(stored[a : a + SLICE]).tobytes() for a in cuts], norms,
    )


def _layout(scale: int):
    """(id, query, vector) to blocks; queries of a block again in a row of their own."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = TaskContext.get().partitionId() << 32
        for batch in batches:
            for start in range(0, batch.num_rows, BLOCK):
                part = batch.slice(start, BLOCK)
                vectors = part.column("vector")
                sizes = np.diff(vectors.offsets.to_numpy()).astype(np.int64)
                flat = vectors.flatten().to_numpy(zero_copy_only=False)
                x = np.zeros((sizes.max(initial=0), len(sizes)))
                at = np.repeat(np.arange(len(sizes)), sizes)
                x[np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes), at] = flat
                no_id = part.column("id").is_null().to_numpy(zero_copy_only=False)
                ids = part.column("id").fill_null(0).to_numpy()
                rows = np.arange(len(ids))
                out = [_row(block, False, ids, no_id, rows, x, scale)]
                (asks,) = np.nonzero(part.column("query").to_numpy(zero_copy_only=False))
                if len(asks):
                    out.append(_row(block, True, ids[asks], no_id[asks], rows[asks], x[:, asks], scale))
                yield record(_BLOCKS, *zip(*out))
                block += 1

    return run


class Side:
    """The vectors of a cell, vertical: ``v`` has a row per dimension; norms has one per slice."""

    def __init__(self, table: pa.Table, scale: int):
        rows = table.to_pylist()
        self.ids = np.concatenate([np.frombuffer(r["ids"], "<i8") for r in rows])
        self.no_id = np.concatenate([np.frombuffer(r["no_id"], bool) for r in rows])
        self.row = np.concatenate([np.frombuffer(r["rows"], "<i4") for r in rows])
        self.block = np.repeat(np.array([r["block"] for r in rows], np.int64), [r["n"] for r in rows])
        deep = max(len(r["slices"]) for r in rows)
        self.big = any(r["kind"] == "raw" for r in rows)
        self.v = np.zeros((deep * SLICE, len(self.ids)), object if self.big else float)
        self.norms = np.zeros((deep + 1, len(self.ids)))
        at = 0
        for r in rows:
            n = r["n"]
            for s, (data, norm) in enumerate(zip(r["slices"], r["norms"])):
                x = np.frombuffer(data, "<f8" if r["kind"] == "raw" else r["kind"]).reshape(-1, n)
                if self.big:
                    scaled = scale if r["kind"] == "raw" else 1
                    x = np.array([[_whole(c, scaled) for c in line] for line in x.tolist()], object).reshape(-1, n)
                self.v[s * SLICE : s * SLICE + len(x), at : at + n] = x
                self.norms[s, at : at + n] = np.frombuffer(norm, "<f8")
            at += n

    def take(self, places) -> Side:
        part = object.__new__(Side)
        part.ids, part.no_id, part.row, part.block = self.ids[places], self.no_id[places], self.row[places], self.block[places]
        part.v, part.norms, part.big = self.v[:, places], self.norms[:, places], self.big
        return part


class Best:
    """The k best candidates of each query so far."""

    def __init__(self, queries: Side, k: int):
        self.k, n = k, len(queries.ids)
        self.query, self.place, self.score = (np.zeros(0, np.int64) for _ in range(3))
        self.worst = np.full(n, -np.inf)

    def add(self, query, place, score, vectors: Side) -> None:
        query, place = np.r_[self.query, query], np.r_[self.place, place]
        score = np.r_[self.score, score]
        # ~s falls as s rises, without overflow.
        order = np.lexsort((vectors.ids[place], vectors.no_id[place], ~score, query))
        query, place, score = query[order], place[order], score[order]
        first = np.searchsorted(query, query)
        nth = np.arange(len(query)) - first
        keep = nth < self.k
        self.query, self.place, self.score = query[keep], place[keep], score[keep]
        full = nth == self.k - 1
        self.worst[query[full]] = score[full].astype(float)


def _survivors(q: Side, c: Side, at: np.ndarray, worst: np.ndarray, k: int):
    """(query, candidate, score) of the pairs that may belong to the k best. ``at``: places of the candidates of the block."""
    deep = min(len(q.norms), len(c.norms)) - 1
    alive, pairs = at, None
    partial = np.zeros((len(q.ids), len(at)))
    for s in range(deep):
        dims = slice(s * SLICE, (s + 1) * SLICE)
        if pairs is None:
            partial = partial + q.v[dims].T @ c.v[dims][:, alive]
        else:
            i, j, sums = pairs
            pairs = i, j, sums + np.einsum("dp,dp->p", q.v[dims][:, i], c.v[dims][:, j])
        if s + 1 == deep:
            break
        ahead_q, ahead_c = q.norms[s + 1], c.norms[s + 1]
        if pairs is None:
            rest = ahead_q[:, None] * ahead_c[alive]
            keep = partial + rest + 1e-9 * (np.abs(partial) + rest) >= worst[:, None]
            columns = keep.any(0)
            # Compact the block to the candidates that some query still wants.
            alive, partial, keep = alive[columns], partial[:, columns], keep[:, columns]
            if keep.size and keep.mean() < SPARSE:
                i, j = np.nonzero(keep)
                pairs = i, alive[j], partial[i, j]
        else:
            i, j, sums = pairs
            rest = ahead_q[i] * ahead_c[j]
            keep = sums + rest + 1e-9 * (np.abs(sums) + rest) >= worst[i]
            pairs = i[keep], j[keep], sums[keep]
    if pairs is not None:
        i, j, sums = pairs
        keep = sums >= worst[i]
        return i[keep], j[keep], sums[keep].astype(np.int64)
    if partial.shape[1] > k:
        worst = np.maximum(worst, np.partition(partial, -k, axis=1)[:, -k])
    i, j = np.nonzero(partial >= worst[:, None])
    return i, alive[j], partial[i, j].astype(np.int64)


def _all_pairs(q: Side, c: Side, at: np.ndarray, k: int):
    """The same for integers beyond doubles: nothing is dropped but what k others of the block surpass."""
    deep = min(len(q.v), len(c.v))
    whole = lambda v: np.array([[int(x) for x in line] for line in v], object)
    score = whole(q.v[:deep].T).reshape(-1, deep) @ whole(c.v[:deep][:, at]).reshape(deep, -1)
    score = np.clip(score, -(2**63), 2**63 - 1).astype(np.int64)
    worst = np.sort(score, axis=1)[:, -min(k, len(at))]
    i, j = np.nonzero(score >= worst[:, None])
    return i, at[j], score[i, j]


def _search(k: int, scale: int):
    def run(vectors: pa.Table, queries: pa.Table) -> pa.Table:
        if not vectors.num_rows or not queries.num_rows:
            return _FOUND.empty_table()
        c, every = Side(vectors, scale), Side(queries, scale)
        # Long vectors first: they give high k-th scores early.
        order = np.argsort(-c.norms[0], kind="stable")
        if every.big or c.big:
            most = np.inf
        else:
            most = max(np.abs(every.v).max(initial=0) * np.abs(c.v).max(initial=0), 1) * len(c.v)
        out = []
        for first in range(0, len(every.ids), TOGETHER):
            q = every.take(slice(first, first + TOGETHER))
            best = Best(q, k)
            for start in range(0, len(order), BLOCK):
                at = order[start : start + BLOCK]
                if most < EXACT:
                    # One more than k, as a query finds itself.
                    i, j, score = _survivors(q, c, at, best.worst, k + 1)
                else:
                    i, j, score = _all_pairs(q, c, at, k + 1)
                other = (q.block[i] != c.block[j]) | (q.row[i] != c.row[j])
                best.add(i[other], j[other], score[other], c)
            i, j = best.query, best.place
            out.append(pa.table(
                [pa.array(q.block[i]), pa.array(q.row[i]), pa.array(q.ids[i], mask=q.no_id[i]),
                 pa.array(c.ids[j], mask=c.no_id[j]), pa.array(best.score)],
                schema=_FOUND,
            ))
        return pa.concat_tables(out)

    return run


def top_k(
    df: DataFrame, queries: Column, k: int = 5, scale: int = 256, id_col: str = "vec_id", vector_col: str = "embedding"
) -> DataFrame:
    """query_id, rank, vec_id, score: for each row where ``queries`` holds, its k best among all other rows.

    A component x counts as floor(scale * x), x as double; the score is the
    inner product of these integers, ties go to the smaller id. Vectors that are
    null or hold a null, NaN or infinite component take no part. Of two vectors
    of unequal length, the shorter is filled with zeros. Rows are candidates of
    each other whatever their ids, so repeated rows each have a list and stand
    in the other's; a null id comes last among ties. With fewer than k other
    rows there are fewer ranks, an empty table gives no rows. Scores beyond 64
    bits count as the nearest long.
    """
    vector = df[vector_col].cast("array<double>")
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    rows = df.where(vector.isNotNull() & finite).select(
        df[id_col].cast("long").alias("id"), F.coalesce(queries, F.lit(False)).alias("query"), vector.alias("vector")
    )
    blocks = staged(rows.mapInArrow(_layout(scale), _BLOCKS_DDL), "blocks")
    sizes = {r["query"]: r["n"] for r in blocks.groupBy("query").agg(F.sum("n").alias("n")).collect()}
    n, asked = sizes.get(False, 0), sizes.get(True, 0)
    parts = max(1, min(-(-n // BLOCK), max(-(-n // CELL_VECTORS), tasks(df))))
    groups = max(1, -(-asked // CELL_QUERIES))
    spread = lambda m: F.explode(F.sequence(F.lit(0), F.lit(m - 1)))
    # Both sides of the grid go where they meet; a cell is bounded, so is what it returns.
    vectors = blocks.where("NOT query").withColumns(
        {"part": F.pmod(F.xxhash64("block"), F.lit(parts)).cast("int"), "group": spread(groups)}
    )
    asks = blocks.where("query").withColumn("group", F.pmod(F.xxhash64("block"), F.lit(groups)).cast("int"))
    found = (
        vectors.groupBy("part", "group")
        .cogroup(asks.withColumn("part", spread(parts)).groupBy("part", "group"))
        .applyInArrow(_search(k, scale), "block long, row int, query_id long, vec_id long, score long")
    )
    best = Window.partitionBy("block", "row").orderBy(F.desc("score"), F.asc_nulls_last("vec_id"))
    return (
        found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
        .select("query_id", "rank", "vec_id", "score")
    )
