"""Token counts without ids: pieces per distinct pre-token times its frequency per document.

Documents go into chunks of some million pre-tokens. A chunk turns its texts
into one row per distinct pre-token that lists the documents holding it and how
often (an inverted list), so the shuffle by pre-token carries each string once
per chunk. Where the rows of a pre-token meet, its pieces are counted once and
multiplied into per-document sums; these go back to the chunk and are added up.
"""

from __future__ import annotations

import sys
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext, cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfwise.llm.batches import record, slices, tasks, texts_of
from shelfwise.llm.pretokens import STORE_UNITS, Encoder

cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: Pre-tokens after which a chunk is closed; a longer document is a chunk of its own.
CHUNK_UNITS = 3_000_000
#: Documents in a chunk at most, so that their place fits 16 bits.
CHUNK_DOCS = 60_000
#: Entries in one row of an inverted list, at most.
LIST_ENTRIES = 4_096
#: Rows of a frequent pre-token are dealt to so many places.
SALTS = 32

_LISTS = pa.schema(
    [("unit", pa.string()), ("salt", pa.int32()), ("chunk", pa.int64()),
     ("docs", pa.binary()), ("counts", pa.binary())]
)
_SUMS = pa.schema([("chunk", pa.int64()), ("head", pa.bool_()), ("docs", pa.binary()), ("sums", pa.binary())])
_OUT = pa.schema(
    [("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_tokens", pa.int64()), ("over_limit", pa.bool_())]
)


def _invert(chunk: int, keys: list, sizes: list, units: list[np.ndarray], names: list[str]):
    """Rows of one chunk: the head (unit null: ids and bytes) and the inverted lists."""
    lengths = np.fromiter(map(len, units), np.int64, len(units))
    flat = np.concatenate(units).astype(np.int64) * CHUNK_DOCS + np.repeat(np.arange(len(units)), lengths)
    pairs, counts = np.unique(flat, return_counts=True)
    unit, doc = pairs // CHUNK_DOCS, (pairs % CHUNK_DOCS).astype("<u2")
    doc_bytes, count_bytes = doc.tobytes(), counts.astype("<u4").tobytes()
    cuts = np.flatnonzero(np.r_[True, unit[1:] != unit[:-1]]) if len(unit) else np.zeros(0, np.int64)
    ends = np.r_[cuts[1:], len(unit)]
    rows: list[tuple] = [(None, chunk % SALTS, chunk, np.array(keys, "<i8").tobytes(), np.array(sizes, "<i8").tobytes())]
    for a, b, u in zip(cuts.tolist(), ends.tolist(), unit[cuts].tolist()):
        for x in range(a, b, LIST_ENTRIES):
            y = min(b, x + LIST_ENTRIES)
            salt = chunk % SALTS if b - a > 64 else 0
            rows.append((names[u], salt, chunk, doc_bytes[2 * x : 2 * y], count_bytes[4 * x : 4 * y]))
        if len(rows) >= 20_000:
            yield record(_LISTS, *zip(*rows))
            rows = []
    if rows:
        yield record(_LISTS, *zip(*rows))


def _chunks(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(path)
        number = TaskContext.get().partitionId() << 32
        keys, sizes, units, held = [], [], [], 0
        ids: dict[str, int] = defaultdict()
        ids.default_factory = ids.__len__
        for part in slices(batches):
            for key, text in zip(part.column("key").to_pylist(), part.column("text").to_pylist()):
                if held > CHUNK_UNITS or len(keys) == CHUNK_DOCS:
                    yield from _invert(number, keys, sizes, units, list(ids))
                    number, keys, sizes, units, held = number + 1, [], [], [], 0
                    ids.clear()
                found = encoder.units(text)
                units.append(np.fromiter(map(ids.__getitem__, found), np.int32, len(found)))
                # A null id is carried as the least long.
                keys.append(-(2**63) if key is None else key)
                sizes.append(len(text.encode()))
                held += len(found)
        if keys:
            yield from _invert(number, keys, sizes, units, list(ids))

    return run


def _weigh(path: str):
    """Rows sorted by chunk: pieces of each pre-token, once, times the listed frequencies."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(path)
        pieces: dict[str, int] = {}
        chunk, sums = None, np.zeros(CHUNK_DOCS, np.int64)

        def done():
            docs = np.flatnonzero(sums)
            return (chunk, False, docs.astype("<u2").tobytes(), sums[docs].astype("<i8").tobytes())

        for batch in batches:
            names = batch.column("unit").to_pylist()
            unknown = list(set(names).difference(pieces, (None,)))
            if len(pieces) + len(unknown) > STORE_UNITS:
                pieces.clear()
                unknown = list(set(names) - {None})
            pieces.update((u, len(encoder.encoded(u))) for u in unknown)
            chunks = batch.column("chunk").to_numpy()
            docs, counts = batch.column("docs"), batch.column("counts")
            weights = np.array([-1 if u is None else pieces[u] for u in names], np.int64)
            rows = []
            cuts = np.flatnonzero(np.r_[True, chunks[1:] != chunks[:-1]])
            for a, b in zip(cuts.tolist(), np.r_[cuts[1:], len(chunks)].tolist()):
                if chunks[a] != chunk:
                    if chunk is not None:
                        rows.append(done())
                        sums[:] = 0
                    chunk = int(chunks[a])
                heads = [i for i in range(a, b) if weights[i] < 0]
                rows += [(chunk, True, docs[i].as_py(), counts[i].as_py()) for i in heads]
                take = [i for i in range(a, b) if weights[i] >= 0]
                place = np.frombuffer(b"".join(docs.take(pa.array(take, pa.int64())).to_pylist()), "<u2")
                often = np.frombuffer(b"".join(counts.take(pa.array(take, pa.int64())).to_pylist()), "<u4")
                entries = np.fromiter((len(x) // 2 for x in docs.take(pa.array(take, pa.int64())).to_pylist()), np.int64, len(take))
                np.add.at(sums, place, often.astype(np.int64) * np.repeat(weights[take], entries))
            if rows:
                yield record(_SUMS, *zip(*rows))
        if chunk is not None:
            yield record(_SUMS, *zip(*[done()]))

    return run


def _gather(limit: int):
    def run(table: pa.Table) -> pa.Table:
        heads = table.column("head").to_pylist()
        docs, sums = table.column("docs").to_pylist(), table.column("sums").to_pylist()
        (at,) = [i for i, h in enumerate(heads) if h]
        keys, sizes = np.frombuffer(docs[at], "<i8"), np.frombuffer(sums[at], "<i8")
        total = np.zeros(len(keys), np.int64)
        for i, head in enumerate(heads):
            if not head:
                np.add.at(total, np.frombuffer(docs[i], "<u2"), np.frombuffer(sums[i], "<i8"))
        return pa.table(
            [pa.array(keys, mask=keys == -(2**63)), pa.array(sizes), pa.array(total), pa.array(total > limit)],
            schema=_OUT,
        )

    return run


def token_counts(
    df: DataFrame, vocabulary: str, limit: int = 2048, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit: one row per row of ``df``.

    ``vocabulary`` is a file the tokenizers library reads, at the same place on
    every executor. Null text counts as empty (0 tokens), repeated rows and
    equal ids stay apart, a null id stays null, an empty table gives no rows,
    further columns are ignored. Texts of any length are counted whole.
    """
    lists = texts_of(df, id_col, text_col).mapInArrow(
        _chunks(vocabulary), "unit string, salt int, chunk long, docs binary, counts binary"
    )
    sums = (
        lists.repartition(tasks(df), "unit", "salt")
        .sortWithinPartitions("chunk")
        .mapInArrow(_weigh(vocabulary), "chunk long, head boolean, docs binary, sums binary")
    )
    return sums.groupBy("chunk").applyInArrow(
        _gather(limit), "doc_id long, n_bytes long, n_tokens long, over_limit boolean"
    )
