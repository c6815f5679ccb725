"""Token-id files: ids of documents in ascending order of their id, in Simple-8b blocks.

A file is one Parquet part per range of ids; a row is a block of whole documents
of some hundred thousand ids, with their number, the packed words, the first
word of each sub-block, the escapes, and the ids and lengths of its documents.
A block is decoded without any other, so files are read in parallel.
"""

from __future__ import annotations

import sys
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext, cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfwise.llm.batches import record, slices, tasks, texts_of
from shelfwise.llm.pretokens import Encoder
from shelfwise.llm.simple8b import decode, encode
from shelfwise.session import scratch_path

cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: Ids after which a block is closed; a longer document is a block of its own.
BLOCK_IDS = 1 << 18

_BLOCK_DDL = (
    "shard int, block int, start long, n_ids long, words binary, firsts binary, places binary, "
    "escaped binary, doc_ids array<long>, lengths array<long>"
)
_BLOCK = pa.schema(
    [("shard", pa.int32()), ("block", pa.int32()), ("start", pa.int64()), ("n_ids", pa.int64()),
     ("words", pa.binary()), ("firsts", pa.binary()), ("places", pa.binary()), ("escaped", pa.binary()),
     ("doc_ids", pa.list_(pa.int64())), ("lengths", pa.list_(pa.int64()))]
)
_DOC = pa.schema(
    [("doc_id", pa.int64()), ("shard", pa.int32()), ("start", pa.int64()), ("n_tokens", pa.int64()),
     ("ids_crc32", pa.int64())]
)


def _blocks(vocabulary: str, end_id: int, escape_bits: int, block_ids: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder.of_process(vocabulary)
        shard = TaskContext.get().partitionId()
        end = end_id.to_bytes(4, "little")
        number = start = held = 0
        keys: list = []
        docs: list[bytes] = []

        def block():
            ids = np.frombuffer(b"".join(docs), "<u4")
            words, firsts, places, escaped = encode(ids, escape_bits)
            return record(
                _BLOCK, [shard], [number], [start], [len(ids)], [words.astype("<u8").tobytes()],
                [firsts.astype("<u4").tobytes()], [places.astype("<u4").tobytes()],
                [escaped.astype("<u8").tobytes()], [keys], [[len(d) // 4 for d in docs]],
            )

        for part in slices(batches, limit=1 << 20):
            for key, ids in zip(part.column("key").to_pylist(), encoder.ids(part.column("text").to_pylist())):
                keys.append(key)
                docs.append(ids + end)
                held += len(docs[-1]) // 4
                if held >= block_ids:
                    yield block()
                    number, start, held = number + 1, start + held, 0
                    keys.clear()
                    docs.clear()
        if docs:
            yield block()

    return run


def _documents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for b in range(batch.num_rows):
            get = {n: batch.column(n)[b].as_py() for n in batch.schema.names}
            ids = decode(
                np.frombuffer(get["words"], "<u8"), np.frombuffer(get["firsts"], "<u4").astype(np.int64),
                get["n_ids"], np.frombuffer(get["places"], "<u4"), np.frombuffer(get["escaped"], "<u8"),
            ).astype("<u4")
            raw = memoryview(ids.tobytes())
            ends = np.cumsum(get["lengths"])
            starts = ends - get["lengths"]
            crcs = [zlib.crc32(raw[4 * a : 4 * e]) for a, e in zip(starts.tolist(), ends.tolist())]
            yield record(
                _DOC, get["doc_ids"], np.full(len(ends), get["shard"], np.int32), starts + get["start"],
                np.array(get["lengths"], np.int64), crcs,
            )


def write_ids(
    df: DataFrame, path: str, vocabulary: str, end_id: int = 0, escape_bits: int = 20,
    block_ids: int = BLOCK_IDS, id_col: str = "doc_id", text_col: str = "text",
) -> None:
    """Writes the ids of every document and ``end_id`` after each, ascending by id.

    Null text counts as empty: the end id alone. Equal ids stay as rows of
    their own, null ids come first, further columns are ignored; an empty table
    gives files without blocks.
    """
    (
        texts_of(df, id_col, text_col)
        .repartitionByRange(tasks(df), "key")
        .sortWithinPartitions("key")
        .mapInArrow(_blocks(vocabulary, end_id, escape_bits, block_ids), _BLOCK_DDL)
        .write.parquet(path)
    )


def read_ids(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start (ids before it in all files), n_tokens, ids_crc32, decoded from the files."""
    files = spark.read.schema(_BLOCK_DDL).parquet(path)
    # One row per file comes to the driver, to number the ids across files.
    sizes = sorted((r["shard"], r["n"]) for r in files.groupBy("shard").agg(F.sum("n_ids").alias("n")).collect())
    base, total = [], 0
    for shard, n in sizes:
        base.append((shard, total))
        total += n
    bases = spark.createDataFrame(base, "shard int, base long")
    docs = files.mapInArrow(
        _documents, "doc_id long, shard int, start long, n_tokens long, ids_crc32 long"
    )
    return docs.join(F.broadcast(bases), "shard").select(
        "doc_id", (F.col("start") + F.col("base")).alias("start"), "n_tokens", "ids_crc32"
    )


def encode_and_read(df: DataFrame, vocabulary: str, **options) -> DataFrame:
    path = scratch_path(df.sparkSession, "token-ids")
    write_ids(df, path, vocabulary, **options)
    return read_ids(df.sparkSession, path)
