"""Helpers of the operators: columns, slices of Arrow batches, staged tables."""

from __future__ import annotations

import pickle
import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfwise.session import scratch_path

cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: Bytes of text that a task works on at once.
SLICE_BYTES = 2 << 20


def texts_of(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(key, text): ids as long, null text as empty. Other columns are not read."""
    return df.select(
        df[id_col].cast("long").alias("key"),
        F.coalesce(df[text_col].cast("string"), F.lit("")).alias("text"),
    )


def slices(
    batches: Iterator[pa.RecordBatch], column: str = "text", limit: int = SLICE_BYTES
) -> Iterator[pa.RecordBatch]:
    """Cuts batches at row borders into parts of about ``limit`` bytes of text."""
    for batch in batches:
        if batch.num_rows == 0:
            continue
        ends = offsets_of(batch.column(column))[1:]
        start = 0
        while start < batch.num_rows:
            base = ends[start - 1] if start else 0
            stop = max(start + 1, int(np.searchsorted(ends, base + limit, side="right")))
            yield batch.slice(start, stop - start)
            start = stop


def offsets_of(column: pa.Array) -> np.ndarray:
    """Where each value starts and the last one ends, from 0."""
    width = np.int64 if pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type) else np.int32
    raw = np.frombuffer(column.buffers()[1], width)[column.offset : column.offset + len(column) + 1]
    return raw.astype(np.int64) - int(raw[0])


def bytes_of(column: pa.Array) -> np.ndarray:
    """The bytes of all values, one after the other, as offsets_of counts them."""
    width = np.int64 if pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type) else np.int32
    raw = np.frombuffer(column.buffers()[1], width)
    start, stop = int(raw[column.offset]), int(raw[column.offset + len(column)])
    data = column.buffers()[2]
    return np.frombuffer(data, np.uint8)[start:stop] if data is not None else np.zeros(0, np.uint8)


def record(schema: pa.Schema, *columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [c if isinstance(c, pa.Array) else pa.array(c, f.type) for c, f in zip(columns, schema)],
        schema=schema,
    )


def staged(df: DataFrame, label: str, own: list[str] | None = None) -> DataFrame:
    """Written to the shared folder and read back: cuts lineage, survives lost executors.

    What is written no longer needs the shuffle files behind it, so Spark is
    told to drop them as soon as the write has ended. ``own`` collects the path,
    for ``discard``.
    """
    spark, name = df.sparkSession, "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    path = scratch_path(spark, label)
    before = spark.conf.get(name, "false")
    spark.conf.set(name, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(name, before)
    if own is not None:
        own.append(path)
    return spark.read.schema(df.schema).parquet(path)


def discard(spark, own: list[str]) -> None:
    """Deletes staged tables that nothing reads any more."""
    for path in own:
        place = spark._jvm.org.apache.hadoop.fs.Path(path)
        place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)
    own.clear()


class Shared:
    """An object of this package for all tasks. It travels with its class, so workers need no copy of the package."""

    def __init__(self, spark, held):
        self.packed, self.held = spark.sparkContext.broadcast(cloudpickle.dumps(held)), []

    def __reduce__(self):
        return _received, (self.packed,)

    @property
    def value(self):
        if not self.held:
            self.held.append(pickle.loads(self.packed.value))
        return self.held[0]


def _received(packed) -> Shared:
    shared = object.__new__(Shared)
    shared.packed, shared.held = packed, []
    return shared


def tasks(df: DataFrame) -> int:
    """Shuffle partitions of the session, for explicit repartitioning."""
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
