"""WARC archives as a table of chunks.

A payload is cut into rows of (record, chunk number, bytes) right behind the
scan. Every later step takes one chunk at a time: the digest is carried along
the chunks of a record, each row holding the digest up to its end, and the
archive is deflated and parsed as a stream, one gzip member per record. The
bytes of an archive part, in order of record and chunk, are a ``.warc.gz`` file.
"""

from __future__ import annotations

import base64
import hashlib
import re
import sys
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfwise.llm.batches import record, slices, tasks
from shelfwise.session import scratch_path

cloudpickle.register_pickle_by_value(sys.modules[__name__])

CHUNK_BYTES = 1 << 16
DATE = "2024-01-01T00:00:00Z"
#: Bytes of output rows sent on at once.
FLUSH_BYTES = 1 << 22

_CHUNKS = pa.schema(
    [("page_id", pa.int64()), ("row", pa.int64()), ("url", pa.string()), ("chunk_no", pa.int32()),
     ("n_chunks", pa.int32()), ("data", pa.binary()), ("bytes_so_far", pa.int64()), ("digest_so_far", pa.binary())]
)
_CHUNKS_DDL = (
    "page_id long, row long, url string, chunk_no int, n_chunks int, data binary, bytes_so_far long, "
    "digest_so_far binary"
)
_ARCHIVE = pa.schema(
    [("row", pa.int64()), ("chunk_no", pa.int32()), ("whole", pa.bool_()), ("data", pa.binary())]
)
_ARCHIVE_DDL = "row long, chunk_no int, whole boolean, data binary"
_READ = pa.schema(
    [("page_id", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()),
     ("record_type", pa.string()), ("refers_to", pa.int64()), ("url", pa.string())]
)


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Chunks of a record follow each other here: they come from one row."""
    sha, size = hashlib.sha1(), 0
    for part in slices(batches, "data"):
        states, sizes = [], []
        for number, data in zip(part.column("chunk_no").to_pylist(), part.column("data")):
            if number == 0:
                sha, size = hashlib.sha1(), 0
            buffer = data.as_buffer()
            sha.update(buffer)
            size += buffer.size
            states.append(sha.copy().digest())
            sizes.append(size)
        yield record(
            _CHUNKS, *[part.column(n) for n in _CHUNKS.names[:6]], sizes, states
        )


def chunk_table(
    df: DataFrame, chunk_bytes: int = CHUNK_BYTES, id_col: str = "page_id", body_col: str = "html",
    url_col: str | None = "url",
) -> DataFrame:
    """One row per chunk of each payload; an empty or null payload has one empty chunk.

    ``row`` numbers the rows of ``df``, so repeated ids stay apart. The last
    chunk of a record holds the size and the digest of the whole payload.
    """
    url = df[url_col].cast("string") if url_col else F.lit(None).cast("string")
    rows = df.select(
        df[id_col].cast("long").alias("page_id"),
        F.monotonically_increasing_id().alias("row"),
        url.alias("url"),
        F.encode(F.coalesce(df[body_col].cast("string"), F.lit("")), "UTF-8").alias("body"),
    ).withColumn("n_chunks", F.expr(f"int(greatest(1, ceil(length(body) / {chunk_bytes})))"))
    cut = F.expr(
        f"transform(sequence(0, n_chunks - 1), i -> substring(body, i * {chunk_bytes} + 1, {chunk_bytes}))"
    )
    return rows.select("page_id", "row", "url", "n_chunks", F.posexplode(cut).alias("chunk_no", "data")).mapInArrow(
        _digests, _CHUNKS_DDL
    )


def _base32(digest: bytes) -> str:
    return base64.b32encode(digest).decode()


def _head(page_id, url, size: int, digest: bytes, refers_to, kind: str) -> bytes:
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n"
    lines = [
        "WARC/1.1",
        f"WARC-Type: {kind}",
        f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>",
        f"WARC-Date: {DATE}",
    ]
    if url is not None:
        lines.append("WARC-Target-URI: " + re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url))
    lines.append(f"WARC-Payload-Digest: sha1:{_base32(digest)}")
    length = len(http)
    if kind == "revisit":
        lines.append("WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")
        lines.append(f"WARC-Refers-To: <urn:page:{refers_to}>")
    else:
        length += size
    lines.append("Content-Type: application/http; msgtype=response")
    lines.append(f"Content-Length: {length}")
    return ("\r\n".join(lines) + "\r\n\r\n" + http).encode()


def _archive(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Chunk rows, sorted by row and chunk, to deflated WARC rows."""
    squeeze = None
    for part in slices(batches, "data"):
        rows = []
        get = {n: part.column(n).to_pylist() for n in part.schema.names if n != "data"}
        for i, data in enumerate(part.column("data")):
            number, last = get["chunk_no"][i], get["n_chunks"][i] - 1
            revisit = get["refers_to"][i] is not None
            out = b""
            if number == 0:
                squeeze = zlib.compressobj(6, zlib.DEFLATED, 31)
                kind = "revisit" if revisit else "response"
                out = squeeze.compress(
                    _head(get["page_id"][i], get["url"][i], get["size"][i], get["digest"][i], get["refers_to"][i], kind)
                )
            if not revisit:
                out += squeeze.compress(data.as_buffer())
            if number == last or revisit:
                out += squeeze.compress(b"\r\n\r\n") + squeeze.flush()
            rows.append((get["row"][i], number, last == 0 or revisit, out))
        yield record(_ARCHIVE, *zip(*rows))


def write_archives(df: DataFrame, path: str, min_bytes: int = 0, chunk_bytes: int = CHUNK_BYTES, **columns) -> None:
    """Writes a record per row of ``df`` below ``path``.

    Of records with equal payloads of at least ``min_bytes``, the one with the
    largest id is the response and the others revisit it; smaller ones are all
    responses. Rows that repeat the largest id are responses too. A record with
    a null id is a response. An empty table gives archives without records.
    """
    spark = df.sparkSession
    table = scratch_path(spark, "chunks")
    chunk_table(df, chunk_bytes, **columns).write.option("compression", "zstd").parquet(table)
    chunks = spark.read.schema(_CHUNKS_DDL).parquet(table)
    ends = chunks.where("chunk_no = n_chunks - 1").select(
        "row", "page_id", F.col("bytes_so_far").alias("size"), F.col("digest_so_far").alias("digest")
    )
    first = ends.groupBy("digest", "size").agg(F.max("page_id").alias("response"))
    known = ends.join(first, ["digest", "size"]).select(
        "row", "size", "digest",
        F.when((F.col("size") >= min_bytes) & (F.col("page_id") < F.col("response")), F.col("response")).alias("refers_to"),
    )
    (
        chunks.select("row", "page_id", "url", "chunk_no", "n_chunks", "data")
        .join(known, "row")
        .where("refers_to IS NULL OR chunk_no = 0")
        .withColumn("data", F.when(F.col("refers_to").isNull(), F.col("data")).otherwise(F.lit(b"")))
        .repartition(tasks(df), "row")
        .sortWithinPartitions("row", "chunk_no")
        .mapInArrow(_archive, _ARCHIVE_DDL)
        .write.option("compression", "none")
        .parquet(path)
    )


class _Reader:
    """Parses one record from its deflated pieces, hashing the payload as it comes."""

    def __init__(self):
        self.inflate, self.head, self.fields = zlib.decompressobj(31), b"", None
        self.sha, self.size, self.left = hashlib.sha1(), 0, 0

    def feed(self, data) -> None:
        piece = self.inflate.decompress(data)
        if self.fields is None:
            self.head += piece
            warc, found, rest = self.head.partition(b"\r\n\r\n")
            http, found_too, body = rest.partition(b"\r\n\r\n")
            if not (found and found_too):
                return
            lines = warc.decode().split("\r\n")
            if lines[0] != "WARC/1.1":
                raise ValueError("not a WARC record")
            self.fields = dict(line.split(": ", 1) for line in lines[1:])
            self.fields["size"] = int(re.search(rb"Content-Length: (\d+)", http)[1])
            self.left = int(self.fields["Content-Length"]) - len(http) - 4
            piece = body
        own = piece[: self.left]
        self.left -= len(own)
        self.size += len(own)
        self.sha.update(own)

    def row(self) -> tuple:
        if self.fields is None or self.left or not self.inflate.eof:
            raise ValueError("a WARC record is cut off")
        kind, digest = self.fields["WARC-Type"], self.fields["WARC-Payload-Digest"].removeprefix("sha1:")
        if kind == "response" and (digest != _base32(self.sha.digest()) or self.size != self.fields["size"]):
            raise ValueError(f"payload digest differs in {self.fields['WARC-Record-ID']}")
        page, refers = (
            re.fullmatch(r"<urn:page:(-?\d*)>", self.fields.get(n, "<urn:page:>"))[1]
            for n in ("WARC-Record-ID", "WARC-Refers-To")
        )
        return (
            int(page) if page else None, self.fields["size"], digest, kind, int(refers) if refers else None,
            self.fields.get("WARC-Target-URI"),
        )


def _parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    reader, current = None, None
    for part in slices(batches, "data", limit=1 << 20):
        rows = []
        for row, data in zip(part.column("row").to_pylist(), part.column("data")):
            if row != current:
                if reader is not None:
                    rows.append(reader.row())
                reader, current = _Reader(), row
            reader.feed(data.as_buffer())
        if rows:
            yield record(_READ, *zip(*rows))
    if reader is not None:
        yield record(_READ, *zip(*[reader.row()]))


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to, url of every record."""
    rows = spark.read.schema(_ARCHIVE_DDL).parquet(path)
    long = rows.where("NOT whole")
    long = long.repartition(tasks(rows), "row").sortWithinPartitions("row", "chunk_no")
    ddl = (
        "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, url string"
    )
    return rows.where("whole").select(*rows.columns).mapInArrow(_parse, ddl).unionByName(long.mapInArrow(_parse, ddl))


def archive_and_read(df: DataFrame, **options) -> DataFrame:
    path = scratch_path(df.sparkSession, "warc")
    write_archives(df, path, **options)
    return read_archives(df.sparkSession, path)
