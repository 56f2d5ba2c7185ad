"""Documents packed into chunks of about 2 MB, kept in a bucketed table.

Operators that look at the corpus several times (count, then order; find, then cut) pack it
once. A chunk is a row with the ids, lengths and compressed text of some documents. A task
writes all its chunks under one `part`, the bucket column, so that a later join on `part`
brings what other tasks found about a chunk to it without moving the text again. The table
lives in the session's warehouse, which all executors share, and outlives any of them.

Values that travel between chunks are packed as well: sorted hashes are cut into buckets by
their leading bits, and one row carries all hashes of a chunk in a bucket. Such an exchange
costs a few bytes a hash and is still partitioned, shuffled and retried by Spark.
"""

from __future__ import annotations

import uuid
from functools import cache

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .text_arrays import flat, slices

CHUNK_BYTES = 2 << 20
CHUNK_ROWS = 1 << 16
SCHEMA = "part long, seq long, doc_ids array<long>, sizes array<int>, data binary"


@cache
def _compressor() -> zstandard.ZstdCompressor:
    """One for all small pieces of a worker: a new one costs more than such a piece."""
    return zstandard.ZstdCompressor(level=1)


@cache
def _decompressor() -> zstandard.ZstdDecompressor:
    return zstandard.ZstdDecompressor()


def compress(data: bytes) -> bytes:
    return _compressor().compress(data)


def decompress(data: bytes) -> bytes:
    return _decompressor().decompress(data)


def squeeze(values: np.ndarray) -> bytes:
    """Numbers as compressed byte planes: in sorted numbers the leading planes are regular."""
    planes = np.ascontiguousarray(values.view(np.uint8).reshape(len(values), values.itemsize).T)
    return compress(planes.tobytes())


def unsqueeze(data: bytes, kind) -> np.ndarray:
    raw = np.frombuffer(decompress(data), np.uint8)
    size = np.dtype(kind).itemsize
    return np.ascontiguousarray(raw.reshape(size, -1).T).view(kind).ravel()


def _gathered(batches, size: int):
    """Batches put together until they hold `size` bytes or the rows of a chunk."""
    kept, rows, held = [], 0, 0
    for batch in batches:
        kept.append(batch)
        rows, held = rows + batch.num_rows, held + batch.nbytes
        if held >= size or rows >= CHUNK_ROWS:
            yield pa.concat_batches(kept)
            kept, rows, held = [], 0, 0
    if rows:
        yield pa.concat_batches(kept)


def _pack(size: int):
    schema = pa.schema([("part", pa.int64()), ("seq", pa.int64()), ("doc_ids", pa.list_(pa.int64())),
                        ("sizes", pa.list_(pa.int32())), ("data", pa.binary())])

    def run(batches):
        part, seq = TaskContext.get().partitionId(), 0
        for batch in _gathered(batches, size) if size > CHUNK_BYTES else batches:
            for piece in slices(batch, "text", size):
                for at in range(0, piece.num_rows, CHUNK_ROWS):
                    rows = piece.slice(at, CHUNK_ROWS)
                    buf, off = flat(rows.column("text"))
                    yield pa.RecordBatch.from_pylist([{
                        "part": part, "seq": seq, "doc_ids": rows.column("doc_id").to_pylist(),
                        "sizes": np.diff(off).tolist(),
                        "data": compress(buf.tobytes()),
                    }], schema)
                    seq += 1
    return run


def pack(documents: DataFrame, size: int = CHUNK_BYTES) -> str:
    """Write (doc_id, text) as a chunk table; returns its name. `drop` removes it.

    size: bytes of text in a chunk. Operators that send a row for each chunk and bucket take
    larger chunks, as the number of those rows is a product.
    """
    name = f"chunks_{uuid.uuid4().hex}"
    slim = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    buckets = max(1, slim.rdd.getNumPartitions())
    # the data column is compressed already
    (slim.mapInArrow(_pack(size), SCHEMA).write.option("compression", "uncompressed")
     .bucketBy(buckets, "part").sortBy("part").saveAsTable(name))
    return name


def unpack(row: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bytes, offsets and uids of a chunk row; a uid names one row of the documents."""
    sizes = np.asarray(row["sizes"], np.int64)
    off = np.concatenate(([0], np.cumsum(sizes)))
    buf = np.frombuffer(decompress(row["data"]), np.uint8) if off[-1] else np.zeros(0, np.uint8)
    return buf, off, (int(row["part"]) << 40 | int(row["seq"]) << 16) + np.arange(len(sizes))


def rows_of(batches):
    """The rows of Arrow batches, one at a time as dicts."""
    for batch in batches:
        for i in range(batch.num_rows):
            yield {name: batch.column(j)[i].as_py() for j, name in enumerate(batch.schema.names)}


def bucket_bits(chunks: DataFrame, unit: int = 4 << 20) -> int:
    """Leading hash bits that name a bucket: one bucket for each `unit` bytes of text."""
    total = chunks.select(F.expr("aggregate(sizes, 0L, (a, x) -> a + x)").alias("n")).agg(F.sum("n")).first()[0] or 0
    return max(4, int(np.ceil(np.log2(max(total / unit, 1)))))


def cut(sorted_hashes: np.ndarray, bits: int):
    """(bucket, begin, end) of every bucket that sorted hashes fall into."""
    bucket = (sorted_hashes >> np.uint64(64 - bits)).astype(np.int64)
    begin = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1]]) if len(bucket) else []
    for b, e in zip(begin, [*begin[1:], len(bucket)]):
        yield int(bucket[b]), int(b), int(e)


def join_chunks(chunks: DataFrame, found: DataFrame, how: str = "left") -> DataFrame:
    """Chunks with the row of `found` (part, seq, ...) about each.

    Only `part` is a join key, because the table is bucketed by it and stays where it is; the
    few chunks of a part are told apart by a condition.
    """
    right = found.withColumnsRenamed({"part": "__part", "seq": "__seq"})
    on = (F.col("part") == F.col("__part")) & (F.col("seq") - F.col("__seq") == 0)
    return chunks.join(right, on, how).drop("__part", "__seq")


def drop(spark: SparkSession, name: str) -> None:
    """Remove a chunk table, once nothing lazy reads it any more."""
    spark.sql(f"DROP TABLE IF EXISTS {name}")
