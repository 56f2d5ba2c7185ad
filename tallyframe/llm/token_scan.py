"""Token counts of documents in flat token files, by scanning for separators.

A flat file is a sequence of token ids of fixed width, every document followed by an
end-of-document id; nothing says where documents begin. Files are read as blocks. Each block is
searched for separators with one vectorised comparison; documents that cross blocks are put
together by a prefix scan over the blocks' summaries: how many separators came before, and where
the last of them is. The scan runs in groups of GROUP blocks and then across groups, so that a
file of any length is spread over tasks.

`write_flat` makes such files from documents: rows of at most BLOCK_BYTES (a table of blocks can
be split, unlike one binary file), and beside them the ids of the documents in file order.
`read_files` reads plain binary files, as other tools write them.
"""

from __future__ import annotations

import base64

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import scratch_dir, settle
from .text_arrays import slices

BLOCK_BYTES = 1 << 18
#: Blocks, and ids, that are numbered in one group.
GROUP = 1024
#: Pre-tokenisation of the byte-level vocabularies (a fixed value of theirs).
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
_KINDS = {2: np.dtype("<u2"), 4: np.dtype("<u4")}


def read_vocabulary(path: str) -> dict[bytes, int]:
    """A tiktoken file of base64 tokens and ranks, read on the driver (a few MB) and broadcast."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


_ENCODINGS: dict[int, object] = {}


def _encoding(ranks):
    import tiktoken

    if ranks.id not in _ENCODINGS:  # once for each Python worker
        _ENCODINGS.clear()
        _ENCODINGS[ranks.id] = tiktoken.Encoding("flat", pat_str=PATTERN, mergeable_ranks=ranks.value, special_tokens={})
    return _ENCODINGS[ranks.id]


class _Ranks:
    """A broadcast vocabulary with a name that survives pickling."""

    def __init__(self, spark: SparkSession, path: str):
        self.id, self.shared = hash(path), spark.sparkContext.broadcast(read_vocabulary(path))

    @property
    def value(self):
        return self.shared.value


def _write(ranks, end_id: int, width: int):
    kind, schema = _KINDS[width], pa.schema([("file", pa.int64()), ("kind", pa.string()), ("block", pa.int64()), ("data", pa.binary())])

    def run(batches):
        encoding, file = _encoding(ranks), TaskContext.get().partitionId()
        held, held_bytes, block, ids, group = [], 0, 0, [], 0
        for whole in batches:
            for batch in slices(whole, "text", 1 << 20):
                out = []
                for text, doc_id in zip(batch.column("text").to_pylist(), batch.column("doc_id").to_pylist()):
                    tokens = encoding.encode_ordinary(text) if text else []
                    held.append(np.array([*tokens, end_id], kind).tobytes())
                    held_bytes += len(held[-1])
                    ids.append(doc_id)
                    if held_bytes >= BLOCK_BYTES:
                        data = b"".join(held)
                        full = len(data) // BLOCK_BYTES * BLOCK_BYTES
                        for at in range(0, full, BLOCK_BYTES):
                            out.append({"file": file, "kind": "tokens", "block": block, "data": data[at: at + BLOCK_BYTES]})
                            block += 1
                        held, held_bytes = [data[full:]], len(data) - full
                    if len(ids) == GROUP:
                        out.append({"file": file, "kind": "ids", "block": group, "data": _pack_ids(ids)})
                        ids, group = [], group + 1
                if out:
                    yield pa.RecordBatch.from_pylist(out, schema)
        rest = [{"file": file, "kind": "tokens", "block": block, "data": b"".join(held)}] if held_bytes else []
        rest += [{"file": file, "kind": "ids", "block": group, "data": _pack_ids(ids)}] if ids else []
        if rest:
            yield pa.RecordBatch.from_pylist(rest, schema)
    return run


_MISSING = np.int64(-2**63)


def _pack_ids(ids: list) -> bytes:
    return np.array([_MISSING if i is None else i for i in ids], np.int64).tobytes()


def write_flat(documents: DataFrame, vocabulary: str, end_id: int, width: int = 2) -> tuple[DataFrame, DataFrame]:
    """Tokenise (doc_id, text) into flat files: (blocks (file, block, data), ids (file, block, data)).

    A task writes one file; it is the same on a retry. end_id must not be an id of the
    vocabulary. A null text has no tokens, only its separator.
    """
    spark = documents.sparkSession
    slim = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    path = scratch_dir(spark, "flat-tokens")
    (slim.mapInArrow(_write(_Ranks(spark, vocabulary), end_id, width), "file long, kind string, block long, data binary")
     .write.partitionBy("kind").option("compression", "zstd").parquet(path))
    both = spark.read.schema("file long, block long, data binary, kind string").parquet(path)
    return tuple(both.where(F.col("kind") == k).drop("kind") for k in ("tokens", "ids"))


def _split(batches):
    for batch in batches:
        for i in range(batch.num_rows):
            data, file = batch.column("content")[i].as_buffer(), batch.column("path")[i].as_py()
            for n, at in enumerate(range(0, data.size, BLOCK_BYTES)):
                yield pa.RecordBatch.from_pydict({"file": [file], "block": [n], "data": [data.slice(at, min(BLOCK_BYTES, data.size - at)).to_pybytes()]},
                                                 pa.schema([("file", pa.string()), ("block", pa.int64()), ("data", pa.binary())]))


def read_files(spark: SparkSession, path: str) -> DataFrame:
    """Blocks of flat binary files of up to 2 GB each, which Spark reads whole."""
    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(_split, "file string, block long, data binary")


def _search(end_id: int, width: int):
    """Separators of each block: positions in it, and its length, in tokens."""
    schema = pa.schema([("block", pa.int64()), ("length", pa.int64()), ("ends", pa.list_(pa.int32()))])

    def run(batches):
        for batch in batches:
            found, length = [], []
            for value in batch.column("data"):
                raw = value.as_buffer() if value.is_valid else pa.py_buffer(b"")
                if raw.size % width:
                    raise ValueError("a block must hold whole tokens")
                tokens = np.frombuffer(raw, _KINDS[width])
                found.append(np.flatnonzero(tokens == end_id).astype(np.int32))
                length.append(len(tokens))
            yield pa.RecordBatch.from_arrays([batch.column("file"), batch.column("block"), pa.array(length, pa.int64()),
                                              pa.array(found, pa.list_(pa.int32()))], names=["file", *schema.names])
    return run


def count_tokens(blocks: DataFrame, end_id: int, width: int = 2) -> DataFrame:
    """(file, ordinal, n_tokens, closed) of every document in flat files.

    blocks: file, block (in order, from 0), data (bytes); other columns are ignored. All
    blocks of a file but the last have the same length. ordinal counts documents in a file from
    0; separators don't count as tokens, and two in a row close an empty document. Tokens behind
    a file's last separator are a document that isn't closed. Empty blocks, files without
    separator and documents over many blocks are fine. No blocks give no rows.
    """
    kind = blocks.schema["file"].dataType.simpleString()
    found = settle(blocks.select("file", "block", "data").mapInArrow(
        _search(end_id, width), f"file {kind}, block long, length long, ends array<int>"), "separators")
    found = found.withColumn("group", F.floor(F.col("block") / GROUP))
    # summaries of groups of blocks, then of blocks within a group; the monoid is
    # (tokens, separators, tokens behind the last separator)
    size = F.size("ends").cast("long")
    inside = Window.partitionBy("file", "group").orderBy("block")
    upto = inside.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    stepped = (found.withColumn("n", size).withColumn("start", F.sum("length").over(upto) - F.col("length"))
               .withColumn("earlier", F.sum("n").over(upto) - F.col("n"))
               .withColumn("last", F.when(F.col("n") > 0, F.col("start") + F.element_at("ends", -1))))
    groups = stepped.groupBy("file", "group").agg(F.sum("length").alias("g_length"), F.sum("n").alias("g_n"), F.max("last").alias("g_last"))
    before = Window.partitionBy("file").orderBy("group").rowsBetween(Window.unboundedPreceding, -1)
    groups = (groups.withColumn("g_start", F.coalesce(F.sum("g_length").over(before), F.lit(0)))
              .withColumn("g_earlier", F.coalesce(F.sum("g_n").over(before), F.lit(0))))
    groups = groups.withColumn("g_before", F.max(F.col("g_start") + F.col("g_last")).over(before))
    placed = stepped.join(groups.select("file", "group", "g_start", "g_earlier", "g_before"), ["file", "group"])
    previous = F.coalesce(F.max("last").over(inside.rowsBetween(Window.unboundedPreceding, -1)) + F.col("g_start"), "g_before", F.lit(-1))
    placed = placed.withColumn("previous", previous.cast("long")).withColumn("at", F.col("g_start") + F.col("start"))
    closed = placed.where("n > 0").select("file", (F.col("g_earlier") + F.col("earlier")).alias("first"), "previous", "at", F.posexplode("ends").alias("i", "end"), "ends")
    closed = closed.select(
        "file", (F.col("first") + F.col("i")).alias("ordinal"),
        F.when(F.col("i") == 0, F.col("at") + F.col("end") - F.col("previous") - 1)
        .otherwise(F.col("end") - F.expr("ends[greatest(i - 1, 0)]") - 1).cast("long").alias("n_tokens"), F.lit(True).alias("closed"))
    whole = groups.groupBy("file").agg(F.sum("g_length").alias("length"), F.sum("g_n").alias("n"), F.max(F.col("g_start") + F.col("g_last")).alias("last"))
    left = F.col("length") - F.coalesce("last", F.lit(-1)) - 1
    open_ = whole.where(left > 0).select("file", F.col("n").alias("ordinal"), left.cast("long").alias("n_tokens"), F.lit(False).alias("closed"))
    return closed.union(open_)


def document_tokens(documents: DataFrame, vocabulary: str, end_id: int, width: int = 2) -> DataFrame:
    """(doc_id, n_tokens) of every row of `documents`, counted in the flat files made of them.

    documents: doc_id, text; other columns are ignored. Null and empty texts have 0 tokens;
    missing and repeated ids keep a row each. No rows give no rows.
    """
    blocks, ids = write_flat(documents, vocabulary, end_id, width)
    counts = count_tokens(blocks, end_id, width)
    order = ids.mapInArrow(_ids, "file long, ordinal long, doc_id long")
    return order.join(counts, ["file", "ordinal"]).select("doc_id", "n_tokens")


def _ids(batches):
    for batch in batches:
        for file, block, data in zip(*(batch.column(c) for c in ("file", "block", "data"))):
            ids = np.frombuffer(data.as_buffer(), np.int64)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(ids), file.as_py())), pa.array(block.as_py() * GROUP + np.arange(len(ids))),
                 pa.array(ids, mask=ids == _MISSING)], names=["file", "ordinal", "doc_id"])
