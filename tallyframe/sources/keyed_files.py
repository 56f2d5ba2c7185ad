"""A stored table whose edits rewrite only the files they hit.

Rows lie in Parquet files of disjoint key ranges. An index, a version of which every edit
publishes, has a row for each file: its least key and its number of rows. Beside the files lie
Bloom filters of their keys. An edit names the keys it touches: each belongs to the range of one
file, and a file is read, changed and written anew only if its filter knows one of them, or if
the edit may insert. All other files are part of the new version as they are.

The driver holds the index, a short row for each file, and nothing of the rows. A reader follows
the index it began with, so it sees the table before an edit or after it. Of two editors of one
version the second fails when it publishes.
"""

from __future__ import annotations

import bisect
import json
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import settle
from .versions import current_version, read_version, write_version

#: Rows of a file when it is first written; an edit splits what grows beyond twice that.
FILE_ROWS = 100_000
#: Bits of a filter for each row of a full file, and probes of a key: about one in a hundred misses is let through.
BITS_PER_ROW, PROBES = 10, 7
#: The index stays small enough for the driver; larger tables take larger files.
MOST_FILES = 1_000_000

_INDEX = "file string, low string, rows long"


@dataclass(frozen=True)
class Edit:
    """What an edit did: the version it published, the files before it, those it read and those it wrote."""

    version: int
    files: int
    rewritten: int
    written: int


@dataclass(frozen=True)
class _Layout:
    keys: list[str]
    schema: T.StructType
    file_rows: int

    @property
    def bits(self) -> int:
        return 1 << max(10, (self.file_rows * BITS_PER_ROW - 1).bit_length())


def _layout(spark: SparkSession, root: str) -> _Layout:
    row = spark.read.parquet(f"{root}/layout").first()
    return _Layout(list(row["keys"]), T.StructType.fromJson(json.loads(row["schema"])), row["file_rows"])


def _hashes(keys: list[str]):
    return [F.xxhash64(*keys).alias("h1"), F.xxhash64(F.lit(1), *keys).alias("h2")]


def _probes(h1: np.ndarray, h2: np.ndarray, bits: int) -> np.ndarray:
    """The bits of each key, a row for each."""
    step = h2.view(np.uint64)[:, None] | np.uint64(1)
    return ((h1.view(np.uint64)[:, None] + np.arange(PROBES, dtype=np.uint64) * step) & np.uint64(bits - 1)).astype(np.int64)


def _filters(bits: int):
    """Filters of the files in a task's rows; a file that several tasks read has one from each."""
    def run(batches):
        held: dict[str, np.ndarray] = {}
        for batch in batches:
            files = batch.column("file").dictionary_encode()
            where = files.indices.to_numpy()
            at = _probes(batch.column("h1").to_numpy(), batch.column("h2").to_numpy(), bits)
            for k, name in enumerate(files.dictionary.to_pylist()):
                held.setdefault(name, np.zeros(bits, bool))[at[where == k].ravel()] = True
                if len(held) > 64:  # files come one after the other: the rest is done
                    old = next(iter(held))
                    yield pa.RecordBatch.from_pydict({"file": [old], "bits": [np.packbits(held.pop(old)).tobytes()]})
        for name, own in held.items():
            yield pa.RecordBatch.from_pydict({"file": [name], "bits": [np.packbits(own).tobytes()]})
    return run


def _either(table: pa.Table) -> pa.Table:
    parts = [np.frombuffer(b, np.uint8) for b in table["bits"].to_pylist()]
    return pa.table({"file": table["file"].slice(0, 1), "bits": pa.array([np.bitwise_or.reduce(parts).tobytes()], pa.binary())})


def _key_text(keys: list[str]):
    return F.to_json(F.array(*[F.col(k).cast("string") for k in keys]))


def _parsed(low: str, layout: _Layout) -> tuple:
    whole = [isinstance(layout.schema[k].dataType, T.IntegralType) for k in layout.keys]
    return tuple(int(v) if number else v for v, number in zip(json.loads(low), whole))


def _write(spark: SparkSession, root: str, layout: _Layout, rows: DataFrame, part: str) -> DataFrame:
    """Write rows as files of one slot and key range each, with their filters; returns their index rows."""
    out = f"{root}/rows/{part}"
    rows.write.mode("errorifexists").option("maxRecordsPerFile", 2 * layout.file_rows).partitionBy("slot").parquet(out)
    back = spark.read.schema(layout.schema).option("recursiveFileLookup", "true").parquet(out)
    name = F.concat(F.lit(f"{part}/"), F.element_at(F.split("_metadata.file_path", f"/rows/{part}/"), -1))
    keys = back.select(name.alias("file"), *layout.keys, *_hashes(layout.keys))
    filters = keys.select("file", "h1", "h2").mapInArrow(_filters(layout.bits), "file string, bits binary")
    filters.groupBy("file").applyInArrow(_either, "file string, bits binary").write.mode("errorifexists").parquet(f"{root}/filters/{part}")
    least = F.min_by(_key_text(layout.keys), F.struct(*layout.keys))
    return keys.groupBy("file").agg(least.alias("low"), F.count(F.lit(1)).alias("rows"))


def _write_tasks(rows: list[int], file_rows: int, least: int) -> int:
    """Tasks that write files of these numbers of rows.

    A task takes many small files, and writes one for each slot it meets. A slot that two tasks meet becomes
    two files, so with a task for each file an edit would cut most files in two.
    """
    whole = sum(-(-n // file_rows) for n in rows)
    return max(1, min(whole, max(least, -(-sum(rows) // FILE_ROWS))))


def create_table(spark: SparkSession, root: str, frame: DataFrame, keys: list[str], file_rows: int = FILE_ROWS) -> int:
    """Store a frame with unique, non-null keys (texts or whole numbers); returns its version, 1."""
    layout = _Layout(keys, T.StructType([T.StructField(f.name, f.dataType) for f in frame.schema]), file_rows)
    meta = [(keys, json.dumps(layout.schema.jsonValue()), file_rows)]
    spark.createDataFrame(meta, "keys array<string>, schema string, file_rows long").coalesce(1).write.mode("errorifexists").parquet(f"{root}/layout")
    frame = settle(frame, "to-store")  # counted, sampled for the ranges and written
    count = frame.count()
    files = max(1, -(-count // file_rows))
    ranged = frame.repartitionByRange(files, *keys).withColumn("slot", F.spark_partition_id().cast("long"))
    tasks = _write_tasks([file_rows] * files, file_rows, spark.sparkContext.defaultParallelism)
    index = _write(spark, root, layout, ranged.coalesce(tasks).sortWithinPartitions("slot", *keys), "v1")
    return write_version(spark, root, "index", index.coalesce(1))


def _index(spark: SparkSession, root: str, layout: _Layout, version: int | None) -> tuple[list[str], list[tuple], list[int]]:
    """Files in the order of their least keys, those keys, and numbers of rows."""
    rows = read_version(spark, root, "index", version).collect()
    if len(rows) > MOST_FILES:
        raise ValueError(f"{len(rows)} files: write the table with more rows a file")
    rows = sorted(((_parsed(r["low"], layout), r["file"], r["rows"]) for r in rows))
    return [r[1] for r in rows], [r[0] for r in rows], [r[2] for r in rows]


def _read(spark: SparkSession, root: str, layout: _Layout, files: list[str]) -> DataFrame:
    if not files:
        return spark.createDataFrame([], layout.schema)
    return spark.read.schema(layout.schema).parquet(*[f"{root}/rows/{f}" for f in files])


def read_table(spark: SparkSession, root: str, version: int | None = None) -> DataFrame:
    """The rows of a version, by default the newest."""
    layout = _layout(spark, root)
    return _read(spark, root, layout, _index(spark, root, layout, version)[0])


def replaced_rows(spark: SparkSession, root: str, before: int, after: int) -> tuple[DataFrame, DataFrame]:
    """Rows of the files that only version `before` has, and of those that only `after` has.

    Whatever differs between the two versions is among them, beside rows that were only moved.
    """
    layout = _layout(spark, root)
    old, new = (_index(spark, root, layout, v)[0] for v in (before, after))
    kept = set(old) & set(new)
    return tuple(_read(spark, root, layout, [f for f in files if f not in kept]) for files in (old, new))


def _located(frame: DataFrame, keys: list[str], lows: list[tuple]) -> DataFrame:
    """Add `slot`: the number of the last file whose least key is not above the row's."""
    single = len(keys) == 1 and lows != [()]
    bounds = [low[0] for low in lows] if single else lows

    def run(batches):
        for batch in batches:
            own = batch.column(keys[0]).to_pylist() if single else zip(*[batch.column(k).to_pylist() for k in keys])
            slots = [max(bisect.bisect_right(bounds, key) - 1, 0) for key in own]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(slots, pa.int64())], names=[*batch.schema.names, "slot"])
    return frame.mapInArrow(run, T.StructType([*frame.schema.fields, T.StructField("slot", T.LongType())]))


def _known(bits: int):
    """Slots with a key that their filter knows. The rows come by slot, the filter first."""
    def run(batches):
        slot, own, hit = None, None, False
        for batch in batches:
            for k in range(batch.num_rows):
                if batch.column("bits")[k].is_valid:
                    slot, hit = batch.column("slot")[k].as_py(), False
                    own = np.unpackbits(np.frombuffer(batch.column("bits")[k].as_py(), np.uint8)).astype(bool)
                elif not hit and batch.column("slot")[k].as_py() == slot:
                    h1, h2 = (np.array([batch.column(c)[k].as_py()], np.int64) for c in ("h1", "h2"))
                    if own[_probes(h1, h2, bits)].all():
                        hit = True
                        yield pa.RecordBatch.from_pydict({"slot": [slot]})
    return run


def _hit_slots(spark: SparkSession, root: str, layout: _Layout, files: list[str], lows: list[tuple], touched: DataFrame, inserts: bool) -> list[int]:
    keys = touched.select(*layout.keys).distinct().select(*layout.keys, *_hashes(layout.keys))
    asked = _located(keys, layout.keys, lows).select("slot", "h1", "h2")
    if inserts:
        return sorted(r[0] for r in asked.select("slot").distinct().collect())
    candidates = {r[0] for r in asked.select("slot").distinct().collect()}
    if not candidates:
        return []
    parts = sorted({files[s].split("/")[0] for s in candidates})
    named = spark.createDataFrame([(s, files[s]) for s in sorted(candidates)], "slot long, file string")
    filters = spark.read.schema("file string, bits binary").parquet(*[f"{root}/filters/{p}" for p in parts]).join(named, "file").select("slot", "bits")
    none = F.lit(None).cast("long")
    both = filters.select("slot", none.alias("h1"), none.alias("h2"), "bits").unionByName(asked.withColumn("bits", F.lit(None).cast("binary")))
    stream = both.repartition("slot").sortWithinPartitions("slot", F.col("bits").isNull())
    return sorted(r[0] for r in stream.mapInArrow(_known(layout.bits), "slot long").collect())


def look_up(spark: SparkSession, root: str, wanted: DataFrame, version: int | None = None) -> DataFrame:
    """The rows with the keys of `wanted`, read from the files that may have them."""
    layout = _layout(spark, root)
    files, lows, _ = _index(spark, root, layout, version)
    hit = _hit_slots(spark, root, layout, files, lows, wanted, False) if files else []
    return _read(spark, root, layout, [files[s] for s in hit]).join(wanted.select(*layout.keys).distinct(), layout.keys, "left_semi")


def edit_table(spark: SparkSession, root: str, touched: DataFrame, change: Callable[[DataFrame], DataFrame], inserts: bool = False) -> Edit:
    """Publish the next version: `change` maps the rows of the files that are hit to the new ones.

    touched: the keys that `change` updates or deletes, or with `inserts` may add; it must leave
    rows of other keys alone. An edit that hits no file publishes nothing.
    """
    layout, version = _layout(spark, root), current_version(spark, root, "index")
    files, lows, rows = _index(spark, root, layout, version)
    if not files and inserts:  # a table without rows has no ranges yet
        hit, lows = [], [()]
    else:
        hit = _hit_slots(spark, root, layout, files, lows, touched, inserts) if files else []
        if not hit:
            return Edit(version, len(files), 0, 0)
    part = f"v{version + 1}"
    changed = _located(change(_read(spark, root, layout, [files[s] for s in hit])).select(*layout.schema.names), layout.keys, lows)
    tasks = _write_tasks([rows[s] for s in hit], layout.file_rows, spark.sparkContext.defaultParallelism)
    ranged = changed.repartitionByRange(tasks, "slot", *layout.keys).sortWithinPartitions("slot", *layout.keys)
    fresh = _write(spark, root, layout, ranged, part)
    gone = spark.createDataFrame([(files[s],) for s in hit], "file string")
    kept = read_version(spark, root, "index", version).join(gone, "file", "left_anti")
    index = kept.unionByName(fresh).coalesce(1)
    published = write_version(spark, root, "index", index)
    written = read_version(spark, root, "index", published).where(F.col("file").startswith(f"{part}/")).count()
    return Edit(published, len(files), len(hit), written)
