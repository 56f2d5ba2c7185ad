"""Statement files to cell rows or whole texts."""

from __future__ import annotations

import csv
import io
import re
from collections.abc import Iterator
from functools import reduce
from itertools import groupby
from urllib.parse import quote, unquote

import pandas as pd
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import settle

CELLS = "file string, row_idx long, cells array<string>"
_SLICE = 20_000
_ENTRY = "file string, folder boolean, size long"
_ENTRY_ARROW = pa.schema([("file", pa.string()), ("folder", pa.bool_()), ("size", pa.int64())])
#: Characters that Spark doesn't leave as they are in a file's name.
_QUOTED = re.compile(r"[^A-Za-z0-9_!.~'()*,;:$&+=@\u0080-\U0010ffff-]")
#: Characters with a meaning in a path that Spark reads.
_ACTIVE = re.compile(r"[\[\]{}*?\\,^]")
_COMPRESSED, _ONLY_SPARK = {"gz": "gzip", "bz2": "bz2", "zst": "zstd"}, ("deflate", "snappy", "lz4")
_TASK_BYTES, _BATCH_BYTES = 128 << 20, 8 << 20


def csv_cells(files: DataFrame) -> DataFrame:
    """(file, content) rows to (file, row_idx, cells): fields trimmed, blank lines skipped,
    rows may be ragged.

    Quoted line breaks make a file unsplittable, so one task reads one file; different
    files spread over all tasks. Rows leave in slices, so a big file is never held twice.
    """

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for file, content in zip(batch["file"], batch["content"]):
                reader = csv.reader(io.StringIO(bytes(content).decode("utf-8-sig"), newline=""))
                rows: list[tuple[str, int, list[str]]] = []
                index = 0
                for cells in reader:
                    if not cells:
                        continue
                    rows.append((file, index, [c.strip() for c in cells]))
                    index += 1
                    if len(rows) == _SLICE:
                        yield pd.DataFrame(rows, columns=["file", "row_idx", "cells"])
                        rows = []
                if rows:
                    yield pd.DataFrame(rows, columns=["file", "row_idx", "cells"])

    return files.select("file", "content").mapInPandas(parse, CELLS)


def read_statement_csv(spark: SparkSession, path: str) -> DataFrame:
    files = spark.read.format("binaryFile").load(path)
    return csv_cells(files.select(F.col("path").alias("file"), "content"))


def write_statement_text(files: DataFrame, path: str) -> None:
    """Write (file, text) rows as one text file for each name, `path/task=K/NAME.txt`.

    Every row is a line, a missing text an empty one, and rows of one name share its file. Opening a
    file is the work here, so files spread over all tasks by name, and Spark's writer, which takes
    several steps of the file system for each, stays out of it. A retried task writes its files anew.
    """
    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = fs.FileSystem.from_uri(path)
        folder, n = f"{root}/task={TaskContext.get().partitionId():05d}", 0
        store.create_dir(folder)
        rows = ((f, t) for b in batches for f, t in zip(b.column("file").to_pylist(), b.column("text").to_pylist()))
        for file, own in groupby(rows, lambda r: r[0]):
            with store.open_output_stream(f"{folder}/{file}.txt") as out:
                for _, text in own:
                    out.write((text or "").encode() + b"\n")
            n += 1
        yield pa.RecordBatch.from_pydict({"written": [n]})

    tasks = int(files.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = files.select("file", "text").repartition(tasks, "file").sortWithinPartitions("file")
    dealt.mapInArrow(write, "written long").write.format("noop").mode("overwrite").save()


def read_statement_text(spark: SparkSession, path: str) -> DataFrame:
    """Already extracted statement text, one row per file.

    Spark's reader lists every file on the driver; here tasks list the folders, level by level, and read the
    files, so the driver holds what `path` names itself and no more. What counts as a file is the
    reader's rule: hidden and empty files don't, and of folders only those named `key=value` are entered.
    Files of Hadoop's own compressions, should there be any, are left to Spark's reader.
    """
    roots = _roots(spark, path)
    if not roots:
        return _read_by_spark(spark, path)  # raises as any reader would
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    found, folders, left = [], spark.createDataFrame(roots, _ENTRY).coalesce(1), len(roots)
    while left:
        level = settle(folders.repartition(min(left, tasks)).mapInArrow(_listed, _ENTRY), "listed")
        found.append(level.where("NOT folder"))
        folders = level.where("folder")
        left = folders.count()
    files = reduce(DataFrame.unionByName, found)
    odd = F.substring_index("file", ".", -1).isin(*_ONLY_SPARK)
    rare = [_ACTIVE.sub(r"\\\g<0>", unquote(r.file)) for r in files.where(odd).collect()]
    files = files.where(~odd)
    size = files.agg(F.sum("size")).first()[0] or 0
    dealt = files.select("file").repartition(max(tasks, -(-size // _TASK_BYTES)), "file")
    texts = dealt.mapInArrow(_texts, "file string, text binary").select("file", F.col("text").cast("string").alias("text"))
    return texts.unionByName(_read_by_spark(spark, rare)) if rare else texts


def _read_by_spark(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    return spark.read.text(paths, wholetext=True).select(F.col("_metadata.file_path").alias("file"), F.col("value").alias("text"))


def _roots(spark: SparkSession, path: str) -> list[tuple[str, bool, int]]:
    """The folders and files that a path, which may be a pattern, stands for."""
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    out = []
    for status in at.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).globStatus(at) or []:
        uri = status.getPath().toUri()
        host = f"//{uri.getAuthority()}" if uri.getAuthority() else ""
        out.append((f"{uri.getScheme()}:{host}{uri.getRawPath()}", status.isDirectory(), status.getLen()))
    return out


class _Stores(dict):
    """The file system of each root that files named by Spark (`file:/folder/name`) lie under."""

    def __missing__(self, root: str) -> tuple[fs.FileSystem, str]:
        self[root] = fs.FileSystem.from_uri(f"{root}/")
        return self[root]

    def find(self, file: str) -> tuple[fs.FileSystem, str]:
        scheme, rest = file.split(":", 1)
        host, path = rest[2:].split("/", 1) if rest.startswith("//") else ("", rest[1:])
        store, base = self[f"{scheme}://{host}"]
        return store, f"{base.rstrip('/')}/{unquote(path)}"


def _listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """What lies in each folder; a file is left as it is."""
    stores = _Stores()
    for batch in batches:
        for row in batch.to_pylist():
            out = [row]
            if row["folder"]:
                store, folder = stores.find(row["file"])
                out = []
                for info in store.get_file_info(fs.FileSelector(folder)):
                    name, is_folder = info.base_name, info.type == fs.FileType.Directory
                    if name.startswith(".") or name.endswith("._COPYING_") or name.startswith("_") and "=" not in name:
                        continue
                    if "=" in name if is_folder else info.size:
                        out.append({"file": f"{row['file'].rstrip('/')}/{_QUOTED.sub(lambda c: quote(c[0]), name)}", "folder": is_folder, "size": info.size or 0})
            for at in range(0, len(out), _SLICE):
                yield pa.RecordBatch.from_pylist(out[at: at + _SLICE], _ENTRY_ARROW)


def _texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names, texts, size, stores = [], [], 0, _Stores()

    def made() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(texts, pa.binary())], names=["file", "text"])

    for batch in batches:
        for file in batch.column("file").to_pylist():
            store, at = stores.find(file)
            with store.open_input_stream(at, compression=_COMPRESSED.get(file.rsplit(".", 1)[-1])) as held:
                texts.append(held.read())
            names.append(file)
            size += len(texts[-1])
            if size >= _BATCH_BYTES or len(names) == _SLICE:
                yield made()
                names, texts, size = [], [], 0
    yield made()
