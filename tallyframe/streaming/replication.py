"""Applying a stream of change-log rows, and watching it for conflicts."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from ..functions.scalars import iso_epoch
from ..operators.aggregates import seq_bounds
from ..operators.mutate import Tables
from ..operators.replicate import (
    advance_cursors, apply_changes, detect_conflicts, plan_from_bounds, validate_changes,
)
from ..schemas import CHANGE_LOG, CONFLICT_TOLERANCE_SECONDS, LONG, RETENTION_DAYS, TEXT
from ..sources import keyed_files
from . import fold
from .bursts import rocksdb
from .sinks import append_stream, read_batches, run_batches, write_batch

_APPLIED = T.StructType([*CHANGE_LOG.fields, T.StructField("batch_id", LONG)])
_BOUNDS = "space_id string, device_id string, min_seq long, max_seq long"
_COMMIT = "space_id string, device_id string, max_seq long, batch_id long"
_REJECT = T.StructType([*CHANGE_LOG.fields, T.StructField("reason", TEXT), T.StructField("batch_id", LONG)])
CONFLICT_COLUMNS = ["space_id", "table_name", "row_id", "seq", "field", "local_value", "remote_value",
                    "local_changed_at", "remote_changed_at"]


# ---- incremental apply --------------------------------------------------------------
def current_tables(spark: SparkSession, root: str, base: Tables) -> Tables:
    """The tables as the committed batches left them: the folded base with the open runs over it.

    Tables with rules of their own are taken from `base` and get all their committed changes.
    """
    state = fold.newest_state(spark, root)
    runs = fold.open_changes(spark, root, state)
    plain = {n: keyed_files.read_table(spark, f"{root}/base/{n}") for n in fold.PLAIN if n in base}
    out = apply_changes(plain, runs)
    others = {n: t for n, t in base.items() if n not in plain}
    if others:
        done = read_batches(spark, root, "commits", _COMMIT).select("batch_id").distinct()
        rows = read_batches(spark, root, "runs/l0", _APPLIED).where(~F.col("table_name").isin(fold.PLAIN))
        out = {**out, **apply_changes(others, rows.join(done, "batch_id", "left_semi").withColumnRenamed("batch_id", "batch_no"))}
    return out


def current_cursors(spark: SparkSession, root: str, cursors: DataFrame) -> DataFrame:
    """Cursors advance with the commit itself, so data and cursor move together."""
    return advance_cursors(cursors, read_batches(spark, root, "commits", _COMMIT).drop("batch_id"))


def rejected_changes(spark: SparkSession, root: str) -> DataFrame:
    return read_batches(spark, root, "rejects", _REJECT)


def recorded_conflicts(spark: SparkSession, root: str) -> DataFrame:
    schema = ", ".join(f"{c} {'long' if c == 'seq' else 'string'}" for c in CONFLICT_COLUMNS)
    return read_batches(spark, root, "conflicts", f"{schema}, batch_id long")


def start_apply(changes: DataFrame, root: str, base: Tables, local_log: DataFrame,
                available_now: bool = True, tolerance: int | None = None, fan: int = fold.FAN) -> StreamingQuery:
    """Validate, compare, record and commit each micro-batch.

    The tables are not rewritten per batch: accepted changes are runs of a log-structured fold
    (see `fold`), and a batch reads only the rows that it touches, from the base and the open
    runs. The commit, holding the reached sequence per device, and the fold's state are written
    last; what a failed attempt left behind is overwritten by the retry.
    """
    fold.create_base(changes.sparkSession, root, base, local_log)

    def handle(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        rows = batch.persist()
        try:
            valid, rejects = validate_changes(rows)
            write_batch(rejects, root, "rejects", batch_id)
            state = fold.state_before(spark, root, batch_id)
            incoming = valid.withColumn("batch_no", F.lit(batch_id))
            if "transactions" in base:
                touched = valid.where("table_name = 'transactions'").select(F.col("row_id").alias("id")).distinct()
                local, log = fold.rows_before(spark, root, state, touched, "transactions")
                found = detect_conflicts(incoming, local["transactions"], log, tolerance)
                write_batch(found.select(*CONFLICT_COLUMNS), root, "conflicts", batch_id)
            reached = seq_bounds(rows).select("space_id", "device_id", "max_seq")
            write_batch(reached.coalesce(1), root, "commits", batch_id)
            fold.advance(spark, root, batch_id, state, valid, fan)
        finally:
            rows.unpersist()

    return run_batches(changes, root, handle, available_now=available_now)


# ---- conflicts as a stateful operator ----------------------------------------------
_STATE = ("present boolean, category string, note string, devices array<string>, times array<string>, seqs array<long>, "
          "epochs array<long>")
_EVENT = ["space_id", "row_id", "seq", "device_id", "operation", "category", "note", "changed_at", "epoch"]
_FOUND = ("space_id string, row_id string, seq long, field string, local_value string, "
          "remote_value string, local_changed_at string, remote_changed_at string")
_FOUND_NAMES = [c.split()[0] for c in _FOUND.split(", ")]


def replay(state: tuple | None, rows: pd.DataFrame, tolerance: int) -> tuple[tuple, pd.DataFrame]:
    """Take a row's changes, in the order of seq, through its state: the new state, and the conflicts.

    The state is the row's current category and note and the newest entries of its two newest
    authors, enough to know the newest entry by anyone else. A change conflicts if the row was
    there and another author's newest entry before it lies within the tolerance. Works on whole
    columns, once for each author.
    """
    present, category, note, *kept = state or (False, None, None, [], [], [], [])
    rows = rows.sort_values("seq", kind="stable").astype(object)
    rows = rows.where(rows.notna(), None)
    n, old = len(rows), len(kept[0])
    device, at, seq, epoch = (np.array([*k, *rows[c]], object) for k, c in zip(kept, ("device_id", "changed_at", "seq", "epoch")))
    # places of all entries in the order of (changed_at, seq), the state's first
    rank = np.empty(old + n, np.int64)
    rank[np.lexsort((seq.astype(np.int64), at.astype(str)))] = np.arange(old + n)
    other = np.full(n, -1)
    for author in pd.unique(device[old:]):
        best = np.maximum.accumulate(np.where(device == author, -1, rank))
        mine = np.flatnonzero(device[old:] == author)
        earlier = old + mine - 1
        other[mine] = np.where(earlier >= 0, best[np.maximum(earlier, 0)], -1)
    entry = np.empty(old + n, np.int64)
    entry[rank] = np.arange(old + n)
    live = (rows["operation"] != "delete").to_numpy(bool)
    was = np.r_[bool(present), live[:-1]]
    moment = np.array([np.nan if e is None else e for e in epoch], float)
    with np.errstate(invalid="ignore"):
        near = (other >= 0) & (np.abs(moment[entry[other]] - moment[old:]) <= tolerance)
    hit = np.flatnonzero(live & was & near)
    found = []
    for field, before in (("category", category), ("note", note)):
        values = np.array([before, *rows[field].where(live, None)], object)
        own = hit[values[hit] != values[hit + 1]]
        picked = rows.iloc[own]
        found.append(pd.DataFrame({
            "space_id": picked["space_id"], "row_id": picked["row_id"], "seq": picked["seq"], "field": field,
            "local_value": values[own], "remote_value": values[own + 1], "local_changed_at": at[entry[other[own]]],
            "remote_changed_at": picked["changed_at"]}, columns=_FOUND_NAMES, dtype=object))
    newest = pd.DataFrame({"device": device, "rank": rank}).groupby("device", sort=False)["rank"].max().nlargest(2)
    top = entry[newest.to_numpy()]
    last = rows.iloc[-1]
    state = (bool(live[-1]), last["category"] if live[-1] else None, last["note"] if live[-1] else None,
             *[[None if v is None or v != v else v for v in x[top]] for x in (device, at, seq, epoch)])
    return state, pd.concat(found).sort_values("seq", kind="stable")


class RowConflicts(StatefulProcessor):
    """State of one logical row."""

    def __init__(self, tolerance: int):
        self.tolerance = tolerance

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.row = handle.getValueState("row", _STATE)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        state, found = replay(self.row.get() if self.row.exists() else None, pd.concat(list(rows)), self.tolerance)
        self.row.update(tuple(state))
        yield found.astype({"seq": "int64"})


def stream_conflicts(changes: DataFrame, tolerance: int = CONFLICT_TOLERANCE_SECONDS) -> DataFrame:
    """Conflicts between consecutive edits of a row by different devices, on a live log.

    State is kept per (space, row) and is a few values. A key's rows of one micro-batch are put in
    sequence order together; the trigger bounds how many those can be. Start the query inside
    `bursts.rocksdb`.
    """
    decoded = changes.where("table_name = 'transactions'").withColumn(
        "row", F.from_json("payload", "category string, note string")
    ).withColumns({"category": F.col("row.category"), "note": F.col("row.note"),
                   "epoch": iso_epoch(F.col("changed_at"))}).select(*_EVENT)
    return decoded.groupBy("space_id", "row_id").transformWithStateInPandas(
        RowConflicts(tolerance), _FOUND, "append", "None")


def start_conflicts(changes: DataFrame, root: str, tolerance: int = CONFLICT_TOLERANCE_SECONDS,
                    available_now: bool = True) -> StreamingQuery:
    """Write the conflicts of a stream to `root/rows`, exactly once."""
    with rocksdb(changes.sparkSession):
        return append_stream(stream_conflicts(changes, tolerance), root, available_now)


# ---- high water and late rows -------------------------------------------------------
def stream_high_water(changes: DataFrame) -> DataFrame:
    """Highest sequence per (space, device), for update mode."""
    return changes.groupBy("space_id", "device_id").agg(F.max("seq").alias("max_seq"))


def timely_rows(changes: DataFrame, days: int = RETENTION_DAYS) -> DataFrame:
    """Each change once; rows older than the retention period behind the newest are dropped.

    The watermark that drops them also bounds the state of the de-duplication. Spark judges
    a micro-batch by the watermark of the one before it, so a row is late from the second
    batch after the newer ones arrived.
    """
    return (
        changes.withColumn("event_time", F.timestamp_seconds(iso_epoch(F.col("changed_at"))))
        .withWatermark("event_time", f"{days} days")
        .dropDuplicatesWithinWatermark(["space_id", "id"])
    )


def start_late_rows(changes: DataFrame, root: str, cursors: DataFrame, days: int = RETENTION_DAYS,
                    available_now: bool = True) -> StreamingQuery:
    """Keep timely rows; per micro-batch note the reached sequence and who needs a snapshot.

    A commit carries the bounds of all that is kept so far, so a batch reads the commit before it
    and none of the kept rows. The plan looks at those bounds and at the cursors as the batches
    before this one left them.
    """
    pair = ["space_id", "device_id"]

    def handle(batch: DataFrame, batch_id: int) -> None:
        spark, rows = batch.sparkSession, batch.persist()
        try:
            write_batch(rows.drop("event_time"), root, "changes", batch_id)
            bounds, reached = seq_bounds(rows), cursors
            if batch_id > 0:
                before = spark.read.schema(_BOUNDS).parquet(f"{root}/commits/batch_id={batch_id - 1}")
                reached = advance_cursors(cursors, before.select(*pair, "max_seq"))
                bounds = before.unionByName(bounds.select(*before.columns)).groupBy(*pair).agg(
                    F.min("min_seq").alias("min_seq"), F.max("max_seq").alias("max_seq"))
            plan = plan_from_bounds(bounds, reached).where("mode = 'snapshot'")
            write_batch(plan, root, "snapshots", batch_id)
            write_batch(bounds.select(*pair, "min_seq", "max_seq").coalesce(1), root, "commits", batch_id)
        finally:
            rows.unpersist()

    return run_batches(timely_rows(changes, days), root, handle, available_now=available_now)


def snapshot_plans(spark: SparkSession, root: str) -> DataFrame:
    """Who needed a snapshot, by batch."""
    return spark.read.option("basePath", f"{root}/snapshots").parquet(f"{root}/snapshots")


def kept_rows(spark: SparkSession, root: str) -> DataFrame:
    return read_batches(spark, root, "changes", _APPLIED).drop("batch_id")
