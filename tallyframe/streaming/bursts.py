"""The live quiet period: bursts of mutations per space, from keyed state with event-time timers.

A mutation starts a burst when the one before it in its space is at least the quiet period
older; the burst fires at its last mutation plus the period. State holds the bursts of a space
that may still grow: those whose firing time lies beyond the watermark. Rows may come in any
order within the watermark's delay; one that falls between two open bursts joins them. So the
state of a space is at most delay / period bursts, whatever the number of its mutations.

Mutations of one space and instant are counted before the shuffle, within each Arrow batch.
State lives in RocksDB, off the heap and in incremental checkpoints.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from ..schemas import QUIET_SECONDS
from .sinks import append_stream

_PROVIDER = ("spark.sql.streaming.stateStore.providerClass",
             "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
_OPEN = "starts array<long>, ends array<long>, counts array<long>, due long"
_FIRED = "space_id string, first_at long, fires_at long, mutations long"


@contextmanager
def rocksdb(spark: SparkSession):
    """Queries started inside keep their state in RocksDB; the session's own setting comes back."""
    key, provider = _PROVIDER
    before = spark.conf.get(key, None)
    spark.conf.set(key, provider)
    try:
        yield
    finally:
        spark.conf.set(key, before) if before else spark.conf.unset(key)


def joined(starts: np.ndarray, ends: np.ndarray, counts: np.ndarray, period: int):
    """Bursts from pieces (first and last instant, mutations) in any order: gaps below the period close up."""
    if not len(starts):
        return starts, ends, counts
    order = np.argsort(starts, kind="stable")
    starts, ends, counts = starts[order], np.maximum.accumulate(ends[order]), counts[order]
    first = np.flatnonzero(np.r_[True, starts[1:] - ends[:-1] >= period])
    last = np.r_[first[1:], len(starts)] - 1
    return starts[first], ends[last], np.add.reduceat(counts, first)


class QuietPeriod(StatefulProcessor):
    """Open bursts of a space; instants and the period are in microseconds."""

    def __init__(self, period: int):
        self.period = period

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.open = handle.getValueState("open", _OPEN)

    def _held(self):
        kept = self.open.get() if self.open.exists() else ([], [], [], None)
        return [np.array(x, np.int64) for x in kept[:3]], kept[3]

    def _keep(self, key: tuple, bursts, due: int | None, watermark: int) -> pd.DataFrame:
        """Fire what the watermark has reached, keep the rest, and have a timer for the next."""
        starts, ends, counts = bursts
        fired = ends + self.period <= watermark * 1000
        stay = ~fired
        if stay.any():
            # a timer is due at its millisecond or before the burst's microsecond; it is set anew if that was early
            soonest = -(-int(ends[stay].min() + self.period) // 1000)
            if due is None or due <= watermark or soonest < due:
                self.handle.registerTimer(soonest)
                due = soonest
            self.open.update((starts[stay].tolist(), ends[stay].tolist(), counts[stay].tolist(), due))
        else:
            self.open.clear()
        return pd.DataFrame({"space_id": pd.Series([key[0]] * int(fired.sum()), dtype=object), "first_at": starts[fired],
                             "fires_at": ends[fired] + self.period, "mutations": counts[fired]})

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        bursts, due = self._held()
        for frame in rows:
            at = frame["micros"].to_numpy(np.int64)
            pieces = zip(bursts, (at, at, frame["mutations"].to_numpy(np.int64)))
            bursts = joined(*[np.concatenate(p) for p in pieces], self.period)
        yield self._keep(key, bursts, due, timerValues.getCurrentWatermarkInMs())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        bursts, _ = self._held()
        yield self._keep(key, bursts, None, timerValues.getCurrentWatermarkInMs())


def _counted(batches):
    """Mutations of each space and instant of an Arrow batch."""
    for batch in batches:
        table = pa.Table.from_batches([batch]).group_by(["space_id", "at"]).aggregate([([], "count_all")])
        yield from table.rename_columns(["space_id", "at", "mutations"]).to_batches()


def stream_bursts(mutations: DataFrame, time: str, seconds: int = QUIET_SECONDS, delay: str = "1 hour") -> DataFrame:
    """(space_id, first_at, fires_at, mutations) of every burst, once the watermark passes its firing time.

    mutations: space_id and the timestamp `time`. Rows behind the watermark are dropped, as are
    rows without a time; rows without a space are a space of their own. Start the query inside
    `rocksdb`, or with `start_bursts`.
    """
    slim = mutations.select(F.col("space_id").cast("string").alias("space_id"), F.col(time).cast("timestamp").alias("at")).where("at IS NOT NULL")
    counted = slim.mapInArrow(_counted, "space_id string, at timestamp, mutations long")
    timed = counted.withWatermark("at", delay).withColumn("micros", F.unix_micros("at"))
    fired = timed.groupBy("space_id").transformWithStateInPandas(QuietPeriod(seconds * 1_000_000), _FIRED, "append", "EventTime")
    return fired.select("space_id", F.timestamp_micros("first_at").alias("first_at"),
                        F.timestamp_micros("fires_at").alias("fires_at"), "mutations")


def start_bursts(mutations: DataFrame, root: str, time: str, seconds: int = QUIET_SECONDS, delay: str = "1 hour",
                 available_now: bool = True) -> StreamingQuery:
    """Write the bursts of a stream to `root/rows`, exactly once."""
    with rocksdb(mutations.sparkSession):
        return append_stream(stream_bursts(mutations, time, seconds, delay), root, available_now)
