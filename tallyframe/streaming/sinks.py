"""Idempotent micro-batch output on plain Parquet."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def write_batch(frame: DataFrame, root: str, name: str, batch_id: int) -> None:
    """One directory per micro-batch; a retried batch overwrites its own."""
    frame.write.mode("overwrite").parquet(f"{root}/{name}/batch_id={batch_id}")


def read_batches(spark: SparkSession, root: str, name: str, schema) -> DataFrame:
    """All micro-batches written under `name`, with their `batch_id`."""
    return spark.read.schema(schema).option("basePath", f"{root}/{name}").parquet(f"{root}/{name}")


def run_batches(stream: DataFrame, root: str, handle: Callable[[DataFrame, int], None],
                mode: str = "append", available_now: bool = True) -> StreamingQuery:
    """Start a query that hands each micro-batch to `handle`; its checkpoint lives under `root`."""
    writer = stream.writeStream.outputMode(mode).option("checkpointLocation", f"{root}/_checkpoint")
    writer = writer.foreachBatch(handle)
    if available_now:
        writer = writer.trigger(availableNow=True)
    return writer.start()


def append_stream(stream: DataFrame, root: str, available_now: bool = True) -> StreamingQuery:
    """Plain append output to `root/rows` through the exactly-once file sink."""
    writer = stream.writeStream.outputMode("append").format("parquet").option("path", f"{root}/rows")
    writer = writer.option("checkpointLocation", f"{root}/_checkpoint")
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def latest_values(batches: DataFrame, keys: list[str]) -> DataFrame:
    """Current value of each key of an update-mode stream: that of its last micro-batch."""
    values = [c for c in batches.columns if c not in (*keys, "batch_id")]
    return batches.groupBy(*keys).agg(
        F.max_by(F.struct(*values), "batch_id").alias("_v")).select(*keys, "_v.*")
