"""Session settings and the shared scratch folder."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

# Runtime settings the operators are written for. AQE picks broadcast joins from measured
# sizes, splits hot join partitions and coalesces small ones; forcing the split keeps it
# active where the join's own partitioning would otherwise have been reused downstream.
# Listing named files takes microseconds each, so it is cut into few tasks: by default
# every file up to 10,000 is a task of its own.
RUNTIME = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    "spark.sql.sources.parallelPartitionDiscovery.parallelism": "64",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def configure(spark: SparkSession) -> SparkSession:
    for key, value in RUNTIME.items():
        spark.conf.set(key, value)
    return spark


def scratch_dir(spark: SparkSession, label: str) -> str:
    """A fresh folder under the cluster's shared checkpoint folder.

    Executors must all see it, so a machine-local folder is used only with a local master.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        option = spark.sparkContext._jsc.sc().getCheckpointDir()
        root = option.get() if option.isDefined() else None
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder every executor can reach")
        root = tempfile.mkdtemp(prefix="tallyframe-")
        spark.sparkContext.setCheckpointDir(root)
    return os.path.join(root, f"{label}-{uuid.uuid4().hex}")


def settle(frame: DataFrame, label: str) -> DataFrame:
    """Write a frame to the scratch folder and read it back.

    For intermediate results that several later steps read: they are computed once, the
    lineage ends at files that outlive any executor, and later readers prune columns.
    """
    path = scratch_dir(frame.sparkSession, label)
    frame.write.parquet(path)
    return frame.sparkSession.read.schema(frame.schema).parquet(path)
