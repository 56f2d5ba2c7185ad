"""Durable table versions on plain Parquet.

Each write goes to a new directory; a pointer row published afterwards makes it current.
Readers follow the pointers, so they see the old version or the new one, never a part.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.errors import AnalysisException

_POINTER = "table_name string, version long"


def _pointers(spark: SparkSession, root: str) -> DataFrame:
    try:
        return spark.read.schema(_POINTER).parquet(f"{root}/_pointers")
    except AnalysisException as missing:
        if missing.getCondition() == "PATH_NOT_FOUND":
            return spark.createDataFrame([], _POINTER)
        raise


def current_version(spark: SparkSession, root: str, table: str) -> int:
    """Highest published version of a table; 0 before the first."""
    row = _pointers(spark, root).where(F.col("table_name") == table).agg(F.max("version")).first()
    return row[0] or 0


def write_versions(spark: SparkSession, root: str, tables: dict[str, DataFrame],
                   cluster_by: dict[str, list[str]] | None = None) -> dict[str, int]:
    """Write the next version of several tables, then publish all of them with one pointer file.

    `cluster_by` names the columns whose ranges the files should follow, for pruning.
    A second writer of the same version fails on the existing directory.
    """
    published = {}
    for name, frame in tables.items():
        version = current_version(spark, root, name) + 1
        keys = (cluster_by or {}).get(name)
        if keys:
            frame = frame.repartitionByRange(*keys).sortWithinPartitions(*keys)
        frame.write.mode("errorifexists").parquet(f"{root}/{name}/v{version}")
        published[name] = version
    pointer = spark.createDataFrame(list(published.items()), _POINTER).coalesce(1)
    pointer.write.mode("append").parquet(f"{root}/_pointers")
    return published


def write_version(spark: SparkSession, root: str, table: str, frame: DataFrame,
                  cluster_by: list[str] | None = None) -> int:
    return write_versions(spark, root, {table: frame}, {table: cluster_by} if cluster_by else None)[table]


def read_version(spark: SparkSession, root: str, table: str, version: int | None = None) -> DataFrame:
    wanted = version or current_version(spark, root, table)
    if not wanted:
        raise ValueError(f"no version of {table} under {root}")
    return spark.read.parquet(f"{root}/{table}/v{wanted}")
