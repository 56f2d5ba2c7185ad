"""Imports and their aggregates as streams, and bursts of mutations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.numbering import in_ranges, previous_value, running_total
from ..functions.scalars import month_of
from ..operators.filters import scope_to_space
from ..schemas import QUIET_SECONDS, RETENTION_DAYS


def dedupe_import(parsed: DataFrame) -> DataFrame:
    """First delivery of each content id. Exact; its state grows with the number of ids."""
    return parsed.dropDuplicates(["id"])


def dedupe_recent_import(parsed: DataFrame, time: str, days: int = RETENTION_DAYS) -> DataFrame:
    """First delivery of each id within a period, with state bounded by the period."""
    return parsed.withWatermark(time, f"{days} days").dropDuplicatesWithinWatermark(["id"])


def stream_monthly_spend(transactions: DataFrame, accounts: DataFrame) -> DataFrame:
    """Running category spend, for update mode; Spark combines each batch before its shuffle."""
    counted = transactions.where(F.col("approved") & F.col("category").isNotNull()).withColumn(
        "month", month_of(F.col("value_date")))
    return scope_to_space(counted, accounts).groupBy("space_id", "month", "category").agg(
        F.sum("amount").alias("amount"))


def mutation_bursts(mutations: DataFrame, time: str, key: str, seconds: int = QUIET_SECONDS) -> DataFrame:
    """The bursts of stored mutations, as `bursts.stream_bursts` gives them live, for spaces of any size.

    A mutation starts a burst when the one before it in its space is at least the quiet
    period older. Ranges of the mutations in time order are the buckets, so a busy space is
    spread over as many tasks as its rows fill, and the bursts are numbered by a running count
    of starts.
    """
    order, bucket = [F.col(time), F.col(key)], [F.col("__range")]
    ranged = in_ranges(mutations, ["space_id"], order)
    chained = previous_value(ranged, ["space_id"], bucket, order, F.struct(time), "_before")
    quiet = F.col(f"_before.{time}") + F.expr(f"INTERVAL {seconds} SECONDS") <= F.col(time)
    starts = chained.withColumn("_starts", F.coalesce(quiet, F.lit(True)).cast("bigint"))
    bursts = running_total(starts, ["space_id"], bucket, order, F.col("_starts"), "_burst")
    return bursts.groupBy("space_id", "_burst").agg(
        F.min(time).alias("first_at"),
        (F.max(time) + F.expr(f"INTERVAL {seconds} SECONDS")).alias("fires_at"),
        F.count(F.lit(1)).alias("mutations"),
    ).drop("_burst")
