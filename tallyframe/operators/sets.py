"""Set operations."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def known_devices(trusted: DataFrame, evicted: DataFrame) -> DataFrame:
    """Distinct union of active and revoked devices."""
    columns = ["space_id", "device_id", "cert_pem"]
    return trusted.select(*columns).unionByName(evicted.select(*columns)).distinct()


def missing_versions(wanted: DataFrame, held: DataFrame) -> DataFrame:
    """Model versions one side has and the other lacks."""
    keys = ["space_id", "version"]
    return wanted.join(held.select(*keys), keys, "left_anti")


def month_spine(*series: DataFrame) -> DataFrame:
    """Distinct (space, month) pairs present in any of the inputs.

    Each input is reduced on its own first, so the union carries months, not rows.
    """
    reduced = [s.select("space_id", "month").distinct() for s in series]
    return reduce(DataFrame.unionByName, reduced).distinct()


def month_list(spine: DataFrame) -> DataFrame:
    """Sorted months of each space as one array. Its length is bounded by the calendar."""
    return spine.groupBy("space_id").agg(F.sort_array(F.collect_set("month")).alias("months"))
