"""Compaction and retention of the change log and of what depends on it."""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..schemas import RETENTION_DAYS
from .joins import peer_progress
from .mutate import Tables, drop_spaces


def compact_log(log: DataFrame) -> DataFrame:
    """Keep the highest-seq entry of each logical row.

    The maximum is combined on the map side, so a row with very many entries ships one
    candidate per task.
    """
    keys = ["space_id", "table_name", "row_id"]
    rest = [c for c in log.columns if c not in keys]
    return log.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct("seq", "id")).alias("_top")).select(
        *keys, "_top.*").select(*log.columns)


def consumed_bounds(devices: DataFrame, cursors: DataFrame) -> DataFrame:
    """Per space the sequence that every enabled device has consumed."""
    return peer_progress(devices.where("sync_enabled"), cursors).groupBy("space_id").agg(
        F.min("last_seq").alias("consumed"))


def drop_consumed(log: DataFrame, devices: DataFrame, cursors: DataFrame) -> DataFrame:
    """Drop entries consumed by all enabled devices; a space without any keeps its log."""
    return log.join(consumed_bounds(devices, cursors), "space_id", "left").where(
        "consumed is null or seq > consumed").select(*log.columns)


def retention_cutoff(as_of: str, days: int = RETENTION_DAYS) -> str:
    """Cutoff text `YYYY-MM-DD HH:MM:SS` for an `…T…Z` time."""
    moment = datetime.strptime(as_of, "%Y-%m-%dT%H:%M:%SZ") - timedelta(days=days)
    return moment.strftime("%Y-%m-%d %H:%M:%S")


def cap_retention(log: DataFrame, as_of: str) -> DataFrame:
    """Drop entries older than the retention period, by text comparison.

    Entries are stamped `…T…Z` and the cutoff has a blank in place of the `T`, so entries
    of the boundary day sort after it and survive.
    """
    return log.where(F.col("changed_at") >= retention_cutoff(as_of))


def purge_deleted_spaces(spaces: DataFrame, log: DataFrame) -> DataFrame:
    """Remove soft-deleted spaces whose log is empty."""
    logged = log.select(F.col("space_id").alias("id"), F.lit(True).alias("_logged")).distinct()
    return spaces.join(logged, "id", "left").where("not deleted or _logged").select(*spaces.columns)


def purge_orphan_devices(devices: DataFrame, spaces: DataFrame) -> DataFrame:
    return devices.join(spaces.select(F.col("id").alias("space_id")), "space_id", "left_semi").select(
        *devices.columns)


def purge_orphan_users(users: DataFrame, members: DataFrame) -> DataFrame:
    return users.join(members.select(F.col("user_id").alias("id")), "id", "left_semi").select(
        *users.columns)


def purge_spaces(tables: Tables) -> Tables:
    """Drop soft-deleted spaces whose log is empty, with every row that hangs on them."""
    kept = purge_deleted_spaces(tables["spaces"], tables["change_log"])
    gone = tables["spaces"].join(kept.select("id"), "id", "left_anti").select(F.col("id").alias("space_id"))
    return drop_spaces(tables, gone)


def run_retention(tables: Tables, as_of: str) -> Tables:
    """All passes in their fixed order; each feeds the next."""
    log = compact_log(tables["change_log"])
    log = drop_consumed(log, tables["trusted_devices"], tables["sync_cursors"])
    out = purge_spaces({**tables, "change_log": cap_retention(log, as_of)})
    out["trusted_devices"] = purge_orphan_devices(tables["trusted_devices"], out["spaces"])
    out["users"] = purge_orphan_users(tables["users"], out["space_members"])
    return out
