"""Equi-joins between ledger tables. Physical strategy is left to the optimiser."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..schemas import FALLBACK_CATEGORY
from .filters import visible_spaces


def summaries_with_accounts(summaries: DataFrame, accounts: DataFrame) -> DataFrame:
    owner = accounts.select(F.col("id").alias("account_id"), F.col("name").alias("account_name"),
                            "space_id")
    return summaries.join(owner, "account_id")


def member_roster(members: DataFrame, users: DataFrame) -> DataFrame:
    people = users.select(F.col("id").alias("user_id"), "name")
    return members.join(people, "user_id").select("space_id", "user_id", "name", "role", "joined_at")


def spaces_of_users(spaces: DataFrame, members: DataFrame) -> DataFrame:
    """Live spaces of every user with the user's role."""
    live = visible_spaces(spaces).select(
        F.col("id").alias("space_id"), "name", "created_at", "updated_at"
    )
    return members.select("space_id", "user_id", "role").join(live, "space_id")


def devices_with_space(devices: DataFrame, spaces: DataFrame) -> DataFrame:
    """Devices whose space still exists (soft-deleted spaces included)."""
    return devices.join(spaces.select(F.col("id").alias("space_id")), "space_id", "left_semi")


def enabled_device_ids(devices: DataFrame) -> DataFrame:
    return devices.where("sync_enabled").select("device_id").distinct()


def keep_matching(rows: DataFrame, keys: DataFrame, on: list[str]) -> DataFrame:
    return rows.join(keys.select(*on), on, "left_semi")


def keep_unmatched(rows: DataFrame, keys: DataFrame, on: list[str]) -> DataFrame:
    return rows.join(keys.select(*on), on, "left_anti")


def peer_progress(devices: DataFrame, cursors: DataFrame) -> DataFrame:
    """Last sequence each device has consumed; -1 when it has no cursor yet."""
    seen = cursors.select("space_id", F.col("peer_device_id").alias("device_id"), "last_seq")
    return devices.select("space_id", "device_id", "sync_enabled").join(
        seen, ["space_id", "device_id"], "left"
    ).withColumn("last_seq", F.coalesce("last_seq", F.lit(-1).cast("bigint")))


def overlay_balances(derived: DataFrame, manual: DataFrame) -> DataFrame:
    """Month-end balances where a manual summary replaces the derived value.

    Both sides have one row per (account, month).
    """
    left = derived.select("account_id", "month", F.col("balance").alias("derived"))
    right = manual.select("account_id", "month", F.col("balance").alias("manual"))
    return left.join(right, ["account_id", "month"], "full_outer").select(
        "account_id", "month", F.coalesce("manual", "derived").alias("balance")
    )


def latest_by_author(log: DataFrame) -> DataFrame:
    """The two authors with the newest entry for each logical row, as `first` and `second`.

    Entries collapse to one per (row, author) with map-side combine before any ranking, so
    a row edited millions of times costs no more than its number of authors.
    """
    newest = log.groupBy("table_name", "row_id", "device_id").agg(
        F.max(F.struct("changed_at", "seq")).alias("top")
    )
    order = Window.partitionBy("table_name", "row_id").orderBy(
        F.col("top.changed_at").desc(), F.col("top.seq").desc(), F.col("device_id").desc()
    )
    entry = F.struct("device_id", "top.changed_at", "top.seq")
    return (
        newest.withColumn("rank", F.row_number().over(order)).where("rank <= 2")
        .groupBy("table_name", "row_id")
        .agg(F.max(F.when(F.col("rank") == 1, entry)).alias("first"),
             F.max(F.when(F.col("rank") == 2, entry)).alias("second"))
    )


def latest_other_author(incoming: DataFrame, log: DataFrame) -> DataFrame:
    """For each incoming change, the newest stored entry of the same row by another device."""
    authors = latest_by_author(log)
    other = F.when(F.col("first.device_id") != F.col("device_id"), F.col("first")).otherwise(
        F.col("second")
    )
    return (
        incoming.join(authors, ["table_name", "row_id"], "left")
        .withColumn("other", other)
        .select(*incoming.columns, F.col("other.device_id").alias("other_device_id"),
                F.col("other.changed_at").alias("other_changed_at"))
    )


def label_positions(classes: DataFrame) -> DataFrame:
    """First position of every class name."""
    return classes.groupBy("name").agg(F.min("position").alias("label"))


def with_label(rows: DataFrame, classes: DataFrame) -> DataFrame:
    """Class position of each row's category, else the position of the fallback class."""
    labels = label_positions(classes)
    fallback = labels.where(F.col("name") == FALLBACK_CATEGORY).agg(F.min("label").alias("_fallback"))
    return (
        rows.join(labels.withColumnRenamed("name", "category"), "category", "left")
        # A global aggregate: exactly one row whatever the data.
        .join(F.broadcast(fallback))
        .withColumn("label", F.coalesce("label", "_fallback")).drop("_fallback")
    )
