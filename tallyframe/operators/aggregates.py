"""Counts, sums and bounds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import month_of
from ..schemas import MIN_TRAINING_ROWS
from .filters import approved_labelled, scope_to_space


def category_spend_by_month(transactions: DataFrame, accounts: DataFrame) -> DataFrame:
    """Approved amount per space, month and category; the empty category counts as one.

    Summed per account first, so the join with accounts sees one row per
    (account, month, category) instead of every transaction, whatever an account's size.
    """
    per_account = (
        transactions.where(F.col("approved") & F.col("category").isNotNull())
        .groupBy("account_id", month_of(F.col("value_date")).alias("month"), "category")
        .agg(F.sum("amount").alias("amount"))
    )
    return (
        scope_to_space(per_account, accounts)
        .groupBy("space_id", "month", "category").agg(F.sum("amount").alias("amount"))
    )


def monthly_aggregates(spend: DataFrame, balances: DataFrame) -> DataFrame:
    """Both monthly maps in one long table: space, month, kind, key, value.

    One row per entry rather than one nested map per month, so a large tenant's month
    never has to fit in a single record.
    """
    by_category = spend.select(
        "space_id", "month", F.lit("category").alias("kind"), F.col("category").alias("key"),
        F.col("amount").alias("value"),
    )
    by_account = balances.select(
        "space_id", "month", F.lit("balance").alias("kind"), F.col("account_id").alias("key"),
        F.col("balance").alias("value"),
    )
    return by_category.unionByName(by_account)


def count_by_space(rows: DataFrame, accounts: DataFrame, out: str = "total") -> DataFrame:
    """Rows per space through their account, counted per account before the join."""
    per_account = rows.groupBy("account_id").agg(F.count(F.lit(1)).alias("_n"))
    return scope_to_space(per_account, accounts).groupBy("space_id").agg(F.sum("_n").alias(out))


def count_members(members: DataFrame) -> DataFrame:
    return members.groupBy("space_id").agg(F.count(F.lit(1)).alias("members"))


def count_users(users: DataFrame) -> DataFrame:
    return users.agg(F.count(F.lit(1)).alias("users"))


def count_labelled(transactions: DataFrame, accounts: DataFrame) -> DataFrame:
    """Training rows per space and whether there are enough of them."""
    return count_by_space(approved_labelled(transactions), accounts, "labelled").withColumn(
        "trainable", F.col("labelled") >= MIN_TRAINING_ROWS
    )


def sole_owner_spaces(members: DataFrame, corrected: bool = False) -> DataFrame:
    """Spaces that block the removal of their owner.

    The established rule counts only the user's own membership, so it names every space
    the user owns. With `corrected`, other owners of the space are counted too.
    """
    owners = members.where("role = 'owner'")
    if not corrected:
        return owners.groupBy("user_id", "space_id").agg(F.count(F.lit(1)).alias("_n")).where(
            "_n = 1").select("user_id", "space_id")
    return owners.groupBy("space_id").agg(
        F.count(F.lit(1)).alias("_n"), F.first("user_id").alias("user_id")
    ).where("_n = 1").select("user_id", "space_id")


def seq_bounds(log: DataFrame, requested: DataFrame | None = None) -> DataFrame:
    """Lowest and highest sequence per (space, device); 0 for requested pairs without rows."""
    bounds = log.groupBy("space_id", "device_id").agg(
        F.min("seq").alias("min_seq"), F.max("seq").alias("max_seq")
    )
    if requested is None:
        return bounds
    zero = F.lit(0).cast("bigint")
    return requested.select("space_id", "device_id").distinct().join(
        bounds, ["space_id", "device_id"], "left"
    ).select("space_id", "device_id", F.coalesce("min_seq", zero).alias("min_seq"),
             F.coalesce("max_seq", zero).alias("max_seq"))


def page_count(total: Column, limit: int, at_least_one: bool = False) -> Column:
    pages = F.floor((total + (limit - 1)) / limit).cast("bigint")
    return F.greatest(pages, F.lit(1).cast("bigint")) if at_least_one else pages


def hit_rate(predictions: DataFrame, by: list[str]) -> DataFrame:
    """Correct and total labelled predictions per group."""
    return predictions.groupBy(*by).agg(
        F.count_if(F.col("actual") == F.col("predicted")).alias("correct"),
        F.count(F.lit(1)).alias("total"),
        F.avg((F.col("actual") == F.col("predicted")).cast("double")).alias("rate"),
    )


def distinct_devices(devices: DataFrame) -> DataFrame:
    return devices.select("device_id").distinct()
