"""Monthly series of the dashboard.

Rows are reduced to one per (account, month) before anything is ordered, so every window
below runs over at most the number of calendar months of one account or one space.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import month_of
from ..schemas import FALLBACK_COLOR
from .filters import scope_to_space
from .joins import overlay_balances
from .sets import month_list

BALANCE_ACCOUNT_TYPES = ["checking", "savings"]


def _balance_rows(transactions: DataFrame, accounts: DataFrame) -> DataFrame:
    tracked = accounts.where(F.col("account_type").isin(BALANCE_ACCOUNT_TYPES))
    dated = transactions.withColumn("month", month_of(F.col("value_date")))
    return dated.join(tracked.select(F.col("id").alias("account_id")), "account_id", "left_semi")


def month_end_rows(transactions: DataFrame, accounts: DataFrame) -> DataFrame:
    """Every row on the last date of its account's month; several rows can tie.

    The last date is found by a combining aggregate and joined back, instead of a window
    that would sort a whole account-month in one task.
    """
    rows = _balance_rows(transactions, accounts).select("account_id", "month", "value_date", "balance")
    last = rows.groupBy("account_id", "month").agg(F.max("value_date").alias("value_date"))
    tied = rows.join(last, ["account_id", "month", "value_date"], "left_semi")
    return scope_to_space(tied, accounts).select("space_id", "month", "account_id", "balance")


def month_end_balance(transactions: DataFrame, accounts: DataFrame) -> DataFrame:
    """One balance per (account, month): the last row by value date, booking date and id."""
    best = _balance_rows(transactions, accounts).groupBy("account_id", "month").agg(
        F.max_by("balance", F.struct("value_date", "booking_date", "id")).alias("balance")
    )
    return best


def account_balances(transactions: DataFrame, accounts: DataFrame, summaries: DataFrame) -> DataFrame:
    """Month-end balance per account with manual summaries laid over it, per space."""
    return scope_to_space(
        overlay_balances(month_end_balance(transactions, accounts), summaries), accounts
    ).select("space_id", "account_id", "month", "balance")


def net_worth_series(balances: DataFrame, *others: DataFrame) -> DataFrame:
    """Sum over a space's accounts of the last known balance, for each month with data.

    The months are those of `balances` and of the other monthly frames (spend). Carrying
    every account through every month would build an accounts x months grid. The same
    total is the running sum of balance *changes*: an account's first value counts in full
    and later values count as their difference to the one before. Months of the other
    frames join as changes of zero, so each input is read once and nothing is joined.
    """
    per_account = Window.partitionBy("space_id", "account_id").orderBy("month")
    change = F.col("balance") - F.coalesce(F.lag("balance").over(per_account), F.lit(0))
    changes = balances.select("space_id", "month", change.alias("change"))
    for other in others:
        changes = changes.unionByName(
            other.select("space_id", "month").distinct().withColumn("change", F.lit(0).cast("bigint")))
    running = (
        Window.partitionBy("space_id").orderBy("month")
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    return changes.groupBy("space_id", "month").agg(F.sum("change").alias("change")).select(
        "space_id", "month", F.sum("change").over(running).alias("value"))


def _by_month(descending: bool = False):
    return Window.partitionBy("space_id").orderBy(F.desc("month") if descending else F.asc("month"))


def net_worth_latest_delta(series: DataFrame) -> DataFrame:
    """Latest value per space and its change from the month before (0 without one)."""
    value = F.col("value")
    return (
        series.withColumn("delta", value - F.coalesce(F.lag("value").over(_by_month()), value))
        .withColumn("_rank", F.row_number().over(_by_month(True))).where("_rank = 1")
        .select("space_id", "month", F.col("value").alias("latest"), "delta")
    )


def trailing_months(series: DataFrame, months: int = 12) -> DataFrame:
    """Rows of the last `months` months of each space."""
    return series.withColumn("_rank", F.dense_rank().over(_by_month(True))).where(
        F.col("_rank") <= months).drop("_rank")


def cash_flow(series: DataFrame) -> DataFrame:
    """Month-over-month change of net worth, 0 in the first month, last twelve months."""
    value = F.col("value")
    deltas = series.select(
        "space_id", "month",
        (value - F.coalesce(F.lag("value").over(_by_month()), value)).alias("net"),
    )
    return trailing_months(deltas)


def carry_forward(balances: DataFrame, accounts: DataFrame, spine: DataFrame,
                  zero_is_missing: bool) -> DataFrame:
    """Value of every account in every month of its space's spine.

    An observation holds from its month until the account's next one, so it expands to
    exactly the spine months in between; nothing is joined per month. Months before the
    first observation are 0. With `zero_is_missing`, a zero balance is no observation.
    """
    seen = balances.where("balance <> 0") if zero_is_missing else balances
    start = accounts.select("space_id", F.col("id").alias("account_id"), F.lit("").alias("month"),
                            F.lit(0).cast("bigint").alias("balance"))
    marks = seen.select("space_id", "account_id", "month", "balance").unionByName(start)
    following = F.lead("month").over(Window.partitionBy("space_id", "account_id").orderBy("month"))
    spans = marks.withColumn("_until", following)
    covered = F.filter(
        "months", lambda m: (m >= F.col("month")) & (F.col("_until").isNull() | (m < F.col("_until")))
    )
    return spans.join(month_list(spine), "space_id").select(
        "space_id", "account_id", F.explode(covered).alias("month"), F.col("balance").alias("value")
    )


def account_history(balances: DataFrame, accounts: DataFrame, spine: DataFrame) -> DataFrame:
    """Account sparkline: a zero month repeats the last non-zero value."""
    return carry_forward(balances, accounts, spine, zero_is_missing=True)


def account_latest(balances: DataFrame, accounts: DataFrame) -> DataFrame:
    """Last value of each account's history, without building the history."""
    last = balances.where("balance <> 0").groupBy("account_id").agg(
        F.max_by("balance", "month").alias("latest"))
    return accounts.select("space_id", F.col("id").alias("account_id")).join(
        last, "account_id", "left"
    ).select("space_id", "account_id", F.coalesce("latest", F.lit(0)).cast("bigint").alias("latest"))


def allocation_series(balances: DataFrame, accounts: DataFrame, spine: DataFrame) -> DataFrame:
    """Value of each account per month where a zero balance is a value of its own."""
    return carry_forward(balances, accounts, spine, zero_is_missing=False)


def allocation_share(balances: DataFrame) -> DataFrame:
    """Share of each account with a positive latest value in its space's positive total."""
    latest = balances.groupBy("space_id", "account_id").agg(
        F.max_by("balance", "month").alias("value")).where("value > 0")
    totals = latest.groupBy("space_id").agg(F.sum("value").alias("total"))
    return latest.join(totals, "space_id").select(
        "space_id", "account_id", "value", (F.col("value") / F.col("total")).alias("share")
    )


def spending_series(spend: DataFrame, spine: DataFrame) -> DataFrame:
    """Dense month x category grid of the last twelve months, absolute sums, zero-filled."""
    window = trailing_months(spine)
    recent = spend.join(window, ["space_id", "month"])
    categories = recent.select("space_id", "category").distinct()
    grid = categories.join(month_list(window), "space_id").select(
        "space_id", "category", F.explode("months").alias("month"))
    return grid.join(recent, ["space_id", "month", "category"], "left").select(
        "space_id", "month", "category",
        F.abs(F.coalesce("amount", F.lit(0).cast("bigint"))).alias("value"),
    )


def spending_wide(series: DataFrame, categories: list[str]) -> DataFrame:
    """One column per named category."""
    return series.groupBy("space_id", "month").pivot("category", categories).agg(F.sum("value"))


def category_meta(spending: DataFrame, categories: DataFrame) -> DataFrame:
    """Colour of every category of the spending series, with the fallback colour."""
    colors = categories.select("space_id", F.col("name").alias("category"), "color")
    return spending.select("space_id", "category").distinct().join(
        colors, ["space_id", "category"], "left"
    ).select("space_id", "category", F.coalesce("color", F.lit(FALLBACK_COLOR)).alias("color"))
