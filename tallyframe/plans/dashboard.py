"""The dashboard: every series over one shared set of monthly aggregates."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.aggregates import category_spend_by_month
from ..operators.series import (
    account_balances, account_history, allocation_series, allocation_share, cash_flow,
    category_meta, net_worth_latest_delta, net_worth_series, spending_series,
)
from ..operators.sets import month_spine


def dashboard_inputs(transactions: DataFrame, accounts: DataFrame, summaries: DataFrame
                     ) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(spend, balances, spine): one row per month and category or account."""
    spend = category_spend_by_month(transactions, accounts)
    balances = account_balances(transactions, accounts, summaries)
    return spend, balances, month_spine(spend, balances)


def dashboard(transactions: DataFrame, accounts: DataFrame, summaries: DataFrame,
              categories: DataFrame) -> dict[str, DataFrame]:
    """All series. The monthly inputs are kept, since eight series read them.

    They hold one row per account-month, far below the transactions; on a lost executor
    Spark recomputes the lost blocks. Call `release` when the series have been written.
    """
    spend, balances, _ = dashboard_inputs(transactions, accounts, summaries)
    spend, balances = spend.persist(), balances.persist()
    spine = month_spine(spend, balances)
    worth = net_worth_series(balances, spend)
    spending = spending_series(spend, spine)
    return {
        "spend": spend, "balances": balances,
        "months": spine, "net_worth": worth, "net_worth_latest": net_worth_latest_delta(worth),
        "cash_flow": cash_flow(worth),
        "account_history": account_history(balances, accounts, spine),
        "allocation": allocation_series(balances, accounts, spine),
        "allocation_share": allocation_share(balances),
        "spending": spending, "category_meta": category_meta(spending, categories),
    }


def release(series: dict[str, DataFrame]) -> None:
    series["spend"].unpersist()
    series["balances"].unpersist()


def dashboard_long(spend: DataFrame, balances: DataFrame, accounts: DataFrame) -> DataFrame:
    """The numeric series in one table: series, space, month, key, value."""
    spine = month_spine(spend, balances)
    worth = net_worth_series(balances, spend)

    def rows(series: str, frame: DataFrame, key: str | None, value: str) -> DataFrame:
        return frame.select(
            F.lit(series).alias("series"), "space_id", "month",
            (F.col(key) if key else F.lit("")).alias("key"),
            F.col(value).cast("bigint").alias("value"))

    return reduce(DataFrame.unionByName, [
        rows("net_worth", worth, None, "value"),
        rows("cash_flow", cash_flow(worth), None, "net"),
        rows("account_history", account_history(balances, accounts, spine), "account_id", "value"),
        rows("allocation", allocation_series(balances, accounts, spine), "account_id", "value"),
        rows("spending", spending_series(spend, spine), "category", "value"),
    ])
