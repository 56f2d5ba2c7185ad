"""Registered queries: monthly aggregates and dashboard series."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import to_major
from ..operators import aggregates, series, sets
from ..session import settle
from ..sources.given import GivenLedger
from .catalog import register
from .dashboard import dashboard_long
from .oracle import ledger_sql

SPEND = """
spend AS (
  SELECT a.space_id, substr(t.value_date, 1, 7) AS month, t.category,
         CAST(sum(t.amount) AS BIGINT) AS amount
  FROM transactions t JOIN accounts a ON a.id = t.account_id
  WHERE t.approved AND t.category IS NOT NULL GROUP BY 1, 2, 3)"""
BALANCES = """
tied AS (
  SELECT * FROM (
    SELECT a.space_id, substr(t.value_date, 1, 7) AS month, t.account_id, t.balance, t.id,
           t.value_date, t.booking_date,
           max(t.value_date) OVER (PARTITION BY t.account_id, substr(t.value_date, 1, 7)) AS top
    FROM transactions t JOIN accounts a ON a.id = t.account_id
    WHERE a.account_type IN ('checking', 'savings'))
  WHERE value_date = top),
derived AS (
  SELECT account_id, month, balance FROM tied
  QUALIFY row_number() OVER (PARTITION BY account_id, month ORDER BY booking_date DESC, id DESC) = 1),
overlaid AS (
  SELECT coalesce(d.account_id, s.account_id) AS account_id, coalesce(d.month, s.month) AS month,
         coalesce(s.balance, d.balance) AS balance
  FROM derived d FULL JOIN account_summaries s ON d.account_id = s.account_id AND d.month = s.month),
balances AS (
  SELECT a.space_id, o.account_id, o.month, o.balance FROM overlaid o
  JOIN accounts a ON a.id = o.account_id)"""
SPINE = "spine AS (SELECT space_id, month FROM spend UNION SELECT space_id, month FROM balances)"
GRID = """
grid AS (
  SELECT p.space_id, a.id AS account_id, p.month, b.balance
  FROM spine p JOIN accounts a ON a.space_id = p.space_id
  LEFT JOIN balances b ON b.account_id = a.id AND b.month = p.month),
allocation AS (
  SELECT space_id, account_id, month, coalesce(last_value(balance IGNORE NULLS) OVER w, 0) AS value
  FROM grid WINDOW w AS (PARTITION BY account_id ORDER BY month)),
history AS (
  SELECT space_id, account_id, month,
         coalesce(last_value(nullif(balance, 0) IGNORE NULLS) OVER w, 0) AS value
  FROM grid WINDOW w AS (PARTITION BY account_id ORDER BY month))"""
WORTH = """
worth AS (
  SELECT space_id, month, CAST(sum(value) AS BIGINT) AS value FROM allocation GROUP BY 1, 2)"""
FLOW = """
flow AS (
  SELECT space_id, month, net FROM (
    SELECT space_id, month, value - coalesce(lag(value) OVER w, value) AS net,
           row_number() OVER (PARTITION BY space_id ORDER BY month DESC) AS r
    FROM worth WINDOW w AS (PARTITION BY space_id ORDER BY month))
  WHERE r <= 12)"""
SPENDING = """
recent AS (
  SELECT space_id, month FROM spine
  QUALIFY row_number() OVER (PARTITION BY space_id ORDER BY month DESC) <= 12),
spending AS (
  SELECT r.space_id, r.month, c.category, abs(coalesce(s.amount, 0)) AS value
  FROM recent r
  JOIN (SELECT DISTINCT x.space_id, x.category FROM spend x JOIN recent USING (space_id, month)) c
    ON c.space_id = r.space_id
  LEFT JOIN spend s ON s.space_id = r.space_id AND s.month = r.month AND s.category = c.category)"""
MONTHLY = (SPEND, BALANCES, SPINE)
FULL = (*MONTHLY, GRID, WORTH, FLOW, SPENDING)


def _spend(led: GivenLedger) -> DataFrame:
    return aggregates.category_spend_by_month(led.transactions(text=False, balance=False), led.accounts)


def _balances(led: GivenLedger) -> DataFrame:
    return series.account_balances(led.transactions(text=False), led.accounts, led.account_summaries)


def _stored(led: GivenLedger) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(spend, balances, spine) for plans that read them several times.

    They are written once: a row per account-month is far less than the transactions.
    """
    spend, balances = settle(_spend(led), "spend"), settle(_balances(led), "balances")
    return spend, balances, sets.month_spine(spend, balances)


@register("category_spend_by_month", ledger_sql("SELECT * FROM spend", SPEND))
def _(led: GivenLedger) -> DataFrame:
    return _spend(led)


@register("monthly_aggregates", ledger_sql("""
    SELECT space_id, month, 'category' AS kind, category AS key, amount AS value FROM spend
    UNION ALL SELECT space_id, month, 'balance', account_id, balance FROM balances""", *MONTHLY))
def _(led: GivenLedger) -> DataFrame:
    return aggregates.monthly_aggregates(_spend(led), _balances(led))


@register("month_end_rows", ledger_sql(
    "SELECT space_id, month, account_id, balance FROM tied", *MONTHLY))
def _(led: GivenLedger) -> DataFrame:
    return series.month_end_rows(led.transactions(text=False), led.accounts)


@register("month_end_balance", ledger_sql("SELECT account_id, month, balance FROM derived", *MONTHLY))
def _(led: GivenLedger) -> DataFrame:
    return series.month_end_balance(led.transactions(text=False), led.accounts)


@register("overlay_balances", ledger_sql(
    "SELECT space_id, account_id, month, balance FROM balances", *MONTHLY))
def _(led: GivenLedger) -> DataFrame:
    return _balances(led)


@register("month_spine", ledger_sql("SELECT * FROM spine", *MONTHLY))
def _(led: GivenLedger) -> DataFrame:
    return sets.month_spine(_spend(led), _balances(led))


@register("net_worth_series", ledger_sql("SELECT * FROM worth", *FULL))
def net_worth(led: GivenLedger) -> DataFrame:
    return series.net_worth_series(_balances(led), _spend(led))


@register("net_worth_latest_delta", ledger_sql("""
    SELECT space_id, month, value AS latest, value - coalesce(previous, value) AS delta FROM (
      SELECT *, lag(value) OVER (PARTITION BY space_id ORDER BY month) AS previous,
             row_number() OVER (PARTITION BY space_id ORDER BY month DESC) AS r FROM worth)
    WHERE r = 1""", *FULL))
def _(led: GivenLedger) -> DataFrame:
    return series.net_worth_latest_delta(net_worth(led))


@register("cash_flow", ledger_sql("SELECT * FROM flow", *FULL))
def _(led: GivenLedger) -> DataFrame:
    return series.cash_flow(net_worth(led))


@register("trailing_months", ledger_sql("SELECT * FROM recent", *FULL))
def _(led: GivenLedger) -> DataFrame:
    return series.trailing_months(sets.month_spine(_spend(led), _balances(led)))


@register("account_history", ledger_sql("SELECT * FROM history", *FULL))
def _(led: GivenLedger) -> DataFrame:
    _, balances, spine = _stored(led)
    return series.account_history(balances, led.accounts, spine)


@register("account_latest", ledger_sql("""
    SELECT space_id, account_id, value AS latest FROM history
    QUALIFY row_number() OVER (PARTITION BY account_id ORDER BY month DESC) = 1""", *FULL))
def _(led: GivenLedger) -> DataFrame:
    return series.account_latest(_balances(led), led.accounts)


@register("allocation_series", ledger_sql("SELECT * FROM allocation", *FULL))
def _(led: GivenLedger) -> DataFrame:
    _, balances, spine = _stored(led)
    return series.allocation_series(balances, led.accounts, spine)


@register("allocation_share", ledger_sql("""
    SELECT space_id, account_id, value,
           value / CAST(sum(value) OVER (PARTITION BY space_id) AS DOUBLE) AS share
    FROM (SELECT * FROM allocation
          QUALIFY row_number() OVER (PARTITION BY account_id ORDER BY month DESC) = 1)
    WHERE value > 0""", *FULL))
def _(led: GivenLedger) -> DataFrame:
    return series.allocation_share(_balances(led))


@register("spending_series", ledger_sql("SELECT * FROM spending", *FULL))
def spending(led: GivenLedger) -> DataFrame:
    spend, _, spine = _stored(led)
    return series.spending_series(spend, spine)


@register("spending_wide", ledger_sql("""
    SELECT space_id, month, CAST(sum(value) FILTER (category = 'Salary') AS BIGINT) AS salary,
           CAST(sum(value) FILTER (category = 'Shopping') AS BIGINT) AS shopping,
           CAST(sum(value) FILTER (category = 'Transport') AS BIGINT) AS transport
    FROM spending GROUP BY 1, 2""", *FULL))
def _(led: GivenLedger) -> DataFrame:
    wide = series.spending_wide(spending(led), ["Salary", "Shopping", "Transport"])
    return wide.toDF("space_id", "month", "salary", "shopping", "transport")


@register("category_meta", ledger_sql("""
    SELECT DISTINCT s.space_id, s.category, coalesce(c.color, '#6b7280') AS color
    FROM spending s LEFT JOIN default_categories c
      ON c.space_id = s.space_id AND c.name = s.category AND c.name <> 'Transport'""", *FULL))
def _(led: GivenLedger) -> DataFrame:
    return series.category_meta(spending(led), led.default_categories.where("name <> 'Transport'"))


@register("dashboard", ledger_sql("""
    SELECT 'net_worth' AS series, space_id, month, '' AS key, value FROM worth
    UNION ALL SELECT 'cash_flow', space_id, month, '', net FROM flow
    UNION ALL SELECT 'account_history', space_id, month, account_id, value FROM history
    UNION ALL SELECT 'allocation', space_id, month, account_id, value FROM allocation
    UNION ALL SELECT 'spending', space_id, month, category, value FROM spending""", *FULL))
def _(led: GivenLedger) -> DataFrame:
    spend, balances, _ = _stored(led)
    return dashboard_long(spend, balances, led.accounts)


@register("major_units", ledger_sql(
    "SELECT space_id, month, value / 100.0::DOUBLE AS value FROM worth", *FULL))
def _(led: GivenLedger) -> DataFrame:
    return net_worth(led).select("space_id", "month", to_major(F.col("value")).alias("value"))


