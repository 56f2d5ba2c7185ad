from __future__ import annotations

import random

import pytest

from helpers import rows
from tallyframe.operators import aggregates as A
from tallyframe.operators import series as W
from tallyframe.operators.sets import month_spine
from tallyframe.plans.dashboard import dashboard, dashboard_long, release

ACCOUNTS = [
    {"id": "c", "account_type": "checking", "space_id": "s", "name": "C"},
    {"id": "v", "account_type": "savings", "space_id": "s", "name": "V"},
    {"id": "i", "account_type": "investment", "space_id": "s", "name": "I"},
    {"id": "x", "account_type": "checking", "space_id": "t", "name": "X"},
]


def tx(i, date, amount=0, balance=0, account="c", category="Food", approved=True):
    return {"id": i, "value_date": date, "booking_date": date, "amount": amount, "balance": balance,
            "account_id": account, "category": category, "approved": approved}


def test_spend_keeps_the_empty_category_and_skips_null_and_unapproved(table):
    got = A.category_spend_by_month(table(
        "transactions", tx("1", "2024-01-05", -5), tx("2", "2024-01-06", -7, category=""),
        tx("3", "2024-01-06", -100, category=None), tx("4", "2024-01-06", -9, approved=False),
        tx("5", "2024-01-31", 2), tx("6", "2024-01-31", 1, account="x")), table("accounts", *ACCOUNTS))
    assert rows(got) == [("s", "2024-01", "", -7), ("s", "2024-01", "Food", -3), ("t", "2024-01", "Food", 1)]


def test_month_end_ties_are_all_returned_and_broken_by_id_in_the_series(table):
    accounts = table("accounts", *ACCOUNTS)
    frame = table("transactions", tx("1", "2024-01-31", balance=10), tx("2", "2024-01-31", balance=20),
                  tx("0", "2024-01-30", balance=99), tx("7", "2024-01-31", balance=5, account="i"))
    assert rows(W.month_end_rows(frame, accounts), "account_id", "balance") == [("c", 10), ("c", 20)]
    assert rows(W.month_end_balance(frame, accounts)) == [("c", "2024-01", 20)]


def test_manual_summary_overrides(table):
    got = W.account_balances(
        table("transactions", tx("1", "2024-01-31", balance=10)), table("accounts", *ACCOUNTS),
        table("account_summaries", {"month": "2024-01", "account_id": "c", "balance": 77},
              {"month": "2024-02", "account_id": "i", "balance": 5}))
    assert rows(got) == [("s", "c", "2024-01", 77), ("s", "i", "2024-02", 5)]


@pytest.fixture
def balances(spark):
    return spark.createDataFrame([
        ("s", "c", "2024-01", 5), ("s", "c", "2024-02", 0), ("s", "v", "2024-03", 10),
        ("t", "x", "2024-02", -4),
    ], "space_id string, account_id string, month string, balance long")


@pytest.fixture
def spend(spark):
    return spark.createDataFrame([("s", "2024-04", "Food", -3), ("s", "2023-12", "Pay", 9)],
                                 "space_id string, month string, category string, amount long")


def test_net_worth_counts_an_account_from_its_first_value(balances, spend):
    worth = W.net_worth_series(balances, spend)
    assert rows(worth) == [
        ("s", "2023-12", 0), ("s", "2024-01", 5), ("s", "2024-02", 0), ("s", "2024-03", 10),
        ("s", "2024-04", 10), ("t", "2024-02", -4)]
    assert rows(W.net_worth_latest_delta(worth)) == [("s", "2024-04", 10, 0), ("t", "2024-02", -4, 0)]
    assert ("s", "2023-12", 0) in rows(W.cash_flow(worth)) and ("s", "2024-02", -5) in rows(W.cash_flow(worth))


def test_zero_is_missing_in_history_but_a_value_in_allocation(balances, spend, table):
    accounts = table("accounts", *ACCOUNTS)
    spine = month_spine(balances, spend)
    history = {r[1:3]: r[3] for r in rows(W.account_history(balances, accounts, spine)) if r[0] == "s"}
    allocation = {r[1:3]: r[3] for r in rows(W.allocation_series(balances, accounts, spine)) if r[0] == "s"}
    months = ["2023-12", "2024-01", "2024-02", "2024-03", "2024-04"]
    assert [history["c", m] for m in months] == [0, 5, 5, 5, 5]
    assert [allocation["c", m] for m in months] == [0, 5, 0, 0, 0]
    assert [allocation["i", m] for m in months] == [0] * 5
    assert rows(W.account_latest(balances, accounts)) == [
        ("s", "c", 5), ("s", "i", 0), ("s", "v", 10), ("t", "x", -4)]
    assert rows(W.allocation_share(balances)) == [("s", "v", 10, 1.0)]


def test_trailing_twelve_and_dense_spending_grid(spark):
    months = [f"{2022 + i // 12}-{i % 12 + 1:02d}" for i in range(14)]
    spend = spark.createDataFrame(
        [("s", m, "A", -i) for i, m in enumerate(months)] + [("s", months[0], "Old", -1), ("s", months[5], "B", 4)],
        "space_id string, month string, category string, amount long")
    got = rows(W.spending_series(spend, spend.select("space_id", "month").distinct()))
    assert {r[2] for r in got} == {"A", "B"} and len(got) == 24
    assert ("s", months[5], "B", 4) in got and ("s", months[6], "B", 0) in got and ("s", months[13], "A", 13) in got


def test_net_worth_against_a_plain_loop(spark):
    rng = random.Random(3)
    months = [f"2023-{m:02d}" for m in range(1, 13)]
    data = [("s", f"a{a}", m, rng.randint(-50, 50)) for a in range(20) for m in months if rng.random() < 0.3]
    known: dict[str, int] = {}
    want = []
    for m in sorted({d[2] for d in data}):
        known.update({a: b for _, a, mm, b in data if mm == m})
        want.append(("s", m, sum(known.values())))
    frame = spark.createDataFrame(data, "space_id string, account_id string, month string, balance long")
    assert rows(W.net_worth_series(frame)) == want


def test_dashboard_series_share_their_months(table):
    out = dashboard(
        table("transactions", tx("1", "2024-01-31", -5, 10), tx("2", "2024-03-01", 7, 17, category="Pay")),
        table("accounts", *ACCOUNTS), table("account_summaries", {"month": "2024-02", "account_id": "i", "balance": 3}),
        table("categories", {"id": "k", "name": "Pay", "color": "#fff", "space_id": "s"}))
    months = ["2024-01", "2024-02", "2024-03"]
    assert rows(out["months"]) == [("s", m) for m in months]
    assert rows(out["net_worth"]) == [("s", m, v) for m, v in zip(months, (10, 13, 20))]
    assert rows(out["net_worth_latest"]) == [("s", "2024-03", 20, 7)]
    assert out["account_history"].where("space_id = 's'").count() == 3 * 3 == out["allocation"].where("space_id = 's'").count()
    assert rows(out["category_meta"]) == [("s", "Food", "#6b7280"), ("s", "Pay", "#fff")]
    assert rows(out["spending"].where("category = 'Food'"), "month", "value") == [
        ("2024-01", 5), ("2024-02", 0), ("2024-03", 0)]
    long = dashboard_long(out["spend"], out["balances"], table("accounts", *ACCOUNTS))
    assert rows(long.where("series = 'cash_flow'"), "month", "value") == [("2024-01", 0), ("2024-02", 3), ("2024-03", 7)]
    release(out)
