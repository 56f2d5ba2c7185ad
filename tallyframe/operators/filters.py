"""Projections, predicates and write gates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import is_filled


def scope_to_space(rows: DataFrame, accounts: DataFrame, space_id: str | None = None) -> DataFrame:
    """Add the tenant of each row, found through its account.

    No broadcast is forced: accounts grow with the data. Spark broadcasts them when their
    measured size allows and otherwise shuffles, splitting a hot account's partition.
    """
    owner = accounts.select(F.col("id").alias("account_id"), "space_id")
    if space_id is not None:
        owner = owner.where(F.col("space_id") == space_id)
    return rows.join(owner, "account_id")


def transaction_predicates(
    approved: bool | None = None,
    category: str | None = None,
    date_from: str | None = None,
    date_to: str | None = None,
) -> list[Column]:
    tests = []
    if approved is not None:
        tests.append(F.col("approved") == F.lit(approved))
    if category is not None:
        tests.append(F.col("category") == category)
    if date_from is not None:
        tests.append(F.col("value_date") >= date_from)
    if date_to is not None:
        tests.append(F.col("value_date") <= date_to)
    return tests


def filter_transactions(transactions: DataFrame, **filters) -> DataFrame:
    """Conjunction of the given optional filters; both date ends are inclusive."""
    for test in transaction_predicates(**filters):
        transactions = transactions.where(test)
    return transactions


def project_listing(transactions: DataFrame) -> DataFrame:
    return transactions.select(
        "id", "booking_date", "value_date", "reference", "text", "currency", "amount", "balance",
        "approved", "note", F.coalesce("category", F.lit("")).alias("category"), "account_id",
    )


def project_users(users: DataFrame) -> DataFrame:
    """Users without the PIN hash, only whether there is one."""
    return users.select(
        "id", "name", F.col("pin_hash").isNotNull().alias("has_pin"), "created_at", "updated_at"
    )


def visible_spaces(spaces: DataFrame) -> DataFrame:
    return spaces.where(~F.col("deleted"))


def approved_labelled(transactions: DataFrame) -> DataFrame:
    """Rows the categoriser may learn from."""
    return transactions.where(
        F.col("approved") & F.col("category").isNotNull() & (F.col("category") != "")
    )


def ids_in(rows: DataFrame, ids: DataFrame, key: str = "id") -> DataFrame:
    """Rows whose key is among the ids. Repeats are dropped where they arise: an id that is in every list
    would otherwise meet in one task of the join."""
    return rows.join(ids.select(F.col(ids.columns[0]).alias(key)).distinct(), key, "left_semi")


def ids_from_json(bindings: DataFrame, column: str) -> DataFrame:
    """One row per id of a JSON array column."""
    return bindings.select(F.explode(F.from_json(column, "array<string>")).alias("id"))


def split_by(batch: DataFrame, allowed: DataFrame, keys: list[str]) -> tuple[DataFrame, DataFrame]:
    """(accepted, rejected) rows of a batch, by presence of their key in `allowed`."""
    allowed = allowed.select(*keys)
    return batch.join(allowed, keys, "left_semi"), batch.join(allowed, keys, "left_anti")


def check_ownership(batch: DataFrame, accounts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Split a write batch by whether its (account, space) pair exists."""
    pairs = accounts.select(F.col("id").alias("account_id"), "space_id")
    return split_by(batch, pairs, ["account_id", "space_id"])


def check_role(requests: DataFrame, members: DataFrame, owner_only: bool = False
               ) -> tuple[DataFrame, DataFrame]:
    """Split requests by whether their user is a member (or owner) of their space."""
    if owner_only:
        members = members.where("role = 'owner'")
    return split_by(requests, members, ["space_id", "user_id"])


def check_filled(batch: DataFrame, *columns: str) -> tuple[DataFrame, DataFrame]:
    """Trim the named columns; rows where one is blank are rejected."""
    ok = F.lit(True)
    for c in columns:
        ok = ok & is_filled(F.col(c))
    trimmed = batch.where(ok).withColumns({c: F.trim(c) for c in columns})
    return trimmed, batch.where(~ok)
