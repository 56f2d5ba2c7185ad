"""Ordered and paged listings, samples."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.numbering import first_per_group
from ..schemas import DEFAULT_PAGE_ROWS, MAX_PAGE_ROWS
from .aggregates import count_by_space, page_count
from .filters import approved_labelled, filter_transactions, project_listing, scope_to_space
from .joins import summaries_with_accounts
from .search import search


def page_bounds(page: int | None, limit: int | None) -> tuple[int, int]:
    page = max(0 if page is None else page, 0)
    limit = min(max(DEFAULT_PAGE_ROWS if limit is None else limit, 1), MAX_PAGE_ROWS)
    return page, limit


def _newest_first():
    return [F.desc("value_date"), F.asc("text"), F.asc("id")]


def matching_transactions(transactions: DataFrame, term: str | None = None, **filters) -> DataFrame:
    """The rows that both the page and its count are taken from."""
    return search(filter_transactions(transactions, **filters), term)


def list_transactions(transactions: DataFrame, accounts: DataFrame, space_id: str | None = None,
                      page: int | None = None, limit: int | None = None, term: str | None = None,
                      **filters) -> DataFrame:
    """One page of a space's listing, or the same page of every space at once.

    Either way only the rows up to the end of the page survive the map side
    (TakeOrderedAndProject, or a rank limit per space). Use `list_after` for deep pages.
    """
    page, limit = page_bounds(page, limit)
    rows = scope_to_space(matching_transactions(transactions, term, **filters), accounts, space_id)
    if space_id is not None:
        top = rows.orderBy(*_newest_first()).offset(page * limit).limit(limit)
        return project_listing(top)
    ranked = first_per_group(rows, ["space_id"], _newest_first(), (page + 1) * limit)
    kept = ranked.where(F.col("row_no") > page * limit)
    listing = project_listing(kept).columns
    return kept.withColumn("category", F.coalesce("category", F.lit(""))).select("space_id", *listing)


def list_after(transactions: DataFrame, accounts: DataFrame, space_id: str,
               last: tuple[str, str, str], limit: int | None = None, **filters) -> DataFrame:
    """The page that follows row `last` (value_date, text, id), at the cost of a first page."""
    _, limit = page_bounds(None, limit)
    value_date, text, row_id = last
    rows = scope_to_space(matching_transactions(transactions, **filters), accounts, space_id)
    later = (F.col("value_date") < value_date) | (
        (F.col("value_date") == value_date)
        & ((F.col("text") > text) | ((F.col("text") == text) & (F.col("id") > row_id)))
    )
    return project_listing(rows.where(later).orderBy(*_newest_first()).limit(limit))


def transaction_pages(transactions: DataFrame, accounts: DataFrame, limit: int | None = None,
                      term: str | None = None, **filters) -> DataFrame:
    """Filtered total and page count per space; a space without a match has no row."""
    _, limit = page_bounds(None, limit)
    totals = count_by_space(matching_transactions(transactions, term, **filters), accounts)
    return totals.withColumn("page_count", page_count(F.col("total"), limit))


def list_account_summaries(summaries: DataFrame, accounts: DataFrame, page: int | None = None,
                           limit: int | None = None) -> DataFrame:
    """One page of every space's summaries, newest month first, then by account name."""
    page, limit = page_bounds(page, limit)
    ranked = first_per_group(
        summaries_with_accounts(summaries, accounts), ["space_id"],
        [F.desc("month"), F.asc("account_name"), F.asc("account_id")], (page + 1) * limit,
    )
    return ranked.where(F.col("row_no") > page * limit).select(
        "space_id", "month", "account_id", "account_name", "balance")


def summary_pages(summaries: DataFrame, accounts: DataFrame, limit: int | None = None) -> DataFrame:
    _, limit = page_bounds(None, limit)
    return count_by_space(summaries, accounts).withColumn(
        "page_count", page_count(F.col("total"), limit, at_least_one=True))


LISTING_ORDER = {
    "accounts": ["space_id", "name", "id"],
    "categories": ["space_id", "name", "id"],
    "space_members": ["space_id", "joined_at", "user_id"],
    "spaces": ["created_at", "id"],
    "trusted_devices": ["space_id", "paired_at", "id"],
    "model_versions": ["space_id", "version"],
}


def ordered_listing(rows: DataFrame, table: str) -> DataFrame:
    """A whole table in its listing order: a range-partitioned sort over all tenants."""
    return rows.orderBy(*LISTING_ORDER[table])


def sample_labelled(transactions: DataFrame, accounts: DataFrame, rows: int, seed: int) -> DataFrame:
    """A repeatable random sample of training rows from every space, by salted hash order."""
    salted = F.md5(F.concat(F.col("id"), F.lit(f"#{seed}")))
    scoped = scope_to_space(approved_labelled(transactions), accounts).withColumn("_draw", salted)
    return first_per_group(scoped, ["space_id"], [F.col("_draw"), F.col("id")], rows).drop(
        "_draw", "row_no")
