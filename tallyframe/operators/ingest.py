"""Statements to ledger rows."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from ..functions.numbering import first_per_group
from ..functions.scalars import SPACE, content_id, first_filled, let, parse_minor
from ..schemas import FALLBACK_CATEGORY
from .mutate import insert_if_absent, last_per_key, new_account_rows, upsert

# ---- fixed values -------------------------------------------------------------------
ACCOUNT_NUMBER = r"\(([0-9" + SPACE[1:-1] + r"]+)\)"
ACCOUNT_NUMBER_ROWS = 10
BOOKING_DATE = ["Bokföringsdag", "Bokforingsdag", "Booking date"]
VALUE_DATE = ["Valutadag", "Value date"]
REFERENCE = ["Verifikationsnummer", "Voucher number", "Reference"]
TEXT = ["Text"]
AMOUNT = ["Belopp", "Amount"]
BALANCE = ["Saldo", "Balance"]
PORTFOLIO_ACCOUNT = "Konto" + SPACE + "*Kontotyp" + SPACE + "*([0-9]+)"
PORTFOLIO_TOTAL = (r"Totalt[0-9" + SPACE[1:-1] + r"]+,[0-9]{2}([0-9,"
                   + SPACE[1:-1] + r"]+)R")
PORTFOLIO_MONTH = "V[äa]rde" + SPACE + "+([0-9]{4}-[0-9]{2})-[0-9]{2}"


def _nonempty(cells: Column) -> Column:
    return F.size(F.filter(cells, lambda c: c != ""))


def _record(names: Column, cells: Column, keep_blank: bool) -> Column:
    """Cells keyed by header name; cells past the header by their index. A later cell
    replaces an earlier one of the same name."""
    entries = F.transform(
        cells,
        lambda c, i: F.struct(F.coalesce(F.get(names, i), i.cast("string")).alias("key"), c.alias("value")),
    )
    if not keep_blank:
        entries = F.filter(entries, lambda e: e["key"] != "")

    def last_of_each(bound: Column) -> Column:
        def pick(keys: Column) -> Column:
            repeated = F.filter(
                bound, lambda e, i: ~F.array_contains(F.slice(keys, i + 2, F.size(keys)), e["key"]))
            distinct = F.size(F.array_distinct(keys)) == F.size(keys)
            return F.map_from_entries(F.when(distinct, bound).otherwise(repeated))

        return let(F.transform(bound, lambda e: e["key"]), pick)

    return let(entries, last_of_each)


def csv_records(cells: DataFrame) -> DataFrame:
    """Delimited layout: row 0 is the header, every later row a record."""
    header = cells.where("row_idx = 0").select("file", F.col("cells").alias("_names"))
    return cells.where("row_idx > 0").join(header, "file").select(
        "file", "row_idx", _record(F.col("_names"), F.col("cells"), keep_blank=True).alias("record"))


def sheet_records(cells: DataFrame) -> DataFrame:
    """Sheet layout: the header is the first row with three filled cells, else row 0.

    All-empty rows are dropped; rows above the header, and the header itself, stay as
    records. The header is found with a combining aggregate per file, no window.
    """
    filled = _nonempty(F.col("cells")) >= 3
    header = cells.groupBy("file").agg(
        F.min_by(F.when(filled, F.col("cells")), F.when(filled, F.col("row_idx"))).alias("_wide"),
        F.min_by("cells", "row_idx").alias("_first"),
    ).select("file", F.coalesce("_wide", "_first").alias("_names"))
    return cells.where(_nonempty(F.col("cells")) > 0).join(header, "file").select(
        "file", "row_idx", _record(F.col("_names"), F.col("cells"), keep_blank=False).alias("record"))


def _field(record: Column, names: list[str]) -> Column:
    return first_filled(*[F.try_element_at(record, F.lit(n)) for n in names])


def statement_accounts(records: DataFrame) -> DataFrame:
    """Account number in parentheses within a file's first ten records, lowest column first."""
    head = first_per_group(records, ["file"], [F.asc("row_idx")], ACCOUNT_NUMBER_ROWS)
    found = F.filter(
        F.transform(F.map_values("record"), lambda v: F.regexp_extract(v, ACCOUNT_NUMBER, 1)),
        lambda v: v != "",
    )
    hits = head.withColumn("_hit", F.get(found, F.lit(0))).where(F.col("_hit").isNotNull())
    trimmed = F.regexp_replace(F.col("_hit"), f"^{SPACE}+|{SPACE}+$", "")
    return hits.groupBy("file").agg(F.min_by(trimmed, "row_idx").alias("account_id"))


def parse_ledger_rows(records: DataFrame, exact: bool = False) -> tuple[DataFrame, DataFrame]:
    """Tabular statements to parsed transactions, and the files without an account number.

    Rows without a booking date or text, or with an unreadable number, are skipped.
    """
    accounts = statement_accounts(records)
    record = F.col("record")
    booking = _field(record, BOOKING_DATE)
    zero = F.lit("0")
    amount = F.coalesce(F.nullif(_field(record, AMOUNT), F.lit("")), zero)
    balance = F.coalesce(F.nullif(_field(record, BALANCE), F.lit("")), zero)
    fields = F.struct(
        booking.alias("booking_date"),
        first_filled(*[F.try_element_at(record, F.lit(n)) for n in VALUE_DATE], booking).alias("value_date"),
        _field(record, REFERENCE).alias("reference"), _field(record, TEXT).alias("text"),
        parse_minor(amount, exact).alias("amount"), parse_minor(balance, exact).alias("balance"),
    )
    # One row in, one row out: the generator keeps the filter below from being pushed into
    # the record's construction, which would build the record again for each condition.
    rows = records.select("file", "row_idx", F.inline(F.array(fields))).where(
        "booking_date <> '' and text <> '' and amount is not null and balance is not null")
    parsed = rows.join(accounts, "file").select(
        content_id(F.col("value_date"), F.col("reference"), F.col("text"), F.col("amount"),
                   F.col("balance")).alias("id"),
        "file", "row_idx", "account_id", "booking_date", "value_date", "reference", "text",
        "amount", "balance",
    )
    lost = records.select("file").distinct().join(accounts, "file", "left_anti").withColumn(
        "reason", F.lit("no account number"))
    return parsed, lost


def parse_portfolio_text(statements: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(file, text) portfolio statements to (file, account_id, month, balance) and rejects.

    The first missing part of a statement names the reason.
    """
    number = F.regexp_extract("text", PORTFOLIO_ACCOUNT, 1)
    total = F.regexp_extract("text", PORTFOLIO_TOTAL, 1)
    read = statements.select(
        "file", F.col("text"), number.alias("account_id"), total.alias("_total"),
        parse_minor(total).alias("balance"), F.regexp_extract("text", PORTFOLIO_MONTH, 1).alias("month"),
    )
    reason = (
        F.when(F.coalesce(F.col("text"), F.lit("")) == "", "no text")
        .when(F.col("account_id") == "", "no account number")
        .when(F.col("_total") == "", "no total")
        .when(F.col("balance").isNull(), "total is not a number")
        .when(F.col("month") == "", "no month")
    )
    tagged = read.withColumn("reason", reason)
    return (tagged.where("reason is null").select("file", "account_id", "month", "balance"),
            tagged.where("reason is not null").select("file", "reason"))


# ---- user transforms ----------------------------------------------------------------
PARSED_ROW = T.StructType([
    T.StructField("booking_date", T.StringType()), T.StructField("value_date", T.StringType()),
    T.StructField("reference", T.StringType()), T.StructField("text", T.StringType()),
    T.StructField("amount", T.LongType()), T.StructField("balance", T.LongType()),
])
PARSE_RESULT = T.StructType([
    T.StructField("file", T.StringType()), T.StructField("kind", T.StringType()),
    T.StructField("account_id", T.StringType()), T.StructField("month", T.StringType()),
    T.StructField("balance", T.LongType()),
    T.StructField("transactions", T.ArrayType(PARSED_ROW)),
    T.StructField("logs", T.ArrayType(T.StringType())), T.StructField("error", T.StringType()),
])

_STATEMENTS = 64  # statements per Arrow batch that leaves a user transform

Transform = Callable[[object, Callable[[str], None]], dict]


def parse_statement(transform: Transform, file: str, content: object) -> dict:
    """One statement's tagged record, with the lines that the transform logged; an exception is its `error`."""
    logs: list[str] = []
    row = {"file": file, "logs": logs}
    try:
        result = transform(content, logs.append)
        if result["type"] not in ("checking", "savings", "investment"):
            raise ValueError(f"unknown statement type {result['type']}")
        row.update(kind=result["type"], account_id=result["account_id"])
        if result["type"] == "investment":
            row.update(month=result["month"], balance=int(result["balance"]))
        else:
            row["transactions"] = list(result["transactions"])
    except Exception as problem:  # noqa: BLE001 - user code may raise anything
        row["error"] = f"{type(problem).__name__}: {problem}"
    return row


def apply_user_parser(statements: DataFrame, transform: Transform, data: str = "text") -> DataFrame:
    """Run a user's `transform(data, log)` once per statement.

    A statement is one row already (its whole text, or its records as an array), so the
    work follows the existing partitions with no shuffle and no per-key group. The result
    is a tagged record: kind checking / savings with `transactions`, or investment with
    `month` and `balance`. An exception becomes the row's `error`.
    """

    shape = to_arrow_schema(PARSE_RESULT)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, _STATEMENTS):
                part = batch.slice(start, _STATEMENTS)
                pairs = zip(part.column(0).to_pylist(), part.column(1).to_pylist())
                yield pa.RecordBatch.from_pylist([parse_statement(transform, f, c) for f, c in pairs], schema=shape)

    return statements.select("file", data).mapInArrow(run, PARSE_RESULT)


def parser_logs(results: DataFrame) -> DataFrame:
    """(file, line_no, line, error): what each statement's transform logged, in order, and its error.

    A statement without a line has one row, with a null line, so that errors are never lost.
    """
    return results.select("file", "error", F.posexplode_outer("logs").alias("line_no", "line")).select(
        "file", "line_no", "line", "error")


def user_parsed_rows(results: DataFrame) -> DataFrame:
    """Transactions of checking and savings results, with the same ids as built-in parsing."""
    rows = results.where("kind in ('checking', 'savings')").select(
        "file", "account_id", F.posexplode("transactions").alias("row_idx", "t"))
    return rows.select(
        content_id(F.col("t.value_date"), F.col("t.reference"), F.col("t.text"), F.col("t.amount"),
                   F.col("t.balance")).alias("id"),
        "file", "row_idx", "account_id", "t.*",
    )


# ---- loading ------------------------------------------------------------------------
def ensure_accounts(accounts: DataFrame, statements: DataFrame) -> DataFrame:
    """Add the accounts that imports name and the ledger lacks; existing ones stay as they are."""
    return insert_if_absent(accounts, new_account_rows(statements), ["id"])


def first_occurrence(parsed: DataFrame) -> DataFrame:
    """One row per content id: the first by file and row."""
    names = parsed.columns
    return parsed.groupBy("id").agg(
        F.min_by(F.struct(*names), F.struct("file", "row_idx")).alias("_r")).select("_r.*")


def import_transactions(transactions: DataFrame, parsed: DataFrame, currency: str = "SEK",
                        predicted: DataFrame | None = None) -> DataFrame:
    """Append unseen rows as unapproved; `predicted(id, category)` fills the category."""
    fresh = first_occurrence(parsed).join(transactions.select("id"), "id", "left_anti")
    if predicted is None:
        fresh = fresh.withColumn("category", F.lit(FALLBACK_CATEGORY))
    else:
        fresh = fresh.join(predicted.select("id", "category"), "id", "left").withColumn(
            "category", F.coalesce("category", F.lit(FALLBACK_CATEGORY)))
    rows = fresh.withColumn("currency", F.lit(currency)).withColumn(
        "approved", F.lit(False)).withColumn("note", F.lit(""))
    return transactions.unionByName(rows.select(*transactions.columns))


def import_counts(transactions: DataFrame, parsed: DataFrame) -> DataFrame:
    """Inserted and skipped rows per file.

    A row counts as inserted when its id is new to the ledger and this is its first
    occurrence in the batch.
    """
    known = transactions.select("id", F.lit(True).alias("_known"))
    heads = parsed.groupBy("id").agg(F.min(F.struct("file", "row_idx")).alias("_head"))
    inserted = heads.join(known, "id", "left").where("_known is null").groupBy(
        F.col("_head.file").alias("file")).agg(F.count(F.lit(1)).alias("inserted"))
    totals = parsed.groupBy("file").agg(F.count(F.lit(1)).alias("_rows"))
    zero = F.lit(0).cast("bigint")
    return totals.join(inserted, "file", "left").select(
        "file", F.coalesce("inserted", zero).alias("inserted"),
        (F.col("_rows") - F.coalesce("inserted", zero)).alias("skipped"))


def import_summaries(summaries: DataFrame, portfolios: DataFrame) -> DataFrame:
    """Upsert the month value of investment statements; the last file of a month wins."""
    keys = ["account_id", "month"]
    last = last_per_key(portfolios, keys, [F.col("file")])
    return upsert(summaries, last, keys)


def preview_parse(parsed: DataFrame, predicted: DataFrame | None = None) -> DataFrame:
    """What an import would add, with predicted categories; nothing is written."""
    if predicted is None:
        return parsed.withColumn("category", F.lit(FALLBACK_CATEGORY))
    return parsed.join(predicted.select("id", "category"), "id", "left").withColumn(
        "category", F.coalesce("category", F.lit(FALLBACK_CATEGORY)))


def resolve_parsers(builtin: DataFrame, user: DataFrame) -> DataFrame:
    """Parser units by key; a user unit replaces the built-in one; listed by bank and name."""
    units = builtin.withColumn("is_builtin", F.lit(True)).unionByName(
        user.withColumn("is_builtin", F.lit(False)))
    names = units.columns
    picked = units.groupBy("key").agg(
        F.min_by(F.struct(*names), F.struct("is_builtin", "name", "bank")).alias("_u")).select("_u.*")
    return picked.orderBy("bank", "name", "key")


def attach_parsers(statements: DataFrame, units: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Statements with their unit, and those that name an unknown parser key."""
    joined = statements.join(units, "key")
    unknown = statements.join(units.select("key"), "key", "left_anti").withColumn(
        "reason", F.concat(F.lit("unknown parser key: "), "key"))
    return joined, unknown


