"""Registered queries: statements to ledger rows.

The statements are built from the given tables: one sheet per customer with one row per
order, portfolio texts and free texts from the documents.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators import ingest, parser_function
from ..session import scratch_dir, settle
from ..sources.given import GivenLedger
from ..sources.statements import csv_cells, read_statement_csv, read_statement_text, write_statement_text
from .catalog import register
from .oracle import ledger_sql

NBSP = chr(0xA0)


def _t(column: Column) -> Column:
    return column.cast("string")


def sheet_cells(led: GivenLedger) -> DataFrame:
    """(file, row_idx, cells): a title row, an account row, a header, blank rows and orders.

    Every tenth customer's sheet has no account number; some orders lack a date or text,
    or have an unreadable amount; amounts use decimal commas and no-break spaces.
    """
    customer = led.read("customer").select("c_custkey")
    key, cust = F.col("o_orderkey"), F.col("c_custkey")
    account = F.concat(F.lit("Konto (5000 "), _t(cust), F.lit(")"))
    heads = customer.select(
        F.concat(F.lit("f"), _t(cust)).alias("file"),
        F.explode(F.array(
            F.struct(F.lit(0).cast("bigint").alias("row_idx"), F.array(F.lit("Export"), F.lit("")).alias("cells")),
            F.struct(F.lit(1).cast("bigint").alias("row_idx"), F.array(
                F.when(cust % 10 == 9, "Konto").otherwise(account), F.lit("SEK")).alias("cells")),
            F.struct(F.lit(2).cast("bigint").alias("row_idx"), F.array(*[F.lit(x) for x in (
                "Bokföringsdag", "Valutadag", "Verifikationsnummer", "Text", "", "Belopp", "Saldo")]).alias("cells")),
            F.struct(F.lit(3).cast("bigint").alias("row_idx"), F.array(F.lit(""), F.lit("")).alias("cells")),
        )).alias("h"),
    ).select("file", "h.row_idx", "h.cells")
    cents = F.round(F.col("o_totalprice") * 100).cast("bigint")
    whole = F.floor(cents / 100)
    amount = F.concat(
        F.lit("-"), _t(F.floor(whole / 1000)), F.lit(NBSP), F.lpad(_t(whole % 1000), 3, "0"), F.lit(","),
        F.lpad(_t(cents % 100), 2, "0"))
    day = F.substring(_t(F.col("o_orderdate")), 1, 10)
    rows = led.read("orders").select(
        F.concat(F.lit("f"), _t(F.col("o_custkey"))).alias("file"), (key + 10).alias("row_idx"),
        F.array(
            F.when(key % 50 == 1, "").otherwise(day), F.when(key % 4 == 0, "").otherwise(day), _t(key),
            F.when(key % 50 == 2, "").otherwise(F.concat(F.col("o_orderpriority"), F.lit(" köp"))), F.lit("x"),
            F.when(key % 50 == 3, "abc").otherwise(amount), F.when(key % 3 == 0, "").otherwise("12.5"),
        ).alias("cells"))
    return heads.unionByName(rows)


SHEETS = """
parsed AS (
  SELECT 'f' || o_custkey AS file, o_orderkey + 10 AS row_idx, '5000 ' || o_custkey AS account_id, day AS booking_date,
         day AS value_date, CAST(o_orderkey AS VARCHAR) AS reference, o_orderpriority || ' köp' AS text,
         CAST(trunc(CAST('-' || (cents // 100) || '.' || lpad(CAST(cents % 100 AS VARCHAR), 2, '0') AS DOUBLE) * 100)
           AS BIGINT) AS amount,
         CASE WHEN o_orderkey % 3 = 0 THEN 0 ELSE 1250 END AS balance
  FROM (SELECT *, substr(CAST(o_orderdate AS VARCHAR), 1, 10) AS day, CAST(round(o_totalprice * 100) AS BIGINT) AS cents
        FROM orders)
  WHERE o_orderkey % 50 NOT IN (1, 2, 3) AND o_custkey % 10 <> 9),
hashed AS (
  SELECT md5(value_date || reference || text || amount || balance) AS id, * FROM parsed)"""


def parsed_rows(led: GivenLedger) -> DataFrame:
    return ingest.parse_ledger_rows(ingest.sheet_records(sheet_cells(led)))[0]


@register("sheet_records", ledger_sql("""
    SELECT 'f' || o_custkey AS file, o_orderkey + 10 AS row_idx,
           CASE WHEN o_orderkey % 50 = 1 THEN '' ELSE substr(CAST(o_orderdate AS VARCHAR), 1, 10) END AS booked,
           CAST(o_orderkey AS VARCHAR) AS voucher, 6 AS fields FROM orders
    UNION ALL SELECT 'f' || c_custkey, 2, 'Bokföringsdag', 'Verifikationsnummer', 6 FROM customer
    UNION ALL SELECT 'f' || c_custkey, 1, CASE WHEN c_custkey % 10 = 9 THEN 'Konto'
      ELSE 'Konto (5000 ' || c_custkey || ')' END, NULL, 2 FROM customer
    UNION ALL SELECT 'f' || c_custkey, 0, 'Export', NULL, 2 FROM customer"""))
def _(led: GivenLedger) -> DataFrame:
    record = F.col("record")
    return ingest.sheet_records(sheet_cells(led)).select(
        "file", "row_idx", record["Bokföringsdag"].alias("booked"),
        F.try_element_at(record, F.lit("Verifikationsnummer")).alias("voucher"),
        F.size("record").alias("fields"))


@register("parse_ledger_rows", ledger_sql("SELECT * FROM hashed", SHEETS))
def _(led: GivenLedger) -> DataFrame:
    return parsed_rows(led)


@register("parse_ledger_rows_rejected", ledger_sql("""
    SELECT 'f' || c_custkey AS file, 'no account number' AS reason FROM customer WHERE c_custkey % 10 = 9"""))
def _(led: GivenLedger) -> DataFrame:
    return ingest.parse_ledger_rows(ingest.sheet_records(sheet_cells(led)))[1]


@register("csv_records", """
    SELECT CAST(doc_id AS VARCHAR) AS file, CAST(r AS BIGINT) AS row_idx, CASE WHEN r = 1 THEN 3 ELSE 2 END AS fields,
           CASE WHEN r = 1 THEN md5(trim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13))) END AS body
    FROM documents, range(1, 3) t(r)""")
def _(led: GivenLedger) -> DataFrame:
    """Every document as a CSV file of a header, a row with its quoted text, and a short row."""
    quoted = F.concat(F.lit('"'), F.replace("text", F.lit('"'), F.lit('""')), F.lit('"'))
    content = F.concat(F.lit("id,text,rest\n1,"), quoted, F.lit(",x\n\n2,y\n"))
    files = led.read("documents").select(_t(F.col("doc_id")).alias("file"), F.encode(content, "utf-8").alias("content"))
    record = F.col("record")
    return ingest.csv_records(csv_cells(files)).select(
        "file", "row_idx", F.size("record").alias("fields"),
        F.when(F.col("row_idx") == 1, F.md5(record["text"])).alias("body"))


@register("read_statement_csv", """
    SELECT CAST(o_orderkey AS VARCHAR) AS reference, o_orderpriority || ', "' || o_orderstatus || '"' AS text,
           CAST(o_custkey AS VARCHAR) AS customer FROM orders""")
def _(led: GivenLedger) -> DataFrame:
    """Orders written as CSV files with quotes and commas, and read back as statements."""
    path = scratch_dir(led.spark, "statements")
    led.read("orders").select(
        F.col("o_orderkey").alias("Reference"), F.concat("o_orderpriority", F.lit(', "'), "o_orderstatus", F.lit('"')).alias("Text"),
        F.col("o_custkey").alias("Customer")).write.option("header", True).option("escape", '"').csv(path)
    record = F.col("record")
    return ingest.csv_records(read_statement_csv(led.spark, path)).select(
        record["Reference"].alias("reference"), record["Text"].alias("text"), record["Customer"].alias("customer"))


@register("read_statement_text", """
    SELECT CAST(doc_id AS VARCHAR) AS file, md5(text || chr(10)) AS body FROM documents""")
def _(led: GivenLedger) -> DataFrame:
    """Every document written as a text file of its own, and read back whole."""
    path = scratch_dir(led.spark, "texts")
    name = F.concat(F.lit("doc_id="), F.coalesce(_t(F.col("doc_id")), F.lit("none")))
    write_statement_text(led.read("documents").select(name.alias("file"), "text"), path)
    return read_statement_text(led.spark, path).select(
        F.regexp_extract("file", "doc_id=([0-9]+)", 1).alias("file"), F.md5("text").alias("body"))


_PORTFOLIO = """
portfolio AS (
  SELECT 'doc' || doc_id AS file, doc_id,
         CASE WHEN doc_id % 9 = 1 THEN NULL ELSE CAST(doc_id AS VARCHAR) END AS account_id,
         '2024-' || lpad(CAST(doc_id % 12 + 1 AS VARCHAR), 2, '0') AS month,
         CAST(trunc(CAST(n_chars || '.75' AS DOUBLE) * 100) AS BIGINT) AS balance FROM documents)"""


def _portfolio(led: GivenLedger) -> tuple[DataFrame, DataFrame]:
    """Each document with a portfolio head before its whole text."""
    key = F.col("doc_id")
    month = F.lpad(_t(key % 12 + 1), 2, "0")
    head = F.concat(
        F.when(key % 9 == 1, "Konto saknas ").otherwise(F.concat(F.lit("KontoKontotyp "), _t(key), F.lit("ISK "))),
        F.when(key % 9 == 2, "Total ").otherwise(F.concat(
            F.lit(f"Totalt1{NBSP}000,00"), F.floor(F.col("n_chars") / 1000).cast("string"), F.lit(NBSP),
            F.lpad(_t(F.col("n_chars") % 1000), 3, "0"), F.lit(",75Ränta "))),
        F.when(key % 9 == 3, "Värde okänt ").otherwise(F.concat(F.lit("Värde 2024-"), month, F.lit("-15 "))))
    return ingest.parse_portfolio_text(led.read("documents").select(
        F.concat(F.lit("doc"), _t(key)).alias("file"), F.concat(head, "text").alias("text")))


@register("parse_portfolio_text", ledger_sql("""
    SELECT file, account_id, month, balance FROM portfolio WHERE doc_id % 9 NOT IN (1, 2, 3)""", _PORTFOLIO))
def _(led: GivenLedger) -> DataFrame:
    return _portfolio(led)[0]


@register("parse_portfolio_rejected", ledger_sql("""
    SELECT file, CASE doc_id % 9 WHEN 1 THEN 'no account number' WHEN 2 THEN 'no total' ELSE 'no month' END AS reason
    FROM portfolio WHERE doc_id % 9 IN (1, 2, 3)""", _PORTFOLIO))
def _(led: GivenLedger) -> DataFrame:
    return _portfolio(led)[1]


def line_transform(text: str, log) -> dict:
    """A user transform: every non-empty line is a transaction of its length."""
    lines = [line for line in text.split("\n") if line]
    log(f"{len(lines)} lines")
    if not lines:
        raise ValueError("empty statement")
    return {
        "type": "checking", "account_id": f"acc-{len(lines) % 7}",
        "transactions": [
            {"booking_date": "2024-02-01", "value_date": "2024-02-01", "reference": str(i), "text": line,
             "amount": len(line), "balance": i} for i, line in enumerate(lines)],
    }


@register("apply_user_parser", """
    WITH lines AS (
      SELECT doc_id, line FROM (SELECT doc_id, UNNEST(string_split(text, chr(10))) AS line FROM documents)
      WHERE line <> '')
    SELECT CAST(doc_id AS VARCHAR) AS file, 'acc-' || (count(*) % 7) AS account_id, count(*) AS rows,
           CAST(sum(length(line)) AS BIGINT) AS amount FROM lines GROUP BY doc_id""")
def _(led: GivenLedger) -> DataFrame:
    statements = led.read("documents").select(_t(F.col("doc_id")).alias("file"), "text")
    rows = ingest.user_parsed_rows(ingest.apply_user_parser(statements, line_transform))
    return rows.groupBy("file", "account_id").agg(
        F.count(F.lit(1)).alias("rows"), F.sum("amount").alias("amount"))


_LOGS = """
    SELECT CAST(doc_id AS VARCHAR) AS file, CAST(0 AS INT) AS line_no, n || ' lines' AS line,
           CASE WHEN n = 0 THEN 'ValueError: empty statement' END AS error
    FROM (SELECT doc_id, len(list_filter(string_split(text, chr(10)), lambda x: x <> '')) AS n FROM documents)"""


@register("parser_logs", _LOGS)
def _(led: GivenLedger) -> DataFrame:
    """Every line that a user's transform logs, with the statement's error."""
    statements = led.read("documents").select(_t(F.col("doc_id")).alias("file"), "text")
    return ingest.parser_logs(ingest.apply_user_parser(statements, line_transform))


def _called(led: GivenLedger, query: str) -> DataFrame:
    """A query over the given documents as the view `statements`, with the transform as a table function."""
    parser_function.register_parser(led.spark, "parse_statements", line_transform)
    led.read("documents").select(_t(F.col("doc_id")).alias("file"), "text", "lang").createOrReplaceTempView("statements")
    return led.spark.sql(query)


@register("parser_function_logs", _LOGS)
def _(led: GivenLedger) -> DataFrame:
    """The same lines from SQL, by the transform as a table function."""
    return _called(led, "SELECT * FROM parse_statements(TABLE(statements), 'logs')")


@register("parser_function", """
    WITH lines AS (
      SELECT doc_id, line FROM (SELECT doc_id, UNNEST(string_split(text, chr(10))) AS line FROM documents)
      WHERE line <> '')
    SELECT CAST(doc_id AS VARCHAR) AS file, 'acc-' || (count(*) % 7) AS account_id, count(*) AS rows,
           CAST(sum(length(line)) AS BIGINT) AS amount FROM lines GROUP BY doc_id""")
def _(led: GivenLedger) -> DataFrame:
    """Transactions of a user's transform, called from SQL."""
    return _called(led, """
        SELECT file, account_id, count(*) AS rows, sum(amount) AS amount
        FROM parse_statements(TABLE(SELECT file, text FROM statements), 'rows') GROUP BY file, account_id""")


@register("preview_parse", """
    WITH lines AS (
      SELECT doc_id, line FROM (SELECT doc_id, UNNEST(string_split(text, chr(10))) AS line FROM documents)
      WHERE line <> '')
    SELECT CAST(doc_id AS VARCHAR) AS file, 'Other' AS category, count(*) AS rows FROM lines GROUP BY doc_id""")
def _(led: GivenLedger) -> DataFrame:
    statements = led.read("documents").select(_t(F.col("doc_id")).alias("file"), "text")
    rows = ingest.user_parsed_rows(ingest.apply_user_parser(statements, line_transform))
    return ingest.preview_parse(rows).groupBy("file", "category").agg(F.count(F.lit(1)).alias("rows"))


# ---- loading ------------------------------------------------------------------------
@register("ensure_accounts", ledger_sql("""
    SELECT id, name, account_type, space_id FROM accounts
    UNION ALL SELECT DISTINCT account_id, account_id, 'checking', 's0' FROM hashed""", SHEETS))
def _(led: GivenLedger) -> DataFrame:
    statements = parsed_rows(led).select(
        "account_id", F.lit("checking").alias("account_type"), F.lit("bank").alias("account_source"),
        F.lit("SEK").alias("currency"), F.lit("s0").alias("space_id"))
    return ingest.ensure_accounts(led.accounts, statements).select("id", "name", "account_type", "space_id")


_DELIVERIES = """
deliveries AS (
  SELECT * FROM hashed UNION ALL SELECT * REPLACE ('again-' || file AS file) FROM hashed WHERE row_idx % 3 = 0),
stored AS (
  SELECT id, amount, text, account_id FROM hashed WHERE row_idx % 5 = 0),
fresh AS (
  SELECT * FROM deliveries WHERE id NOT IN (SELECT id FROM stored)
  QUALIFY row_number() OVER (PARTITION BY id ORDER BY file, row_idx) = 1)"""


def _deliveries(led: GivenLedger) -> tuple[DataFrame, DataFrame]:
    """(ledger, batch): a fifth of the rows is known, a third is delivered twice."""
    rows = settle(parsed_rows(led), "staged")
    known = rows.where("row_idx % 5 = 0").select(
        "id", "booking_date", "value_date", "reference", "text", F.lit("SEK").alias("currency"), "amount",
        "balance", F.lit(True).alias("approved"), F.lit("").alias("note"), F.lit("Shopping").alias("category"),
        "account_id")
    again = rows.where("row_idx % 3 = 0").withColumn("file", F.concat(F.lit("again-"), "file"))
    return known, rows.unionByName(again)


@register("import_transactions", ledger_sql("""
    SELECT id, text, amount, account_id, true AS approved, 'Shopping' AS category FROM stored
    UNION ALL SELECT id, text, amount, account_id, false,
      CASE WHEN row_idx % 2 = 0 THEN 'Leisure' ELSE 'Other' END FROM fresh""", SHEETS, _DELIVERIES))
def _(led: GivenLedger) -> DataFrame:
    """Even rows have a predicted category, the others get the fallback."""
    known, batch = _deliveries(led)
    predicted = batch.where("row_idx % 2 = 0").select("id", F.lit("Leisure").alias("category")).distinct()
    return ingest.import_transactions(known, batch, predicted=predicted).select(
        "id", "text", "amount", "account_id", "approved", "category")


@register("import_counts", ledger_sql("""
    SELECT d.file, count(f.id) AS inserted, count(*) - count(f.id) AS skipped
    FROM deliveries d LEFT JOIN fresh f ON f.id = d.id AND f.file = d.file AND f.row_idx = d.row_idx
    GROUP BY 1""", SHEETS, _DELIVERIES))
def _(led: GivenLedger) -> DataFrame:
    return ingest.import_counts(*_deliveries(led))


@register("import_summaries", ledger_sql("""
    SELECT account_id, month, balance FROM account_summaries WHERE NOT EXISTS (
      SELECT 1 FROM news n WHERE n.account_id = account_summaries.account_id AND n.month = account_summaries.month)
    UNION ALL SELECT account_id, month, balance FROM news""", _PORTFOLIO, """
news AS (
  SELECT 'a' || (doc_id % 40) AS account_id, month, balance FROM portfolio WHERE doc_id % 9 NOT IN (1, 2, 3)
  QUALIFY row_number() OVER (PARTITION BY doc_id % 40, month ORDER BY file DESC) = 1)"""))
def _(led: GivenLedger) -> DataFrame:
    portfolios = _portfolio(led)[0].withColumn("account_id", F.concat(
        F.lit("a"), _t(F.col("account_id").cast("bigint") % 40)))
    return ingest.import_summaries(led.account_summaries, portfolios).select(
        "account_id", "month", "balance")


def _units(led: GivenLedger, user: bool) -> DataFrame:
    key = F.col("p_partkey")
    parts = led.read("part").where(key % 3 == 0) if user else led.read("part")
    return parts.select(
        F.concat(F.lit("unit"), _t(key)).alias("key"),
        F.concat(F.lit("user " if user else ""), "p_name").alias("name"), F.col("p_brand").alias("bank"),
        F.lit("checking").alias("account_type"))


@register("resolve_parsers", """
    SELECT 'unit' || p_partkey AS key, CASE WHEN p_partkey % 3 = 0 THEN 'user ' ELSE '' END || p_name AS name,
           p_brand AS bank, 'checking' AS account_type, p_partkey % 3 <> 0 AS is_builtin FROM part""")
def _(led: GivenLedger) -> DataFrame:
    return ingest.resolve_parsers(_units(led, False), _units(led, True))


@register("attach_parsers", """
    SELECT CAST(l_orderkey AS VARCHAR) || '-' || l_linenumber AS file, 'unit' || (l_partkey * 2) AS key,
           CASE WHEN p_partkey IS NULL THEN 'unknown parser key: unit' || (l_partkey * 2) ELSE 'ok' END AS reason
    FROM lineitem LEFT JOIN part ON p_partkey = l_partkey * 2""")
def _(led: GivenLedger) -> DataFrame:
    statements = led.read("lineitem").select(
        F.concat_ws("-", _t(F.col("l_orderkey")), _t(F.col("l_linenumber"))).alias("file"),
        F.concat(F.lit("unit"), _t(F.col("l_partkey") * 2)).alias("key"))
    found, unknown = ingest.attach_parsers(
        statements, ingest.resolve_parsers(_units(led, False), _units(led, True)))
    return found.select("file", "key", F.lit("ok").alias("reason")).unionByName(
        unknown.select("file", "key", "reason"))
