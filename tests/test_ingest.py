from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from helpers import rows
from tallyframe.operators import ingest
from tallyframe.sources.statements import csv_cells, read_statement_csv, read_statement_text, write_statement_text

CELLS = "file string, row_idx long, cells array<string>"


def records(frame):
    return {(r.file, r.row_idx): r.record for r in frame.collect()}


def test_csv_layout_from_files(spark, tmp_path):
    (tmp_path / "a.csv").write_bytes(
        "﻿Date, Text ,,Date\n 2024-01-01 ,\"x, \"\"y\"\" \",b,c,extra\n\n2024-01-02\n".encode())
    (tmp_path / "b.csv").write_bytes(b"One\n1\n")
    got = records(ingest.csv_records(read_statement_csv(spark, str(tmp_path))))
    by_name = {(k[0].rsplit("/", 1)[1], k[1]): v for k, v in got.items()}
    assert by_name == {
        ("a.csv", 1): {"Date": "c", "Text": 'x, "y"', "": "b", "4": "extra"},
        ("a.csv", 2): {"Date": "2024-01-02"},
        ("b.csv", 1): {"One": "1"},
    }


def test_csv_cells_leave_in_slices(spark):
    body = "h\n" + "\n".join(str(i) for i in range(45_000))
    files = spark.createDataFrame([("f", bytearray(body.encode()))], "file string, content binary")
    cells = csv_cells(files)
    assert cells.count() == 45_001 and cells.agg(F.countDistinct("row_idx")).first()[0] == 45_001


def test_text_statements_are_whole(spark, tmp_path):
    (tmp_path / "s.txt").write_text("first\nsecond\n")
    assert [r.text for r in read_statement_text(spark, str(tmp_path)).collect()] == ["first\nsecond\n"]


def test_sheet_layout_finds_the_header_and_keeps_metadata_rows(spark):
    frame = spark.createDataFrame([
        ("f", 0, ["Account (5000 1)", ""]), ("f", 1, ["", ""]), ("f", 2, ["Date", "Text", "", "Sum", "Sum"]),
        ("f", 3, ["d", "t", "dropped", "1", "2", "past"]), ("f", 4, ["d2", "t2", "", "9"]),
        ("g", 0, ["A", "B"]), ("g", 1, ["1", "2"]),
    ], CELLS)
    assert records(ingest.sheet_records(frame)) == {
        ("f", 0): {"Date": "Account (5000 1)", "Text": ""},
        ("f", 2): {"Date": "Date", "Text": "Text", "Sum": "Sum"},
        ("f", 3): {"Date": "d", "Text": "t", "Sum": "2", "5": "past"},
        ("f", 4): {"Date": "d2", "Text": "t2", "Sum": "9"},
        ("g", 0): {"A": "A", "B": "B"}, ("g", 1): {"A": "1", "B": "2"},
    }


def ledger_records(spark):
    head = {"Bokföringsdag": "Konto (5000 1 )", "Text": ""}
    return spark.createDataFrame([
        ("f", 0, head),
        ("f", 3, {"Bokföringsdag": "2024-01-02", "Text": "shop", "Belopp": "-1 234,50", "Saldo": "10",
                  "Verifikationsnummer": "v1"}),
        ("f", 4, {"Booking date": "2024-01-03", "Value date": "2024-01-05", "Text": "x", "Amount": "19.99"}),
        ("f", 5, {"Bokföringsdag": "2024-01-04", "Text": ""}),
        ("f", 6, {"Bokföringsdag": "", "Text": "x"}),
        ("f", 7, {"Bokföringsdag": "2024-01-04", "Text": "bad", "Belopp": "abc"}),
        ("late", 11, {"Text": "no number"}),
    ], "file string, row_idx long, record map<string,string>")


def test_ledger_rows(spark):
    parsed, lost = ingest.parse_ledger_rows(ledger_records(spark))
    got = rows(parsed, "row_idx", "account_id", "value_date", "reference", "amount", "balance")
    assert got == [(3, "5000 1", "2024-01-02", "v1", -123450, 1000), (4, "5000 1", "2024-01-05", "", 1998, 0)]
    assert rows(lost) == [("late", "no account number")]
    exact, _ = ingest.parse_ledger_rows(ledger_records(spark), exact=True)
    assert rows(exact, "amount") == [(-123450,), (1999,)]


def test_account_number_beyond_the_tenth_record_is_not_seen(spark):
    many = [("f", i, {"a": "x"}) for i in range(10)] + [("f", 10, {"a": "(123)"})]
    frame = spark.createDataFrame(many, "file string, row_idx long, record map<string,string>")
    assert rows(ingest.statement_accounts(frame)) == []
    assert rows(ingest.statement_accounts(frame.where("row_idx > 0"))) == [("f", "123")]


def test_two_account_cells_take_the_lowest_column(spark):
    cells = spark.createDataFrame([("f", 0, ["A", "B", "C"]), ("f", 1, ["", "(2)", "(3)"])], CELLS)
    assert rows(ingest.statement_accounts(ingest.sheet_records(cells))) == [("f", "2")]


@pytest.mark.parametrize("text, want", [
    ("KontoKontotyp123ISK Totalt1 000,002 345,67Ränta Värde 2024-05-31 V", ("123", "2024-05", 234567)),
    ("Kontotyp Totalt1,002,00R Värde 2024-05-31", "no account number"),
    ("Konto Kontotyp 1 Värde 2024-05-31", "no total"),
    ("Konto Kontotyp 1 Totalt 1,00 2,00R Varde 2024-05", "no month"),
    ("Konto Kontotyp 1 Totalt 1,00 ,,R Varde 2024-05-01", "total is not a number"),
    ("", "no text"), (None, "no text"),
])
def test_portfolio_text(spark, text, want):
    good, bad = ingest.parse_portfolio_text(spark.createDataFrame([("f", text)], "file string, text string"))
    if isinstance(want, tuple):
        assert rows(good, "account_id", "month", "balance") == [want] and bad.count() == 0
    else:
        assert rows(bad) == [("f", want)] and good.count() == 0


def test_user_parser_kinds_logs_and_errors(spark):
    def transform(text, log):
        log(f"read {text}")
        if text == "boom":
            raise KeyError("nothing")
        if text == "odd":
            return {"type": "loan"}
        if text == "inv":
            return {"type": "investment", "account_id": "a", "month": "2024-01", "balance": 7}
        return {"type": "savings", "account_id": "a", "transactions": [
            {"booking_date": "d", "value_date": "d", "reference": "", "text": text, "amount": 1, "balance": 2}]}

    files = spark.createDataFrame([(t, t) for t in ("boom", "odd", "inv", "ok")], "file string, text string")
    got = {r.file: r for r in ingest.apply_user_parser(files, transform).collect()}
    assert got["boom"].error.startswith("KeyError") and got["odd"].error.startswith("ValueError")
    assert (got["inv"].kind, got["inv"].month, got["inv"].balance) == ("investment", "2024-01", 7)
    assert got["ok"].logs == ["read ok"] and got["ok"].error is None
    assert rows(ingest.user_parsed_rows(ingest.apply_user_parser(files, transform)), "file", "text", "amount") == [
        ("ok", "ok", 1)]


def test_import_skips_duplicates_and_counts_them(spark, table):
    ledger = table("transactions", {"id": "old", "text": "kept", "category": "Food", "approved": True})
    batch = spark.createDataFrame(
        [("old", "f", 1), ("new", "f", 2), ("new", "f", 5), ("new", "g", 0), ("two", "g", 1)],
        "id string, file string, row_idx long").withColumns({
            "account_id": F.lit("a"), "booking_date": F.lit("d"), "value_date": F.lit("d"), "reference": F.lit(""),
            "text": F.col("file"), "amount": F.lit(1).cast("long"), "balance": F.lit(1).cast("long")})
    out = ingest.import_transactions(ledger, batch)
    assert rows(out, "id", "text", "category", "approved") == [
        ("new", "f", "Other", False), ("old", "kept", "Food", True), ("two", "g", "Other", False)]
    assert rows(ingest.import_counts(ledger, batch)) == [("f", 1, 2), ("g", 1, 1)]


def test_existing_accounts_stay_untouched(spark, table):
    accounts = table("accounts", {"id": "a", "name": "Mine", "space_id": "s"})
    statements = spark.createDataFrame([("a", "checking", "bank", "SEK", "t"), ("b", "savings", "bank", "SEK", "t")],
                                       "account_id string, account_type string, account_source string, currency string, space_id string")
    assert rows(ingest.ensure_accounts(accounts, statements), "id", "name", "space_id") == [
        ("a", "Mine", "s"), ("b", "b", "t")]


def test_user_units_override_builtin_ones(spark):
    schema = "key string, name string, bank string"
    units = ingest.resolve_parsers(
        spark.createDataFrame([("k1", "B", "Z"), ("k2", "A", "Z")], schema),
        spark.createDataFrame([("k1", "Own", "A")], schema))
    assert [(r.key, r.name, r.is_builtin) for r in units.collect()] == [("k1", "Own", False), ("k2", "A", True)]
    found, unknown = ingest.attach_parsers(
        spark.createDataFrame([("f", "k1"), ("g", "zz")], "file string, key string"), units)
    assert rows(found, "file") == [("f",)] and rows(unknown, "reason") == [("unknown parser key: zz",)]


def test_written_text_statements_are_read_back(spark, tmp_path):
    files = spark.createDataFrame([("a", "x\ny"), ("b", None), ("c", ""), ("d", "é"), ("d", "2")] + [(f"n{i}", str(i)) for i in range(200)],
                                  "file string, text string")
    for at in (str(tmp_path / "plain"), f"file:{tmp_path}/uri"):
        write_statement_text(files, at)
        got = {r.file.rsplit("/", 1)[1]: r.text for r in read_statement_text(spark, at).collect()}
        assert got == {"a.txt": "x\ny\n", "b.txt": "\n", "c.txt": "\n", "d.txt": got["d.txt"], **{f"n{i}.txt": f"{i}\n" for i in range(200)}}
        assert got["d.txt"] in ("é\n2\n", "2\né\n")


def test_text_statements_are_listed_and_read_in_tasks(spark, tmp_path):
    """The rows of Spark's reader, which would list every file on the driver."""
    import gzip
    import zlib

    names = ["plain.txt", "with space.txt", "100%.txt", "a#b.txt", "å+é.txt", "x=1,y;z.txt", "q?.txt", "[b].txt", "a%20b.txt", ".hidden", "_hidden", "_k=v.txt"]
    for folder in ("flat", "dealt/task=0", "dealt/task=a b", "dealt/_task=2/part=9", "flat/deeper"):
        (tmp_path / folder).mkdir(parents=True)
        for name in names:
            (tmp_path / folder / name).write_bytes(f"{folder} {name}\n\r\nend".encode() + b"\xff\xfe")
        (tmp_path / folder / "empty.txt").touch()
        (tmp_path / folder / "a [b] 1%.deflate").write_bytes(zlib.compress(b"deflated"))
        (tmp_path / folder / "old.txt.gz").write_bytes(gzip.compress(b"old ") + gzip.compress(b"text"))
    (tmp_path / "none").mkdir()
    columns = [F.col("_metadata.file_path").alias("file"), F.md5("value").alias("text")]
    for path in ("flat", "dealt/task=0", "none", "flat/plain.txt", "flat/*.gz", "dealt/task=*", "fl{at,ow}"):
        got = read_statement_text(spark, f"{tmp_path}/{path}")
        want = spark.read.text(f"{tmp_path}/{path}", wholetext=True).select(*columns)
        assert rows(got.withColumn("text", F.md5("text"))) == rows(want), path
        assert not [f for f in got.inputFiles() if ".txt" in f]  # the driver knows none of them
    assert read_statement_text(spark, f"{tmp_path}/dealt").count() == 36
    assert read_statement_text(spark, f"file://{tmp_path}/flat").count() == 12
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        read_statement_text(spark, f"{tmp_path}/missing")
