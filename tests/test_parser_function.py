from __future__ import annotations

import pytest

from helpers import rows
from tallyframe.operators import ingest, parser_function


@pytest.fixture
def called(spark):
    def transform(text, log):
        log(f"read {text}")
        if text == "bad":
            raise ValueError("no")
        if text == "quiet":
            raise KeyError("x")
        log("done")
        if text == "fund":
            return {"type": "investment", "account_id": "a", "month": "2024-01", "balance": 7}
        return {"type": "checking", "account_id": "b", "transactions": [{"text": text, "amount": 1}, {"text": text, "amount": 2, "balance": 5}]}

    spark.createDataFrame([("f1", "ok", 1), ("f2", "bad", 2), ("f3", "fund", 3)], "file string, text string, extra int").createOrReplaceTempView("some_statements")
    parser_function.register_parser(spark, "parse_some", transform)
    return lambda what: spark.sql(f"SELECT * FROM parse_some(TABLE(some_statements), '{what}')")


def test_the_second_argument_picks_rows_and_columns(called):
    assert called("rows").columns == parser_function.SHAPES["rows"].names
    assert rows(called("rows"), "file", "account_id", "row_idx", "amount", "balance") == [("f1", "b", 0, 1, None), ("f1", "b", 1, 2, 5)]
    assert rows(called("months")) == [("f3", "a", "2024-01", 7)]
    assert rows(called("logs")) == [("f1", 0, "read ok", None), ("f1", 1, "done", None), ("f2", 0, "read bad", "ValueError: no"),
                                    ("f3", 0, "read fund", None), ("f3", 1, "done", None)]


def test_wrong_arguments_are_refused(spark, called):
    with pytest.raises(Exception, match="one of rows, months, logs"):
        called("dreams")
    with pytest.raises(Exception, match="file and text"):
        spark.sql("SELECT * FROM parse_some(TABLE(SELECT file FROM some_statements), 'rows')")


def test_a_statement_without_log_keeps_its_error(spark):
    results = ingest.apply_user_parser(spark.createDataFrame([("f", "t")], "file string, text string"), lambda text, log: 1 / 0)
    assert rows(ingest.parser_logs(results)) == [("f", None, None, "ZeroDivisionError: division by zero")]
