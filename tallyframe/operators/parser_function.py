"""User parsers as SQL table functions.

`SELECT * FROM parse_statements(TABLE(statements), 'rows')` runs a user's transform over the
statements where they lie: no partitioning is asked for, as a statement is one row. The second
argument picks what comes out, and with it the columns: the transactions, the month values of
investment statements, or the logged lines and errors.
"""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql import types as T
from pyspark.sql.functions import udtf
from pyspark.sql.udtf import AnalyzeArgument, AnalyzeResult

from .ingest import Transform, parse_statement

_FILE = T.StructField("file", T.StringType())


def _shape(*columns: tuple[str, T.DataType]) -> T.StructType:
    return T.StructType([_FILE, *[T.StructField(n, kind) for n, kind in columns]])


_TEXT, _LONG, _INT = T.StringType(), T.LongType(), T.IntegerType()
_TRANSACTION = [("booking_date", _TEXT), ("value_date", _TEXT), ("reference", _TEXT), ("text", _TEXT), ("amount", _LONG), ("balance", _LONG)]
SHAPES = {
    "rows": _shape(("account_id", _TEXT), ("row_idx", _INT), *_TRANSACTION),
    "months": _shape(("account_id", _TEXT), ("month", _TEXT), ("balance", _LONG)),
    "logs": _shape(("line_no", _INT), ("line", _TEXT), ("error", _TEXT)),
}


def parser_function(transform: Transform):
    """A table function over (file, text, ...) rows; see SHAPES for what its second argument may be."""

    class Parse:
        @staticmethod
        def analyze(statements: AnalyzeArgument, what: AnalyzeArgument) -> AnalyzeResult:
            if not statements.isTable or not {"file", "text"} <= set(statements.dataType.names):
                raise ValueError("the first argument is a table with the columns file and text")
            if not what.isConstantExpression or what.value not in SHAPES:
                raise ValueError(f"the second argument is one of {', '.join(SHAPES)}")
            return AnalyzeResult(SHAPES[what.value])

        def eval(self, statement, what):
            got = parse_statement(transform, statement["file"], statement["text"])
            if what == "logs":
                lines = list(enumerate(got["logs"])) or [(None, None)]
                for number, line in lines:
                    yield got["file"], number, line, got.get("error")
            elif what == "months" and got.get("kind") == "investment":
                yield got["file"], got["account_id"], got["month"], got["balance"]
            elif what == "rows":
                for number, row in enumerate(got.get("transactions") or []):
                    yield (got["file"], got["account_id"], number, *[row.get(n) for n, _ in _TRANSACTION])

    return udtf(Parse)


def register_parser(spark: SparkSession, name: str, transform: Transform) -> None:
    """Make a user's transform callable from SQL under a name."""
    spark.udtf.register(name, parser_function(transform))
