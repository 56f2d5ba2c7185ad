"""Export and import of whole spaces as JSON documents."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.filters import scope_to_space, visible_spaces
from ..operators.mutate import Tables, upsert
from ..schemas import EXPORT_VERSION, LONG, TABLES

SECTIONS = ["categories", "accounts", "transactions", "account_summaries"]
_ROW_FIELDS = {
    "categories": ["id", "name", "color"],
    "accounts": ["id", "name", "currency", "account_type", "account_source", "color"],
    "transactions": [f.name for f in TABLES["transactions"].fields],
    "account_summaries": ["month", "account_id", "balance"],
}


def _newest(text: Column) -> Column:
    """Reverses the order of fixed-width digit texts such as ISO dates."""
    return F.translate(text, "0123456789", "9876543210")


def export_rows(tables: Tables) -> DataFrame:
    """(space_id, section, sort_key, line): one JSON object per exported row of a live space.

    A missing category is exported as an empty text, and flags as 0 / 1.
    """
    live = visible_spaces(tables["spaces"]).select(F.col("id").alias("space_id"))
    accounts = tables["accounts"]
    named = accounts.select(F.col("id").alias("account_id"), F.col("name").alias("_account"))
    frames = {
        "categories": (tables["categories"], F.concat_ws("\x01", "name", "id")),
        "accounts": (accounts, F.concat_ws("\x01", "name", "id")),
        "transactions": (
            scope_to_space(tables["transactions"], accounts)
            .withColumn("approved", F.col("approved").cast("bigint"))
            .withColumn("category", F.coalesce("category", F.lit(""))),
            F.concat_ws("\x01", _newest(F.col("booking_date")), _newest(F.col("value_date")), "id"),
        ),
        "account_summaries": (
            scope_to_space(tables["account_summaries"], accounts).join(named, "account_id"),
            F.concat_ws("\x01", _newest(F.col("month")), "_account", "account_id"),
        ),
    }
    parts = []
    for position, section in enumerate(SECTIONS):
        rows, key = frames[section]
        parts.append(rows.select(
            "space_id", F.lit(2 * position + 1).alias("section"), key.alias("sort_key"),
            F.to_json(F.struct(*_ROW_FIELDS[section]), {"ignoreNullFields": "false"}).alias("line"),
        ))
    return reduce(DataFrame.unionByName, parts).join(live, "space_id", "left_semi").select(
        "space_id", "section", "sort_key", "line")


def export_counts(rows: DataFrame) -> DataFrame:
    return rows.groupBy("space_id").agg(*[
        F.count_if(F.col("section") == 2 * i + 1).alias(name) for i, name in enumerate(SECTIONS)
    ])


def document_lines(tables: Tables, exported_at: str) -> DataFrame:
    """The lines of one JSON document per space, to be read in (section, sort_key) order.

    The document is never assembled: brackets are lines of their own, and all rows of a
    section but the first start with a comma. The first row is found by a combining min.
    """
    rows = export_rows(tables)
    heads = rows.groupBy("space_id", "section").agg(F.min("sort_key").alias("sort_key")).withColumn(
        "_first", F.lit(True))
    separated = rows.join(heads, ["space_id", "section", "sort_key"], "left").withColumn(
        "line", F.when(F.col("_first"), F.col("line")).otherwise(F.concat(F.lit(","), "line")))
    spaces = visible_spaces(tables["spaces"])
    opening = F.concat(
        F.lit(f'{{"version":{EXPORT_VERSION},"exported_at":"{exported_at}","space":'),
        F.to_json(F.struct("name")), F.lit(f',"{SECTIONS[0]}":['),
    )
    brackets = [(0, opening)]
    brackets += [(2 * i, F.lit(f'],"{name}":[')) for i, name in enumerate(SECTIONS) if i > 0]
    brackets.append((2 * len(SECTIONS), F.lit("]}")))
    frame = F.explode(F.array(*[
        F.struct(F.lit(n).alias("section"), text.alias("line")) for n, text in brackets
    ]))
    around = spaces.select(F.col("id").alias("space_id"), frame.alias("b")).select(
        "space_id", "b.section", F.lit("").alias("sort_key"), "b.line")
    return separated.select("space_id", "section", "sort_key", "line").unionByName(around)


def export_spaces(tables: Tables, path: str, exported_at: str) -> None:
    """Write each space as ordered text parts under `space_id=…`.

    Parts are range-partitioned by position, so a large space is written by many tasks;
    its files, read in name order, are one valid JSON document.
    """
    order = ["space_id", "section", "sort_key"]
    (document_lines(tables, exported_at)
     .repartitionByRange(*order).sortWithinPartitions(*order)
     .select("space_id", "line").write.partitionBy("space_id").text(path))


def _row_schema() -> T.StructType:
    fields: dict[str, T.DataType] = {"version": LONG}
    for section in SECTIONS:
        for name in _ROW_FIELDS[section]:
            kind = TABLES[section][name].dataType
            fields[name] = LONG if name == "approved" else kind
    return T.StructType([T.StructField(n, t) for n, t in fields.items()])


def _section_rows(parsed: dict[str, DataFrame]) -> Tables:
    out: Tables = {}
    for section in SECTIONS:
        rows = parsed[section]
        names = list(_ROW_FIELDS[section])
        if section == "transactions":
            rows = rows.withColumn("approved", F.col("approved") != 0)
        out[section] = rows.select("space_id", *names)
    return out


def _require_version(found: DataFrame) -> None:
    wrong = found.where(~F.col("version").eqNullSafe(F.lit(EXPORT_VERSION))).limit(1).count()
    if wrong:
        raise ValueError(f"unsupported export version; expected {EXPORT_VERSION}")


def read_export_parts(spark: SparkSession, path: str) -> Tables:
    """Rows of documents written by `export_spaces`, parsed line by line in parallel.

    Each line is an object on its own; the fields it has tell which table it belongs to.
    """
    lines = spark.read.schema("value string, space_id string").text(path)
    opening = F.col("value").startswith('{"version":')
    version = F.regexp_extract("value", r'^\{"version":([0-9]+),', 1).try_cast("bigint")
    _require_version(lines.where(opening).select(version.alias("version")))
    body = F.regexp_replace("value", "^,", "")
    row = lines.where(~opening & body.startswith("{")).select(
        "space_id", F.from_json(body, _row_schema()).alias("r")).select("space_id", "r.*")
    return _section_rows({
        "categories": row.where("color is not null and account_type is null"),
        "accounts": row.where("account_type is not null"),
        "transactions": row.where("booking_date is not null"),
        "account_summaries": row.where("month is not null"),
    })


def read_export_document(spark: SparkSession, path: str, space_id: str) -> Tables:
    """Rows of one compact document from elsewhere, for import into `space_id`."""
    sections = []
    for section in SECTIONS:
        fields = [
            T.StructField(n, LONG if n == "approved" else TABLES[section][n].dataType)
            for n in _ROW_FIELDS[section]
        ]
        sections.append(T.StructField(section, T.ArrayType(T.StructType(fields))))
    schema = T.StructType([T.StructField("version", LONG), *sections])
    document = spark.read.schema(schema).json(path, multiLine=True)
    _require_version(document.select("version"))
    return _section_rows({
        section: document.select(F.lit(space_id).alias("space_id"), F.explode(section).alias("r"))
        .select("space_id", "r.*")
        for section in SECTIONS
    })


def import_spaces(tables: Tables, incoming: Tables) -> Tables:
    """Clear the categories of the imported spaces, then upsert all four tables."""
    spaces = reduce(DataFrame.unionByName, [f.select("space_id") for f in incoming.values()]).distinct()
    cleared = tables["categories"].join(spaces, "space_id", "left_anti").select(
        *tables["categories"].columns)
    out = dict(tables)
    out["categories"] = upsert(cleared, incoming["categories"], ["id"])
    out["accounts"] = upsert(tables["accounts"], incoming["accounts"], ["id"])
    out["transactions"] = upsert(tables["transactions"], incoming["transactions"], ["id"])
    out["account_summaries"] = upsert(
        tables["account_summaries"], incoming["account_summaries"], ["month", "account_id"])
    return out
