"""Side-by-side check of a registered query and its SQL, as multisets of rows."""

from __future__ import annotations

import math
import os

import duckdb

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings "
          "pages benchmark labels conversations").split()


def connect(folder: str):
    con = duckdb.connect()
    for t in TABLES:
        path = os.path.join(folder, f"{t}.parquet")
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{path}'")
    return con


def _norm(v):
    if v is None:
        return None
    if isinstance(v, bool):
        return v
    if isinstance(v, int):
        return v
    if isinstance(v, float):
        return "nan" if math.isnan(v) else v
    if isinstance(v, (list, tuple)):
        return tuple(_norm(x) for x in v)
    return str(v)


def _kind(name: str) -> str:
    n = name.lower()
    if n in ("bigint", "long", "integer", "int", "smallint"):
        return "int"
    if n in ("double", "float"):
        return "float"
    return {"varchar": "string", "boolean": "boolean"}.get(n, n)


def compare(spark_df, con, sql: str) -> str | None:
    """None when equal, else a message."""
    rel = con.sql(sql)
    want_cols = sorted(rel.columns)
    got_cols = sorted(spark_df.columns)
    if want_cols != got_cols:
        return f"columns {got_cols} != {want_cols}"
    types = {c: _kind(str(t)) for c, t in zip(rel.columns, rel.types)}
    for f in spark_df.schema.fields:
        kind = _kind(f.dataType.typeName())
        if kind != types[f.name] and not f.dataType.typeName().startswith("array"):
            return f"type of {f.name}: {kind} != {types[f.name]}"
    order = [rel.columns.index(c) for c in got_cols]
    want = [tuple(_norm(r[i]) for i in order) for r in rel.fetchall()]
    got = [tuple(_norm(r[c]) for c in got_cols) for r in spark_df.collect()]
    if len(want) != len(got):
        return f"rows {len(got)} != {len(want)}"
    a, b = sorted(map(repr, got)), sorted(map(repr, want))
    if a != b:
        diff = [(x, y) for x, y in zip(a, b) if x != y][:2]
        return f"values differ, e.g. {diff}"
    return None if got else "no rows"
