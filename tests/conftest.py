from __future__ import annotations

import os
import sys

import pytest
from pyspark.sql import SparkSession

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path[:0] = [ROOT, os.path.join(ROOT, "tests")]

from tallyframe import schemas  # noqa: E402
from tallyframe.session import configure  # noqa: E402


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = (
        SparkSession.builder.master("local[8]").appName("ledger-tests")
        .config("spark.sql.shuffle.partitions", "2").config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false").config("spark.driver.memory", "4g")
        .config("spark.checkpoint.dir", str(tmp_path_factory.mktemp("checkpoint")))
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield configure(session)
    session.stop()


@pytest.fixture
def table(spark):
    """table("accounts", {...}, {...}): a typed frame; missing columns get plain defaults."""
    plain = {"string": "", "bigint": 0, "boolean": False}

    def build(name: str, *rows: dict):
        schema = schemas.TABLES[name]
        data = [
            tuple(r[f.name] if f.name in r else (None if f.nullable else plain[f.dataType.simpleString()])
                  for f in schema.fields)
            for r in rows
        ]
        return spark.createDataFrame(data, schema)

    return build
