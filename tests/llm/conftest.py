from __future__ import annotations

import pytest

SF = "/root/testdata/sf0.001"


@pytest.fixture
def docs(spark):
    """docs((id, text), ...): a documents table with all its columns and one more that clashes."""
    def build(*rows, **more):
        data = [(i, t, "en", f"src{0 if i is None else i % 3}", len(t or ""), "x") for i, t in rows]
        return spark.createDataFrame(data, "doc_id long, text string, lang string, source string, n_chars long, bucket string")
    return build


@pytest.fixture
def given(spark):
    return lambda name: spark.read.parquet(f"{SF}/{name}.parquet")
