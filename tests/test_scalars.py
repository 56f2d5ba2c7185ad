from __future__ import annotations

import math

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tallyframe.functions import scalars as S
from tallyframe.operators.features import FEATURE_SIZE, feature_vector


def one(spark, expression, **values):
    names = list(values)
    frame = spark.createDataFrame([tuple(values.values())], ", ".join(
        f"{n} {'bigint' if isinstance(v, int) else 'string'}" for n, v in values.items()))
    assert names
    return frame.select(expression).first()[0]


@pytest.mark.parametrize("text, want", [
    ("2024-05-31", "2024-05"), ("2024-02-30", "2024-03"), ("2024-01-01T10:00", "2024-01"),
    ("2024-13-01", None), ("2024-01-32", None), ("x", None), ("", None), ("2024-1-1", None),
])
def test_month_of(spark, text, want):
    assert one(spark, S.month_of(F.col("d")), d=text) == want


@pytest.mark.parametrize("text, want", [
    ("1234,56", 123456), ("1 234,50", 123450), ("1 234,50", 123450), ("1,234.56", 123),
    ("abc", None), ("", None), ("-0,01", -1), ("19.99", 1998), ("5kr", 500), (".5", 50), ("1e2", 10000),
])
def test_parse_minor_keeps_binary_truncation(spark, text, want):
    assert one(spark, S.parse_minor(F.col("t")), t=text) == want


def test_parse_minor_exact(spark):
    assert one(spark, S.parse_minor(F.col("t"), exact=True), t="19.99") == 1999


@pytest.mark.parametrize("minor, want", [
    (0, "0.00"), (5, "0.05"), (-5, "-0.05"), (123456, "1234.56"), (-100, "-1.00"),
])
def test_money_text(spark, minor, want):
    assert one(spark, S.money_text(F.col("m")), m=minor) == want


@pytest.mark.parametrize("a, b, want", [
    ("2024-01-01T00:00:00Z", "2024-01-01T00:00:59Z", True),
    ("2024-01-01T00:00:00Z", "2024-01-01T00:01:00Z", True),
    ("2024-01-01T00:00:00Z", "2024-01-01T00:01:01Z", False),
    ("2024-01-01T00:00:00Z", "2024-01-01 00:00:00", False),
    ("not a time", "2024-01-01T00:00:00Z", False),
])
def test_tolerance_includes_the_limit(spark, a, b, want):
    assert one(spark, S.within_tolerance(F.col("a"), F.col("b")), a=a, b=b) is want


def test_composite_keys_split_on_the_first_colon(spark):
    assert one(spark, S.key_head(F.col("k")), k="a:b:c") == "a"
    assert one(spark, S.key_tail(F.col("k")), k="a:b:c") == "b:c"


def test_first_filled_skips_empty_texts(spark):
    assert one(spark, S.first_filled(F.col("a"), F.col("b")), a="", b="x") == "x"
    assert one(spark, S.first_filled(F.col("a")), a="") == ""


def test_clean_text(spark):
    assert one(spark, S.clean_text(F.col("t")), t="  ICA Maxi /24-01") == "ica maxi"


EDGES = [-100000, -10000, -1000, -100, -10, 0, 10, 100, 1000, 10000, 100000]


@pytest.mark.parametrize("base", [e + d for e in EDGES for d in (-0.01, 0, 0.01)])
def test_features_bins_at_every_edge(spark, base):
    minor = round(base * 100)
    got = one(spark, feature_vector(F.col("m"), F.lit("2024-03-09")), m=minor)
    assert len(got) == FEATURE_SIZE == 64
    hot = [i for i, v in enumerate(got) if v == 1 and i != 13]
    want_bin = next((i for i, e in enumerate(EDGES) if minor < e * 100), len(EDGES))
    assert hot == [want_bin, 14 + 5, 21 + 8, 52 + 2]  # Saturday, the 9th, March
    assert got[12] == 0.0
    assert got[13] == pytest.approx(math.copysign(math.log(abs(minor / 100) + 1), minor), rel=1e-5, abs=1e-6)


@pytest.mark.parametrize("text, day, month", [
    ("2024-02-30", 1, 1), ("2024-05-06T10:00", 6, 5), ("x", 1, 1), ("2024-12-31", 31, 12),
])
def test_feature_dates_fall_back(spark, text, day, month):
    got = one(spark, feature_vector(F.lit(0).cast("bigint"), F.col("d")), d=text)
    assert got[21 + day - 1] == 1 and got[52 + month - 1] == 1


def test_argmax_takes_the_last_of_equals(spark):
    frame = spark.createDataFrame([([1.0, 3.0, 3.0],)], "s array<double>")
    assert frame.select(S.argmax_last(F.col("s"))).first()[0] == 2


def test_log_softmax(spark):
    frame = spark.createDataFrame([([1.0, 2.0, 1000.0],)], "s array<double>")
    assert frame.select(S.log_softmax_at(F.col("s"), F.lit(2))).first()[0] == pytest.approx(0.0)
    assert frame.select(S.log_softmax_at(F.col("s"), F.lit(0))).first()[0] == pytest.approx(-999.0)


def test_mean_pool_masks_and_normalises(spark):
    frame = spark.createDataFrame(
        [([[3.0, 0.0], [0.0, 4.0], [9.0, 9.0]], [1, 1, 0])], "t array<array<float>>, m array<int>")
    got = frame.select(S.mean_pool(F.col("t"), F.col("m"), 2)).first()[0]
    assert got == pytest.approx([0.6, 0.8])


def test_content_id_of_empty_text(spark):
    assert one(spark, F.md5(F.col("t")), t="") == "d41d8cd98f00b204e9800998ecf8427e"


@settings(max_examples=15, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.integers(min_value=-10**15, max_value=10**15), min_size=1, max_size=30))
def test_money_text_matches_python(spark, amounts):
    frame = spark.createDataFrame([(a,) for a in amounts], "m bigint")
    got = [r[0] for r in frame.select(S.money_text(F.col("m"))).collect()]
    want = [f"{'-' if a < 0 else ''}{abs(a) // 100}.{abs(a) % 100:02d}" for a in amounts]
    assert sorted(got) == sorted(want)
