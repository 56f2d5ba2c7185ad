from __future__ import annotations

import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from helpers import rows
from tallyframe.functions.numbering import first_per_group, hash_prefix, numbered, previous_value, running_total


@pytest.fixture(scope="module")
def skewed(spark):
    """One group holds most rows; keys repeat across groups; buckets hold several rows."""
    rng = random.Random(5)
    data = [("big" if rng.random() < 0.7 else f"g{i % 5}", i, rng.randint(-9, 9)) for i in range(600)]
    data += [(None, 1000, 3), (None, 1001, 4)]
    return spark.createDataFrame(data, "g string, k long, v long")


def test_numbered_equals_row_number(skewed):
    got = numbered(skewed, ["g"], [F.floor(F.col("k") / 37)], [F.col("k")], out="n")
    want = skewed.withColumn("n", F.row_number().over(Window.partitionBy("g").orderBy("k")))
    assert rows(got, "g", "k", "n") == rows(want, "g", "k", "n")


def test_numbered_over_the_whole_table_by_hash(skewed):
    order = [F.md5(F.col("k").cast("string")), F.col("k")]
    got = numbered(skewed, [], [hash_prefix(F.col("k"))], order, out="n")
    want = skewed.withColumn("n", F.row_number().over(Window.orderBy(*order)))
    assert rows(got, "k", "n") == rows(want, "k", "n")


def test_running_total_equals_window_sum(skewed):
    got = running_total(skewed, ["g"], [F.floor(F.col("k") / 11)], [F.col("k")], F.col("v"), "t")
    want = skewed.withColumn("t", F.sum("v").over(
        Window.partitionBy("g").orderBy("k").rowsBetween(Window.unboundedPreceding, 0)))
    assert rows(got, "g", "k", "t") == rows(want, "g", "k", "t")


def test_previous_value_equals_lag(skewed):
    got = previous_value(skewed, ["g"], [F.floor(F.col("k") / 13)], [F.col("k")], F.struct("v"), "p")
    want = skewed.withColumn("p", F.lag(F.struct("v")).over(Window.partitionBy("g").orderBy("k")))
    assert rows(got, "g", "k", "p.v") == rows(want, "g", "k", "p.v")


def test_first_per_group_limits_before_the_shuffle(skewed):
    top = first_per_group(skewed, ["g"], [F.desc("k")], 2)
    plan = top._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan
    assert top.where("g = 'g1'").count() == 2
