"""Positions, running totals and previous values inside groups of any size.

A plain window over a group sorts the whole group in one task. Here every group is cut
into buckets that follow the sort order (a date, a key prefix, a range of sequence
numbers). Buckets are summarised with map-side combine, the small summaries are
accumulated per group, and the fine-grained window then runs per (group, bucket). A tenant
holding a third of the table is therefore spread over as many tasks as it has buckets.

The bucket columns must be a leading part of the sort order or monotone in it. The input is
read twice, for the summaries (keys only) and for the rows; where it is expensive, write it
first with `session.settle`.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import settle


def _tagged(df: DataFrame, group: Sequence[str], bucket: Sequence[Column]) -> tuple[DataFrame, list[str]]:
    """Add the bucket columns and `__key`, one struct of group and bucket.

    The aggregate, the join and the window below all use the struct, so the join's
    partitioning serves the window too. Structs compare NULL fields as equal: no row is
    lost to a NULL in its group.
    """
    names = [f"__bucket{i}" for i in range(len(bucket))]
    tagged = df.select("*", *[b.alias(n) for b, n in zip(bucket, names)])
    return tagged.withColumn("__key", F.struct(*group, *names)), names


def _ordered(names: Sequence[str], descending: bool = False) -> list[Column]:
    return [F.col(f"__key.{n}").desc() if descending else F.col(f"__key.{n}").asc() for n in names]


def _across_buckets(group: Sequence[str], names: Sequence[str], descending: bool = False):
    whole = [F.col(f"__key.{g}") for g in group] or [F.lit(0)]
    return Window.partitionBy(*whole).orderBy(*_ordered(names, descending))


def _with_summary(tagged: DataFrame, summary: DataFrame, value: Column) -> DataFrame:
    """Attach the per-bucket `value` of `summary` as `__ahead`."""
    return tagged.join(summary.select("__key", value.alias("__ahead")), "__key")


def in_ranges(df: DataFrame, group: Sequence[str], order: Sequence[Column], out: str = "__range") -> DataFrame:
    """The rows, written once, with a bucket column that fits the functions below.

    Spark's range partitioner samples the rows and cuts them, in the order of group and sort
    keys, into about equal partitions; the partition's number is the bucket. Buckets so hold as
    many rows as the data has for each task, whatever the keys look like, and a group's summary
    is a row for each partition that it spans.
    """
    ranges = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = df.repartitionByRange(ranges, *[F.col(g) for g in group], *order)
    return settle(dealt.withColumn(out, F.spark_partition_id()), "ranges")


def numbered(
    df: DataFrame,
    group: Sequence[str],
    bucket: Sequence[Column],
    order: Sequence[Column],
    out: str = "row_no",
    descending_buckets: bool = False,
) -> DataFrame:
    """Dense 1-based position of each row in its group, as `row_number()` would give."""
    tagged, names = _tagged(df, group, bucket)
    sizes = tagged.groupBy("__key").agg(F.count(F.lit(1)).alias("__size"))
    earlier = _across_buckets(group, names, descending_buckets).rowsBetween(Window.unboundedPreceding, -1)
    ahead = F.coalesce(F.sum("__size").over(earlier), F.lit(0))
    within = Window.partitionBy("__key").orderBy(*order)
    return (
        _with_summary(tagged, sizes, ahead)
        .withColumn(out, F.col("__ahead") + F.row_number().over(within))
        .drop("__ahead", "__key", *names)
    )


def running_total(
    df: DataFrame,
    group: Sequence[str],
    bucket: Sequence[Column],
    order: Sequence[Column],
    value: Column,
    out: str,
) -> DataFrame:
    """Sum of `value` over the group's rows up to and including this one."""
    tagged, names = _tagged(df.withColumn("__value", value), group, bucket)
    sums = tagged.groupBy("__key").agg(F.sum("__value").alias("__sum"))
    earlier = _across_buckets(group, names).rowsBetween(Window.unboundedPreceding, -1)
    ahead = F.coalesce(F.sum("__sum").over(earlier), F.lit(0))
    within = (
        Window.partitionBy("__key").orderBy(*order)
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    return (
        _with_summary(tagged, sums, ahead)
        .withColumn(out, F.col("__ahead") + F.sum("__value").over(within))
        .drop("__ahead", "__value", "__key", *names)
    )


def previous_value(
    df: DataFrame,
    group: Sequence[str],
    bucket: Sequence[Column],
    order: Sequence[Column],
    value: Column,
    out: str,
) -> DataFrame:
    """`value` of the preceding row of the group (NULL on the first), as `lag` would give.

    `value` should be a struct, so that a NULL result always means "no earlier row".
    """
    tagged, names = _tagged(df.withColumn("__value", value), group, bucket)
    last = tagged.groupBy("__key").agg(F.max_by("__value", F.struct(*order)).alias("__last"))
    carried = F.lag("__last").over(_across_buckets(group, names))
    within = Window.partitionBy("__key").orderBy(*order)
    return (
        _with_summary(tagged, last, carried)
        .withColumn(out, F.coalesce(F.lag("__value").over(within), F.col("__ahead")))
        .drop("__ahead", "__value", "__key", *names)
    )


def first_per_group(df: DataFrame, group: Sequence[str], order: Sequence[Column], rows: int,
                    out: str = "row_no") -> DataFrame:
    """The first `rows` rows of each group.

    The rank filter lets Spark keep only `rows` rows per group on the map side
    (WindowGroupLimit), so the shuffle carries tasks x groups x rows at most.
    """
    ranked = df.withColumn(out, F.row_number().over(Window.partitionBy(*group).orderBy(*order)))
    return ranked.where(F.col(out) <= rows)


def hash_prefix(column: Column, digits: int = 3) -> Column:
    """Leading hex digits of the MD5: an even bucket for rows sorted by that MD5."""
    return F.substring(F.md5(column.cast("string")), 1, digits)
