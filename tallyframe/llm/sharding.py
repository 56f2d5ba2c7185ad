"""Contiguous shards of nearly equal bytes, from prefix sums of per-partition totals.

DataFrame functions only. The texts themselves never move: a slim row per document, with its
size, is sorted into ranges of doc_id by Spark's range partitioner. The totals of those ranges,
one row a partition, are summed up in order; within a partition a window adds the rest. A
document belongs to the shard in whose share of all bytes its middle byte falls.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import settle


def text_size() -> Column:
    """UTF-8 bytes of the text, none for null, plus one."""
    return F.coalesce(F.octet_length("text"), F.lit(0)).cast("long") + 1


def range_positions(slim: DataFrame, order: list[Column], weight: str, label: str) -> DataFrame:
    """Adds, over the whole table in the given order, `before` (weight of earlier rows), `row_no` from 0 and `total`.

    Written once with the number of its range partition, so that a retry finds the same ranges.
    The totals that meet in one task are one row for each partition.
    """
    ranges = max(int(slim.sparkSession.conf.get("spark.sql.shuffle.partitions")), slim.rdd.getNumPartitions())
    dealt = settle(slim.repartitionByRange(ranges, *order).withColumn("__range", F.spark_partition_id()), label)
    totals = dealt.groupBy("__range").agg(F.sum(weight).alias("w"), F.count(F.lit(1)).alias("n"))
    ahead = Window.orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    starts = totals.select("__range", F.sum("w").over(Window.partitionBy()).alias("total"), F.coalesce(F.sum("w").over(ahead), F.lit(0)).alias("w0"),
                           F.coalesce(F.sum("n").over(ahead), F.lit(0)).alias("n0"))
    inside = Window.partitionBy("__range").orderBy(*order)
    return (dealt.join(starts, "__range")
            .withColumn("before", F.col("w0") + F.sum(weight).over(inside.rowsBetween(Window.unboundedPreceding, 0)) - F.col(weight))
            .withColumn("row_no", F.col("n0") + F.row_number().over(inside) - 1)
            .drop("__range", "w0", "n0"))


def _slim(documents: DataFrame) -> list[Column]:
    return [F.col("doc_id").cast("long").alias("doc_id"), text_size().alias("size"),
            F.crc32(F.coalesce("text", F.lit("")).cast("binary")).alias("text_crc32")]


def _deal(slim: DataFrame, order: list[Column], shards: int) -> DataFrame:
    """Adds shard and slot to (size, ...) rows, contiguous in the given order."""
    placed = range_positions(slim, order, "size", "shard-ranges")
    # twice the middle of the document, as a share of twice the total: whole numbers only
    cut = F.expr(f"CAST(((2 * before + size) * {shards}) DIV (2 * total) AS INT)")
    cast = settle(placed.select(*slim.columns, "row_no", cut.alias("shard")), "shards")
    first = cast.groupBy("shard").agg(F.min("row_no").alias("first"))  # a row for each shard
    return cast.join(F.broadcast(first), "shard").select(*slim.columns, "shard", (F.col("row_no") - F.col("first")).alias("slot"))


def shard_documents(documents: DataFrame, shards: int = 16) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot and grown_shard of every row of `documents`.

    documents: doc_id, text; other columns are ignored. Shards are contiguous in doc_id (missing
    ids last; equal ids in the order of checksum and size), their bytes are as near to a
    `shards`-th of all as whole documents allow: a cut is off by half a document at most. Shards
    may be empty where one document is larger than a share. `slot` counts from 0 in each shard.
    A null text has no bytes: size 1, checksum 0. Repeated rows each count. `grown_shard` is
    null: under the law `bytes` another shard moves all cuts. An empty table gives no rows.
    """
    order = [F.col("doc_id").asc_nulls_last(), F.col("text_crc32"), F.col("size")]
    return _deal(documents.select(*_slim(documents)), order, shards).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def _file_rows(documents: DataFrame) -> Column | None:
    """File and row number of every row, or None where the rows don't come from Parquet files."""
    spot = F.struct(F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("row"))
    try:
        documents.select(spot).schema
    except AnalysisException:
        return None
    return spot


def with_shards(documents: DataFrame, shards: int = 16, shuffled: bool = False, kept: bool = False) -> DataFrame:
    """The documents with columns shard and slot; each of equal rows gets a slot of its own.

    Shards are contiguous in doc_id, or in a random order that a hash fixes: then the repeats of
    a document in a mix are apart from each other. With `kept` they are contiguous in the order
    of the Parquet files that the documents are read from, which is the order of a mix; rows
    that come from elsewhere have none, and get the random order.
    """
    spot = _file_rows(documents) if kept else None
    if spot is not None:
        slim = documents.select(spot.alias("__at"), text_size().alias("size"))
        placed = _deal(slim, [F.col("__at")], shards).drop("size")
        own = [documents[c] for c in documents.columns if c not in ("shard", "slot")]
        return documents.select(*own, spot.alias("__at")).join(placed, "__at").drop("__at")
    shuffled = shuffled or kept
    nth = F.row_number().over(Window.partitionBy("__same").orderBy("__same")).alias("__nth")
    same = F.struct(*_slim(documents)).alias("__same")
    slim = documents.select(same).select("__same", F.col("__same.size").alias("size"), nth)
    key = [F.xxhash64("__same", "__nth")] if shuffled else []
    order = [*key, F.col("__same.doc_id").asc_nulls_last(), F.col("__same.text_crc32"), F.col("size"), F.col("__nth")]
    placed = _deal(slim, order, shards).drop("size")
    whole = documents.select(F.struct(*documents.columns).alias("__row"), same).select("*", nth)
    kept = [F.col(f"__row.{c}") for c in documents.columns if c not in ("shard", "slot")]
    return whole.join(placed, ["__same", "__nth"]).select(*kept, "shard", "slot")
