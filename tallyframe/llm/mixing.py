"""Mixing sources to target weights with a multivariate-hypergeometric splitting tree.

DataFrame functions only. Each source has a quota of equal blocks, in proportion to its target;
the number of blocks grows with the corpus. The blocks of all sources are dealt to output shards
by a binary tree: a node hands a fixed number of its blocks, drawn without replacement, to its
left half, so that the counts by source are multivariate-hypergeometric and the quotas hold
exactly. The draw itself is the order of a hash of (seed, node, block). A leaf is a shard.

A block is a stretch of one permutation of its source's documents, which is gone through as often
as the target asks. A document is taken as often as its middle lies in a block that the tree has
dealt, and goes to that block's shard; rows of a shard are put in a random order of their own.

Blocks are ranked, and words summed up, in buckets of their hashes, so that neither a node nor a
source is sorted in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import settle

#: Buckets that each source's permutation is cut into.
BUCKETS = 4096
#: Blocks of a shard on average, at least, and words of a block, at most.
BLOCKS_PER_SHARD = 64
BLOCK_WORDS = 1 << 16
WEIGHTS = (3, 1, 2)
MOST = 2  # times its own size that a source may be asked for


def word_count() -> Column:
    return F.coalesce(F.regexp_count("text", F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, share: float = 1.5, weights=WEIGHTS) -> DataFrame:
    """sizes (source, source_size) with `target`: weights repeat in the order of the names.

    The share of all sizes is divided by weight; a source that would get more than MOST times
    its size gets just that, and what is over goes to the others by weight, until it fits.
    This is the water level c of sum(min(weight * c, MOST * size)) = share * total: sorted by
    MOST * size / weight, the first sources are full. Windows over one row for each source.
    """
    place = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (place % len(weights) + 1).cast("int"))
    whole = Window.partitionBy()
    level = Window.orderBy("full_at", F.col("source").asc_nulls_last())
    return (
        sizes.withColumn("weight", weight)
        .withColumn("cap", F.col("source_size") * F.lit(float(MOST)))
        .withColumn("full_at", F.col("cap") / F.col("weight"))
        .withColumn("asked", F.sum("source_size").over(whole) * F.lit(float(share)))
        # if exactly the sources before this one were full, the level would be:
        .withColumn("full_before", F.coalesce(F.sum("cap").over(level.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)))
        .withColumn("weight_from", F.sum("weight").over(level.rowsBetween(0, Window.unboundedFollowing)))
        .withColumn("c", (F.col("asked") - F.col("full_before")) / F.col("weight_from"))
        .withColumn("level", F.max(F.when(F.col("c") <= F.col("full_at"), F.col("c"))).over(whole))
        .withColumn("target", F.least("cap", F.coalesce(F.col("weight") * F.col("level"), F.col("cap"))))
        .select("source", "source_size", "target")
    )


def _quotas(targets: DataFrame, shards: int, share: float) -> DataFrame:
    """The targets with `quota`: whole blocks of each source, one at least."""
    asked = F.sum("source_size").over(Window.partitionBy()) * F.lit(min(float(share), float(MOST)))
    words = F.least(F.lit(float(BLOCK_WORDS)), asked / F.lit(float(shards * BLOCKS_PER_SHARD)))
    blocks = F.coalesce(F.round(F.try_divide(F.col("target"), words)), F.lit(0.0))
    return targets.withColumn("quota", F.greatest(F.lit(1), blocks.cast("long")))


def splitting_tree(quotas: DataFrame, shards: int, seed: int) -> DataFrame:
    """(source, turn, shard): the shard of every block of a source; `turn` counts its blocks from 0.

    A node of s shards gives floor(s / 2) of every s blocks to the left: those that are first by
    their draw. Ranks are sums over buckets of the draw, and windows within one; each level is
    written once.
    """
    wide = quotas.where("quota > 0").select("source", "quota", F.explode(F.expr(f"sequence(0L, (quota - 1) div {BUCKETS})")).alias("part"))
    state = wide.select("source", F.explode(F.expr(f"sequence(part * {BUCKETS} + 1, least((part + 1) * {BUCKETS}, quota))")).alias("b"),
                        F.lit(0).alias("low"), F.lit(shards).alias("span"))
    state, width = settle(state, "mix-blocks"), shards
    node = Window.partitionBy("__k.low", "__k.span")
    before = node.orderBy("__k.bucket").rowsBetween(Window.unboundedPreceding, -1)
    while width > 1:
        drawn = state.withColumn("draw", F.xxhash64(F.lit(seed), "low", "span", "source", "b"))
        drawn = drawn.withColumn("__k", F.struct("low", "span", F.shiftright("draw", 52).alias("bucket")))
        sums = drawn.groupBy("__k").agg(F.count(F.lit(1)).alias("n")).select(
            "__k", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("ahead"), F.sum("n").over(node).alias("whole"))
        inside = Window.partitionBy("__k").orderBy("draw", F.col("source").asc_nulls_last(), "b")
        ranked = drawn.join(sums, "__k").withColumn("place", F.col("ahead") + F.row_number().over(inside))
        half = F.expr("span div 2").cast("int")
        left = F.expr("span = 1 OR place <= whole * (span div 2) div span")
        state = settle(ranked.select(
            "source", "b", F.when(left, F.col("low")).otherwise(F.col("low") + half).alias("low"),
            F.when(F.col("span") == 1, F.lit(1)).when(left, half).otherwise(F.col("span") - half).alias("span")), "mix-tree")
        width = (width + 1) // 2
    return state.select("source", (F.col("b") - 1).alias("turn"), F.col("low").alias("shard"))


def mixture(documents: DataFrame, shards: int = 16, seed: int = 7, share: float = 1.5, weights=WEIGHTS,
            keys: tuple[str, ...] = ()) -> tuple[DataFrame, DataFrame]:
    """(plan, draws) of a mix of `documents` (doc_id, text, source; more columns are ignored).

    plan, a row for each row of the documents: doc_id, source, size (words), source_size,
    target, dealt (the shard of each round's block, null where none was drawn), times (0 to 2: how
    often the mix takes it) and taken = times * size. draws, a row for each time: doc_id, shard,
    place (a random order within the shard).

    A source's permutation depends on the seed, doc_id and text only, so that reruns agree. Its
    blocks reach up to the target; the last document is taken if that brings the source nearer
    to its target. Null is a source, the last. Null and empty texts have size 0 and are taken
    once, with a block that their hash names. Repeated rows count each. No rows give no rows.
    """
    slim = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"),
                            word_count().alias("size"), F.xxhash64(F.lit(seed), "doc_id", "text").alias("draw"), *keys)
    slim = settle(slim.withColumn("bucket", F.pmod(F.shiftright("draw", 20), F.lit(BUCKETS)).cast("int")), "mix-sizes")
    sums = slim.groupBy("source", "bucket").agg(F.sum("size").alias("w"))
    sums = settle(sums, "mix-sums")
    sizes = sums.groupBy("source").agg(F.sum("w").alias("source_size"))
    targets = settle(_quotas(source_targets(sizes, share, weights), shards, share), "mix-targets")
    before = F.coalesce(F.sum("w").over(Window.partitionBy("source").orderBy("bucket").rowsBetween(
        Window.unboundedPreceding, -1)), F.lit(0))
    starts = sums.select("source", "bucket", before.alias("ahead")).join(
        targets.withColumnRenamed("source", "__s"), F.col("source").eqNullSafe(F.col("__s"))).drop("__s")
    tagged = slim.withColumn("__k", F.struct("source", "bucket")).drop("source", "bucket")
    starts = starts.withColumn("__k", F.struct("source", "bucket")).drop("source", "bucket")
    inside = Window.partitionBy("__k").orderBy("draw", "doc_id").rowsBetween(Window.unboundedPreceding, 0)
    placed = tagged.join(starts, "__k").withColumn("at", F.col("ahead") + F.sum("size").over(inside) - F.col("size"))
    leaves = splitting_tree(targets.select("source", "quota"), shards, seed)
    for r in range(MOST):
        middle = F.lit(r) * F.col("source_size") + F.col("at") + F.col("size") / F.lit(2.0)
        block = F.when(middle < F.col("target"), F.least(F.floor(F.try_divide(middle * F.col("quota"), F.col("target"))), F.col("quota") - 1))
        at_all = F.pmod(F.shiftright("draw", 32), F.col("quota")) if r == 0 else F.lit(None).cast("long")
        block = F.when(F.col("size") == 0, at_all).otherwise(block)
        # what is not drawn has no leaf, and keys apart from each other
        block = F.coalesce(block, -1 - F.pmod("draw", F.lit(BUCKETS))).cast("long")
        leaf = leaves.select(F.struct("source", F.col("turn").alias("block")).alias("__l"), F.col("shard").alias(f"shard_{r}"))
        placed = placed.withColumn("__l", F.struct(F.col("__k.source").alias("source"), block.alias("block"))).join(leaf, "__l", "left").drop("__l")
    dealt = F.array(*[f"shard_{r}" for r in range(MOST)])
    times = sum(F.col(f"shard_{r}").isNotNull().cast("int") for r in range(MOST))
    plan = placed.select("doc_id", F.col("__k.source").alias("source"), "size", "source_size", "target", "at", "draw",
                         dealt.alias("dealt"), times.alias("times"), *keys).withColumn("taken", F.col("times") * F.col("size"))
    drawn = plan.select("doc_id", "draw", F.posexplode("dealt").alias("round", "shard"), *keys).where("shard IS NOT NULL")
    draws = drawn.select("doc_id", "shard", F.xxhash64(F.lit(seed + 1), "draw", "round").alias("place"), "round", *keys)
    return plan, draws


def mixed(documents: DataFrame, shards: int = 16, seed: int = 7) -> DataFrame:
    """The documents of the mix, each as often as it is taken, shard by shard in the shards' order.

    Written to files, their names and rows have that order: `with_shards(..., kept=True)` keeps it.
    A shard spans as many ranges as the session's shuffles have partitions for it.
    """
    ranges = max(shards, int(documents.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    keyed = documents.withColumn("__row", F.struct("doc_id", F.xxhash64(*documents.columns).alias("h")))
    _, draws = mixture(keyed, shards, seed, keys=("__row",))
    # rows that are equal in every column have one key and are interchangeable
    out = keyed.dropDuplicates(["__row"]).join(draws.select("__row", "shard", "place"), "__row")
    return (out.repartitionByRange(ranges, "shard", "place").sortWithinPartitions("shard", "place", "__row")
            .select(*[out[c] for c in documents.columns]))
