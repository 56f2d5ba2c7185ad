"""Connected components by alternating star contractions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import settle


def _large_star(edges: DataFrame) -> DataFrame:
    """Every neighbour above a node moves to the least node next to it."""
    both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    return (both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct())


def _small_star(edges: DataFrame) -> DataFrame:
    """A node and its neighbours below it move to the least of those."""
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b")
    least = down.groupBy("a").agg(F.min("b").alias("m"))
    return (down.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
            .union(least.select("a", F.col("m").alias("b"))).where("a <> b").distinct())


def _only_stars(edges: DataFrame) -> bool:
    """Whether every node above has one edge, to a root that is on no other node's upper end."""
    ends = edges.select(F.col("a").alias("node"), F.lit(1).alias("up"), F.lit(0).alias("down")).union(
        edges.select(F.col("b").alias("node"), F.lit(0).alias("up"), F.lit(1).alias("down")))
    sums = ends.groupBy("node").agg(F.sum("up").alias("up"), F.sum("down").alias("down"))
    return sums.where("up > 1 OR (up > 0 AND down > 0)").isEmpty()


def components(edges: DataFrame, label: str = "components") -> DataFrame:
    """(node, root) for every node on an edge (a, b); the root is the component's least node.

    Any comparable type serves as a node. Edges with a null end and loops are left out: a node
    that has no other edge is not in the result. The rounds grow with the logarithm of the
    component's size; each is written to the shared folder, which cuts the lineage.
    """
    now = settle(edges.select("a", "b").where("a <> b").select(
        F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), label)
    while not _only_stars(now):
        now = settle(_small_star(_large_star(now)), label)
    return now.select(F.col("a").alias("node"), F.col("b").alias("root")).union(
        now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
