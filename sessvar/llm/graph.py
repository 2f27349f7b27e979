"""Connected components of a graph that is an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _both(edges: DataFrame) -> DataFrame:
    return edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))


def _star(neighbours: DataFrame, large: bool) -> DataFrame:
    """Links a node's greater neighbours (large) or its smaller ones and itself (small) to the least of them all.

    The least neighbour is aggregated first and joined back, so a node with very many neighbours is no one task's group.
    The xor with zero hides that the sums already lie by node: they are dealt out anew, and so a hub's rows can be split in the join.
    """
    mine = neighbours if large else neighbours.filter("b < a")
    least = mine.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").bitwiseXOR(F.lit(0)).alias("n"), F.least("m", "a").alias("m"))
    joined = mine.join(least.hint("merge"), F.col("a") == F.col("n"))
    linked = joined.filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")) if large else joined.select(F.col("b").alias("a"), F.col("m").alias("b")).union(least.select(F.col("n").alias("a"), F.col("m").alias("b")))
    return linked.filter("a <> b").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, root): the least node of the component of every node of ``edges`` (columns a and b).

    Alternates large and small stars until the table no longer changes, which takes about the square of the
    logarithm of a component's size at most; every round is checkpointed to the shared folder.
    """
    now = edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct().checkpoint()
    mark = None
    while True:
        state = now.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b")), F.sum(F.xxhash64("b", "a").cast("decimal(38,0)"))).first()
        if tuple(state) == mark:
            break
        mark = tuple(state)
        now = _star(_both(_star(_both(now), large=True)), large=False).checkpoint()
    roots = now.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return roots.union(now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
