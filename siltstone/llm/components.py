"""Connected components of an edge table, by alternating star contractions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltstone.llm.common import Scratch


def _both_ways(edges: DataFrame) -> DataFrame:
    return edges.select("a", "b").unionAll(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))


def _large_star(edges: DataFrame) -> DataFrame:
    """Every larger neighbour of a node is linked to the node's least neighbour."""
    near = _both_ways(edges)
    least = near.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
    linked = near.join(least, "a").where(F.col("b") > F.col("a"))
    return linked.select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Every smaller neighbour of a node, and the node, are linked to the least of them."""
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = down.groupBy("a").agg(F.min("b").alias("m"))
    linked = down.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return linked.unionAll(least.select("a", F.col("m").alias("b"))).where("a <> b").distinct()


def connected_components(edges: DataFrame, scratch: Scratch, max_rounds: int = 64) -> DataFrame:
    """(node, root) for every node that has an edge and isn't its component's least node.

    edges: columns a and b, comparable, never null; loops and repeated edges are allowed. Each round
    is a constant number of shuffles on one endpoint, with partial minimums; the rounds needed grow
    with the logarithm of the longest path. Every round is a written table, so a lost executor costs
    one round at most, and nothing is gathered on the driver but three sums. No edge: an empty table.
    """
    current = scratch.write(edges.select("a", "b").where("a <> b").distinct())
    state = None
    for _ in range(max_rounds):
        after = scratch.write(_small_star(_large_star(current)))
        now = after.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        scratch.drop(current)
        current = after
        if state is not None and tuple(now) == state:
            break
        state = tuple(now)
    else:
        raise RuntimeError("components did not settle")
    return current.select(F.col("a").alias("node"), F.col("b").alias("root"))
