"""Connected components of a distributed edge list by alternating star contraction."""

from __future__ import annotations

from contextlib import ExitStack

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tillwise.sources.shared import stage, staged


def _large_star(edges: DataFrame) -> DataFrame:
    """Every larger neighbour of a node is linked to the smallest of its neighbours and itself."""
    both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.least("a", F.min("b")).alias("low"))
    return both.filter("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("low").alias("b")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Every smaller neighbour of a node, and the node, are linked to the smallest of these."""
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = down.groupBy("a").agg(F.min("b").alias("low"))
    moved = down.join(least, "a").select(F.col("b").alias("a"), F.col("low").alias("b"))
    return moved.union(least.select("a", F.col("low").alias("b"))).filter("a <> b").distinct()


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of the edges (a, b): root is the smallest node that it reaches.

    Null ends and loops are no edges. Each round writes its edges to the shared folder, which cuts the
    lineage; the rounds grow with the logarithm of the longest path. Only a count and a checksum of
    each round reach the driver.
    """
    seen = None
    with ExitStack() as held:
        now = held.enter_context(staged(edges.select("a", "b").filter("a <> b").distinct(), "edges"))
        while True:
            with held.pop_all():  # the round before goes once this one is written
                now = held.enter_context(staged(_small_star(_large_star(now)), "edges"))
            state = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
            if state == seen:
                return stage(now.select(F.col("a").alias("node"), F.col("b").alias("root")), "components")
            seen = state
