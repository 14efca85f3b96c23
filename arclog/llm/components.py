"""Connected components by alternating large and small stars.

Each half round points every node at the smallest node it knows; the number of rounds grows
with the logarithm of the longest chain. Nothing is collected but one line of figures a
round. Tables are cut from their lineage in the shared checkpoint folder, so a lost executor
costs one half round at most.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from arclog.llm.common import checkpointed


def _both(edges: DataFrame) -> DataFrame:
    return edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))


def _large_star(edges: DataFrame) -> DataFrame:
    """Each node's larger neighbours are pointed at its smallest neighbour or itself."""
    both = _both(edges)
    least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
    return both.where("b > a").join(least, "a").select(F.col("m").alias("a"), "b").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Each node and its smaller neighbours are pointed at the smallest of them. Edges: a < b."""
    least = edges.groupBy("b").agg(F.min("a").alias("m"))
    moved = edges.join(least, "b").where("a <> m").select(F.col("m").alias("a"), F.col("a").alias("b"))
    return moved.union(least.select(F.col("m").alias("a"), "b")).distinct()


def _figures(edges: DataFrame) -> tuple:
    """The number of edges and a sum over their hashes; equal when nothing has changed."""
    return tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of ``edges`` (a, b); component is its smallest node.

    Self loops and repeated edges are allowed; edges with a null end are ignored.
    """
    now = checkpointed(
        edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    )
    figures = _figures(now)
    while figures[0]:
        now = checkpointed(_small_star(_large_star(now)))
        before, figures = figures, _figures(now)
        if before == figures:
            break
    stars = now.select(F.col("b").alias("node"), F.col("a").alias("component"))
    return stars.union(now.select(F.col("a").alias("node"), F.col("a").alias("component")).distinct())
