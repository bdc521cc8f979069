"""Connected components of an edge table, by alternating star contraction.

Large-star and small-star rounds shrink the graph to stars around the smallest
id of each component. Every round is two aggregations to a minimum, combined before
the shuffle, and a join that gives each edge the minimum of its end. A node that very
many edges have is met by those edges where they are, so they never gather in one
task. Each round is written to the shared folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quorumframe.operators.skew import hot_join
from quorumframe.storage import materialise


def _with_least(edges: DataFrame, least: DataFrame, few: bool) -> DataFrame:
    """edges with the least neighbour m of their end u."""
    if few:  # too few edges for any node to be hot
        return edges.join(least.drop("n"), "u")
    return hot_join(edges, materialise(least, "least"), "u", "n")


def _large_star(edges: DataFrame, few: bool) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"), F.count("*").alias("n"))
    return _with_least(both.where("v > u"), least, few).select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()


def _small_star(edges: DataFrame, few: bool) -> DataFrame:
    least = edges.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n"))
    moved = _with_least(edges, least, few).where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionByName(least.select("u", F.col("m").alias("v"))).distinct()


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """node, component (its smallest node) for each node of edges (u, v), of any type that has an order.

    Loops, repeated edges and either direction are fine; a null end drops the
    edge; no edges give no rows. Nodes without edges do not appear.
    """
    edges = edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    edges, last = materialise(edges, "edges"), None
    for _ in range(max_rounds):
        few = edges.count() <= 5_000
        large = _large_star(edges, few)
        edges = materialise(_small_star(large if few else materialise(large, "large-star"), few), "edges")
        state = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == last:
            break
        last = state
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    stars = edges.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return stars.unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
