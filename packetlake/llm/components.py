"""Connected components by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, split_exchange


def _are_stars(edges: DataFrame) -> bool:
    """Whether every node hangs on one other, which hangs on none."""
    ends = edges.select(F.explode(F.array(F.struct(F.col("u").alias("node"), F.lit(1).alias("down"), F.lit(0).alias("up")), F.struct(F.col("v").alias("node"), F.lit(0).alias("down"), F.lit(1).alias("up")))).alias("e"))
    nodes = ends.select("e.*").groupBy("node").agg(F.sum("down").alias("down"), F.max("up").alias("up"))
    return nodes.where("down > 1 or down = 1 and up = 1").limit(1).count() == 0


def connected_components(pairs: DataFrame) -> DataFrame:
    """(node, root) for each end of the two-column ``pairs`` of longs; the root is the component's smallest node.

    Each step hangs nodes on smaller ones until every component is a star; the number of steps grows
    with the logarithm of its length, and each step's edges are checkpointed. Pairs may repeat, be
    reversed or join a node to itself (such a node alone is left out). No pairs, no rows.
    """
    a, b = pairs.columns
    edges = cut(pairs.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u != v").distinct())
    while not _are_stars(edges):
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select(split_exchange("u"), F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        joined = large.join(least.select(split_exchange("u"), "m"), "u").where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        edges = cut(joined.unionByName(least.select("u", F.col("m").alias("v"))).distinct())
    roots = edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return roots.unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
