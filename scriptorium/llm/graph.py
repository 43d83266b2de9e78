"""Connected components of a graph given as an edge table, entirely on Spark."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut


def components(edges: DataFrame, a: str, b: str) -> DataFrame:
    """(node, root) for each node of ``edges``: root is the smallest node reachable. Alternating star
    contraction: every node links its larger neighbours, then its smaller ones, to the smallest node it
    knows, until nothing changes (the rounds grow with the logarithm of the longest path). A node's
    neighbours are never gathered; the smallest one comes from a partial aggregate. Each round is
    checkpointed, so a lost executor costs one round at most. Null ends and loops are dropped."""
    edges = cut(edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v"))
                .where("u is not null and v is not null and u <> v").distinct())
    before = None
    while True:
        # large stars: larger neighbours go to the smallest node known
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = (both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
                 .where("u <> v").distinct())
        # small stars: the node itself and its smaller neighbours go to the smallest of them
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
        edges = cut(small.union(least.select("u", F.col("m").alias("v"))).distinct())
        state = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v") % (1 << 40))).first()
        if state == before:
            break
        before = state
    roots = edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return roots.union(edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
