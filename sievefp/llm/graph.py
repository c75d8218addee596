"""Connected components of a graph that is an edge table, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sievefp.llm.common import drop, stored, told


def components(edges: DataFrame) -> DataFrame:
    """node, comp: the smallest node that edges (a, b) of longs lead to, for every node in them.

    Each step hangs nodes on smaller neighbours; the number of steps grows with the logarithm
    of the longest path, and they end when a step changes nothing.  No node's edges are
    gathered in one row, and minima are taken before the shuffle; the joins on a node with
    many edges are plain ones that AQE splits.
    """
    same = F.sum(F.pmod(F.xxhash64("u", "v"), F.lit((1 << 31) - 1))).alias("same")
    edge = edges.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    stars = stored(edge, "stars", same)
    while True:
        both = stars.unionByName(stars.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        before, stars = stars, stored(small.unionByName(low.withColumnRenamed("m", "v")).distinct(), "stars", same)
        drop(before)
        if (told(before), told(before, "same")) == (told(stars), told(stars, "same")):
            break
    nodes = edges.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    return nodes.join(stars.withColumnsRenamed({"u": "node", "v": "comp"}), "node", "left").select("node", F.coalesce("comp", "node").alias("comp"))


def labels(edges: DataFrame) -> DataFrame:
    """node, comp: the smallest node within two edges.  Nodes of one label are connected, not
    the other way round; a star's nodes all have one."""
    both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    near = both.groupBy("a").agg(F.least("a", F.min("b")).alias("m"))
    return both.join(near.withColumnRenamed("a", "b"), "b").groupBy(F.col("a").alias("node")).agg(F.min("m").alias("comp"))
