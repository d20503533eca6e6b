"""Connected components of an edge table by alternating stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pactum.llm.frames import written

ROUNDS = 60


def _star(edges: DataFrame) -> DataFrame:
    """Every node's neighbours, and the node itself, are tied to the smallest of them."""
    least = edges.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
    return edges.join(least, "u")


def components(edges: DataFrame) -> DataFrame:
    """node, component for every node of the edges (a, b): component is the smallest node it reaches.

    A round moves ties to smaller nodes, first from larger neighbours, then from smaller ones; the number of
    rounds grows with the logarithm of the longest chain.  Minima are combined before the shuffle and the
    joins back can be split, so one node with very many neighbours is no single task.
    """
    ties = written(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "ties")
    for _ in range(ROUNDS):
        both = ties.unionByName(ties.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _star(both).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        small = _star(large)
        down = small.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(small.select("u", F.col("m").alias("v")))
        after = written(down.where("u <> v").distinct(), "ties")
        if after.count() == ties.count() and after.join(ties, ["u", "v"], "left_anti").isEmpty():
            break
        ties = after
    else:
        raise ValueError("components did not settle")
    nodes = ties.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return nodes.unionByName(nodes.select(F.col("component").alias("node"), "component").distinct())
