"""Connected components of an edge table by star contraction, each round written to the shared folder."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from tallyhire.operators.settle import settled


def _both_ways(edges: DataFrame) -> DataFrame:
    return edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))


def _round(edges: DataFrame) -> DataFrame:
    """Large star, then small star: every node hands its neighbours to the smallest node it knows.

    A node's smallest neighbour is an aggregate, combined before the shuffle; no neighbour list is ever gathered, so a
    hub costs no more than its edges.
    """
    def smallest(pairs: DataFrame) -> DataFrame:
        return pairs.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))

    both = _both_ways(edges)
    large = (
        both.join(smallest(both), "u").where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v"))
        .where("u <> v").distinct()
    )
    down = large.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = smallest(down)
    small = (
        down.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        .union(least.select("u", F.col("m").alias("v"))).where("u <> v").distinct()
    )
    return small


def components(edges: DataFrame) -> DataFrame:
    """(node, root): every node of an edge (u, v) with the smallest node that it can reach.

    Edges may repeat, point either way or be loops.  Each round at least halves the paths to the root, so the number
    of rounds follows the logarithm of the longest path.
    """
    edges = settled(edges.select("u", "v").where("u <> v").distinct())
    mark = None
    while True:
        seen = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if seen[0] == 0 or seen == mark:
            break
        mark, edges = seen, settled(_round(edges))
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
