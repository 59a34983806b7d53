"""Connected components of links between rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from tallyhire.operators.settle import settled


def connected(links: DataFrame) -> DataFrame:
    """(node, root): every node of the links (u, v) with the smallest node it reaches.

    Each round every node learns the smallest root among its neighbours, and then the root of that root, so paths
    shrink by more than half.  Both steps are joins and aggregates by key; no neighbour list is gathered.  The rounds
    end when no root changes.  Links may repeat, point either way or be loops; no links give no rows.
    """
    both = settled(links.select("u", "v").union(links.select("v", "u")).where("u <> v").distinct())
    roots = both.groupBy("u").agg(F.min("v").alias("low")).select(F.col("u").alias("node"), F.least("u", "low").alias("root"))
    while True:
        heard = both.join(roots.select(F.col("node").alias("v"), "root"), "v").groupBy("u").agg(F.min("root").alias("heard"))
        nearer = roots.join(heard.withColumnRenamed("u", "node"), "node").select(
            "node", "root", F.least("root", "heard").alias("next"))
        further = roots.select(F.col("node").alias("next"), F.col("root").alias("further"))
        moved = settled(nearer.join(further, "next").select(
            "node", F.least("next", "further").alias("root"), (F.least("next", "further") < F.col("root")).alias("moved")))
        roots = moved.select("node", "root")
        if moved.where("moved").isEmpty():
            return roots
