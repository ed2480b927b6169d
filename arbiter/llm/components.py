"""Connected components by alternating large-star and small-star steps over an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Workspace


def connected_components(edges: DataFrame, work: Workspace) -> DataFrame:
    """``edges(a long, b long)`` to ``(node, component)``: the smallest node reachable, itself included.

    Nodes are those of the edges; null ends and loops are ignored, repeated edges count once, an
    empty table gives no rows. Each step is written to the shared folder, so lineage stays short;
    the number of steps grows with the logarithm of a component's size. A node's smallest
    neighbour is a partially aggregated minimum, so a hub of any degree is never gathered.
    """
    e = edges.where("a IS NOT NULL AND b IS NOT NULL AND a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    now, seen = work.save(e), None
    while True:
        # Large star: every neighbour larger than u goes to the smallest of u and its neighbours.
        both = now.select("u", "v").unionAll(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        # Small star: u's smaller neighbours, and u itself, go to the smallest of them.
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        after = work.save(small.unionAll(low.select("u", F.col("m").alias("v"))).distinct())
        state = tuple(after.agg(F.count("*"), F.sum(F.hash("u", "v").cast("long"))).first())
        work.drop(now)
        now = after
        if state == seen:
            break
        seen = state
    stars = now.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return stars.unionAll(now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
