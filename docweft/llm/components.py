"""Connected components of an edge table by alternating large-star and small-star steps.

Every step is an aggregation with map-side combine and a join; nothing of the graph reaches the driver but one row of
counters per round. Each round is written to the shared folder, so a lost executor re-reads it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docweft.session import durable, release


def _low(edges: DataFrame) -> DataFrame:
    """Each node's smallest neighbour, written, so that the join with a node of many edges can be split at run time."""
    return durable(edges.groupBy("u").agg(F.min("v").alias("m")))


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    lowest = _low(both)
    out = durable(both.join(lowest.select("u", F.least("u", "m").alias("m")), "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct())
    release(lowest)
    return out


def _small_star(edges: DataFrame) -> DataFrame:
    lowest = _low(edges)
    moved = edges.join(lowest, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    out = durable(moved.unionByName(lowest.select("u", F.col("m").alias("v"))).distinct())
    release(lowest)
    return out


def components(edges: DataFrame) -> DataFrame:
    """``node, component`` for every node of ``edges(u, v)`` but the component's own smallest node.

    The component's id is its smallest node. Edges are undirected; self loops are ignored. The rounds, whose number grows with
    the logarithm of the longest path, end when one changes nothing.
    """
    oriented = edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    now, before = durable(oriented), None
    while (mark := now.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v"))).first()) != before:
        before = mark
        large = _large_star(now)
        release(now)
        now = _small_star(large)
        release(large)
    return now.select(F.col("u").alias("node"), F.col("v").alias("component"))
