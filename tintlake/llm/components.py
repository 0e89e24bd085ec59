"""Connected components of an edge table by alternating large and small stars.

All steps are aggregations and joins on edges; nothing is gathered in one task or on the driver. Minima are pre-aggregated.
Nodes with more than 1 / HUBS of all edge ends, of which there can be no more than HUBS, get their minimum by a broadcast,
so no hub's edges meet in one task. Each round is stored in the shared folder. Rounds grow with the logarithm of the longest
path; every round but the last lowers some edge, so they come to an end.

An empty table gives an empty result; loops, nulls and repeated edges are left out.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tintlake.llm.shared import stored

HUBS = 200


def _least_of(both: DataFrame, least: DataFrame, ends: int) -> DataFrame:
    """both with `m`, the least neighbour of u."""
    hubs = least.where(F.col("n") > max(ends // HUBS, 100)).select("u", F.col("m").alias("hub_m"))  # HUBS rows at most
    both = both.join(F.broadcast(hubs), "u", "left")
    rest = both.where("hub_m is null").drop("hub_m").join(least.select("u", "m"), "u")
    return both.where("hub_m is not null").select("u", "v", F.col("hub_m").alias("m")).union(rest.select("u", "v", "m"))


def _star(edges: DataFrame, large: bool, ends: int) -> DataFrame:
    """large: each node's larger neighbours move to its least one. Otherwise: its smaller ones and the node itself do."""
    both = edges.union(edges.select("v", "u")) if large else edges
    least = both.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("n")).select("u", F.least("u", "m").alias("m"), "n")
    if large:
        moved = _least_of(both.where("v > u"), least, ends).select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        moved = _least_of(both, least, ends).select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m").alias("v")))
    moved = moved.where("u > v")
    return moved if large else moved.distinct()


def components(edges: DataFrame) -> DataFrame:
    """node, component (its least node) of every node that has an edge. edges: two columns of longs."""
    a, b = edges.columns
    now = stored(edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where(f"{a} is not null and {b} is not null and u > v").distinct(), "edges")
    ends = 2 * now.count()
    while ends:
        now = stored(_star(stored(_star(now, True, ends), "edges"), False, ends), "edges")
        # done when there are only stars, where no centre has a centre of its own
        if now.select("v").join(now.select(F.col("u").alias("v")), "v", "left_semi").isEmpty():
            break
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).union(now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
