"""Connected components of a graph of ids, by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ridelake.operators.scale import materialized


#: Edges per task; a graph that is small beside its corpus does not take a task per partition.
TASK_EDGES = 250_000


def _least(edges: DataFrame) -> DataFrame:
    """(u, m): the smallest of each node and its neighbours; combined in each task before the shuffle."""
    return edges.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))


def _downward(edges: DataFrame, tasks: int) -> DataFrame:
    """Distinct edges from the larger to the smaller node, without loops."""
    ordered = edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    return ordered.coalesce(tasks).distinct().coalesce(tasks)


def components(edges: DataFrame) -> DataFrame:
    """(node, component) of every node on an edge (u, v): the smallest node it can reach.

    Edges may repeat, run either way or be loops; nulls are left out. Each round moves neighbours
    to the smallest known node (large star), then small neighbours onto one another (small star),
    until no edge changes; rounds grow with the logarithm of the longest path. Every round is
    checkpointed in the shared folder; only a sum of hashes reaches the driver.
    """
    known = materialized(edges.select(F.col("u").cast("long"), F.col("v").cast("long")).dropna())
    tasks = max(1, known.count() // TASK_EDGES)
    nodes = known.select(F.col("u").alias("node")).union(known.select("v")).coalesce(tasks).distinct()
    current = materialized(_downward(known, tasks))
    before = None
    while True:
        state = current.agg(
            F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")), F.min("u"), F.max("v")
        ).first()
        if state == before or not state[0]:
            break
        before = state
        both = current.union(current.select(F.col("v").alias("u"), F.col("u").alias("v"))).coalesce(tasks)
        large = both.join(_least(both), "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        # Each edge runs from the larger node down, so a node's neighbours here are smaller.
        down = materialized(_downward(large, tasks))
        small = down.join(_least(down), "u")
        moved = small.select(
            F.explode(F.array(F.struct(F.col("v").alias("u"), "m"), F.struct("u", "m"))).alias("e")
        ).select(F.col("e.u").alias("u"), F.col("e.m").alias("v"))
        current = materialized(_downward(moved, tasks))
    found = current.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return nodes.join(found, "node", "left").select("node", F.coalesce("component", "node").alias("component"))
