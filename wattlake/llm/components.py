"""Connected components by alternating large and small stars.

Every step is a grouping and a join of edges; no component is gathered, and each
step is written to the shared folder, which cuts the plan.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wattlake.llm.common import stored


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """One star step over edges ``(u, v)`` with ``u > v``."""
    if large:  # neighbours on both sides; only the larger ones move
        around = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    else:
        around = edges
    least = around.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    moved = around.join(least, "u")
    if large:
        moved = moved.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        moved = moved.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(
            least.select("u", F.col("m").alias("v"))
        )
    return moved.where("u <> v").distinct()


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def components(edges: DataFrame) -> DataFrame:
    """``(u, root)`` of every node that is not the least of its component, from edges ``(u, v)`` of longs."""
    edges = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v").distinct()
    edges = stored(edges)
    state = _state(edges)
    while state[0]:
        edges = stored(_star(stored(_star(edges, True)), False))
        now = _state(edges)
        if now == state:
            break
        state = now
    return edges.select("u", F.col("v").alias("root"))
