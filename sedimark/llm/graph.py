"""Connected components by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _common
from ._common import discard, materialize


def _with_least(rows: DataFrame, most: int) -> DataFrame:
    """Rows (u, v), ``most`` at most, with m, the least of u and its v.

    The few nodes with HOT_ROWS rows or more (centres of stars) are broadcast, if there can be any; rows of the others meet theirs by shuffle.
    """
    least = rows.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m"), F.count("*").alias("degree"))
    if most < _common.HOT_ROWS:
        return rows.join(least.drop("degree"), "u")
    hot = F.broadcast(least.where(F.col("degree") >= _common.HOT_ROWS).select("u", "m"))
    cold = rows.join(hot.select("u"), "u", "left_anti").join(least.where(F.col("degree") < _common.HOT_ROWS).select("u", "m"), "u")
    return rows.join(hot, "u").unionByName(cold)


def _state(edges: DataFrame) -> tuple[int, bool]:
    """Edges (u, v < u), and whether they are stars: each u has one v, and no v is a u."""
    ends = edges.select(F.explode(F.array(F.struct(F.col("u").alias("node"), F.lit(1).alias("out")), F.struct(F.col("v").alias("node"), F.lit(0).alias("out")))).alias("e"))
    nodes = ends.groupBy("e.node").agg(F.sum("e.out").alias("out"), F.count("*").alias("ends"))
    n, loose = nodes.agg(F.sum("out"), F.count(F.when((F.col("out") > 0) & (F.col("ends") > 1), 1))).first()
    return n or 0, not loose


def components(links: DataFrame) -> DataFrame:
    """node, component (least node reachable) for every node of the links (u, v).

    Links may repeat and point either way; a node linked with itself alone is its own
    component. Each round keeps one edge per node and least neighbour, so it never holds more
    rows than the links; rounds grow with the logarithm of the longest chain, and stars need none.
    """
    nodes = links.select(F.col("u").alias("node")).union(links.select(F.col("v").alias("node"))).distinct()
    edges = materialize(links.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    while True:
        rows, done = _state(edges)
        if done:
            break
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _with_least(both, 2 * rows).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        down = materialize(large.where("u <> v").distinct())  # v < u in each
        small = _with_least(down, 2 * rows).select(F.explode(F.array(F.struct("v", "m"), F.struct(F.col("u").alias("v"), "m"))).alias("e"))
        old, edges = edges, materialize(small.select(F.col("e.v").alias("u"), F.col("e.m").alias("v")).where("u <> v").distinct())
        discard(old)
        discard(down)
    least = edges.select(F.col("u").alias("node"), F.col("v").alias("component"))  # one row a node
    return nodes.join(least, "node", "left").select("node", F.coalesce("component", "node").alias("component"))
