"""Connected components of an edge table, by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch


def _are_stars(edges: DataFrame) -> bool:
    """No node has two smaller neighbours, and none is both below one node and above another."""
    ends = edges.select(F.col("a").alias("node"), F.lit(1).alias("up"), F.lit(0).alias("down")).unionByName(edges.select(F.col("b").alias("node"), F.lit(0).alias("up"), F.lit(1).alias("down")))
    count = ends.groupBy("node").agg(F.sum("up").alias("up"), F.max("down").alias("down"))
    return count.where("up > 1 or (up = 1 and down = 1)").isEmpty()


def components(edges: DataFrame, held: Scratch) -> DataFrame:
    """edges: a, b (long). Per node with an edge to a smaller one: node, component (the smallest node reachable).

    The result is a table of ``held``. A hub's minimum is taken before the shuffle; no task gathers a group. Loops and
    repeated edges are ignored.
    """
    edges = held.put(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    while not _are_stars(edges):
        # large star: u's larger neighbours go to the smallest of u and its neighbours. The minima are written, so that Spark
        # can deal a hub's edges to several tasks of the join
        least = held.put(edges.groupBy(F.col("a").alias("u")).agg(F.min("b").alias("m")), "least")
        edges = edges.join(least, F.col("b") == F.col("u"), "left").select("a", F.coalesce("m", "b").alias("b")).distinct()
        edges = held.put(edges, "edges")
        # small star: smaller neighbours of u, and u, go to the smallest of them
        least = edges.groupBy("a").agg(F.min("b").alias("m"))
        near = edges.join(least, "a")
        edges = near.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(near.select("a", F.col("m").alias("b")))
        edges = held.put(edges.where("a <> b").distinct(), "edges")
    return edges.select(F.col("a").alias("node"), F.col("b").alias("component"))
