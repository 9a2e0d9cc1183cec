"""Connected components of a distributed edge list by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from replicakit.llm.common import stored


def _both(edges: DataFrame) -> DataFrame:
    return edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))


def connected_components(edges: DataFrame) -> DataFrame:
    """``edges`` (a, b), b never null, to (node, component): the smallest node reachable.

    Large star: every neighbour above a node is linked to the node's smallest neighbour.
    Small star: every neighbour below it is, and the node itself. Each round aggregates a
    minimum per node map-side, writes it and joins it back, so both sides of the join are plain
    shuffles and adaptive execution splits a node with many neighbours; rounds grow with the
    logarithm of the longest path. Each round's edges are written to the scratch folder; the
    driver sees only a changed/unchanged flag.
    """
    def star(links: DataFrame, large: bool) -> DataFrame:
        near = _both(links) if large else links.select(
            F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        low = stored(near.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("low")), "least")
        out = near.join(low, "a")
        if large:
            moved = out.filter(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("low").alias("b"))
        else:
            moved = out.select(F.col("b").alias("a"), F.col("low").alias("b")).union(
                low.select("a", F.col("low").alias("b")))
        return moved.filter(F.col("a") != F.col("b")).distinct()

    edges = stored(edges.filter(F.col("a") != F.col("b")).select(
        F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    while True:
        # Stars are done when no node has two smaller neighbours and none is both a centre and a leaf.
        centres = edges.select(F.col("b").alias("a")).distinct()
        many = edges.groupBy("a").count().filter("count > 1").select("a")
        if many.union(edges.join(centres, "a", "left_semi").select("a")).isEmpty():
            break
        edges = stored(star(stored(star(edges, True), "edges"), False), "edges")
    return edges.select(F.col("a").alias("node"), F.col("b").alias("component")).union(
        edges.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
