"""Connected components by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from partsight.llm.common import stored


def _large_star(edges: DataFrame) -> DataFrame:
    """Each node hangs its larger neighbours onto the least node around it."""
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("root"))
    return both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("root").alias("b"))


def _small_star(edges: DataFrame) -> DataFrame:
    """Each node hangs itself and its smaller neighbours onto the least of them."""
    least = edges.groupBy("a").agg(F.min("b").alias("root"))
    moved = edges.join(least, "a").select(F.col("b").alias("a"), F.col("root").alias("b")).where("a <> b")
    return moved.unionByName(least.select("a", F.col("root").alias("b")))


def components(edges: DataFrame) -> DataFrame:
    """node, component (the smallest node reachable) of every node that has an edge.

    ``edges``: a, b of any one integer type; loops, repeats and either direction do no harm. Every
    round is written to the shared folder; no node's edges are gathered. Rounds end when the edges
    stay the same, after about the logarithm of the longest path.
    """
    edges = edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    sums = F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h")
    edges, last = stored(edges, "edges"), None
    while True:
        state = edges.agg(*sums).first()
        if state == last or not state["n"]:
            return edges.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(
                edges.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
            )
        last = state
        edges = stored(_small_star(_large_star(edges).distinct()).distinct(), "edges")
