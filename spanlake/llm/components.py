"""Connected components of a large edge table, by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanlake.llm.common import stored


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """One step on edges (u, v), u > v. Large star: each node's larger neighbours move to its smallest neighbour or itself.
    Small star: its smaller neighbours and itself move to its smallest neighbour."""
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v"))) if large else edges
    least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
    linked = both.join(least, "u")
    if large:
        out = linked.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        out = linked.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
    return out.where("u > v").distinct()


def components(edges: DataFrame, rounds: int = 40) -> DataFrame:
    """(node, component) for every node of ``edges`` (a, b); the component is its smallest node.

    The number of rounds grows with the logarithm of the largest component; each round's edges are written to the shared
    folder. Self loops and repeated edges are ignored, an empty table gives an empty one.
    """
    now = stored(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u > v").distinct(), "edges")
    seen = None
    for _ in range(rounds):
        now = stored(_star(_star(now, True), False), "edges")
        mark = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if mark == seen:
            roots = now.select(F.col("v").alias("node")).distinct().withColumn("component", F.col("node"))
            return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)
        seen = mark
    raise RuntimeError(f"no fixed point after {rounds} rounds")
