"""Connected components of a graph of long ids, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..session import cut_lineage


def _least(edges: DataFrame) -> DataFrame:
    """Per node ``u`` the least of itself and its neighbours ``v``; combines before the shuffle."""
    return edges.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))


def _large(edges: DataFrame) -> DataFrame:
    both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    # every larger neighbour moves to the least node around; a hot centre is a skewed join, which Spark splits
    return both.join(_least(both), "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small(edges: DataFrame) -> DataFrame:
    least = _least(edges)  # edges lead from the larger node down
    moved = edges.join(least, "u").filter("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.union(least.select("u", F.col("m").alias("v"))).filter("u > v").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(u, v) edges of longs to (node, root): every node that has an edge, with the least node reachable from it.

    Null ends and loops are left out. Each round is written to the shared folder, and rounds end when the edges no
    longer change; only two numbers a round reach the driver.
    """
    e = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).filter("u > v").distinct()
    e, before = cut_lineage(e), None
    while True:
        now = tuple(e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first())
        if not now[0] or now == before:
            break
        before = now
        e = cut_lineage(_small(cut_lineage(_large(e))))
    return e.select(F.col("u").alias("node"), F.col("v").alias("root")).union(e.select("v", "v").distinct())
