"""Bounded traversals over an edge list with columns ``src`` and ``dst``.

A traversal is a loop of frontier joins, each node kept at its least depth; the loop is bounded
by its depth. The edges are cut from their lineage once, before the loop, and each round's frontier after it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.checkpoints import cut


def reversed_edges(edges: DataFrame) -> DataFrame:
    """Edges the other way round, for traversals from callee to caller."""
    return edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))


def neighbours(edges: DataFrame, seeds: DataFrame, depth: int) -> DataFrame:
    """Pairs ``origin``, ``node``, ``depth`` of nodes 1 to ``depth`` steps from each origin.

    ``seeds`` has a column ``origin``. A node has its least depth. An origin is itself in the
    result if a cycle leads back to it.
    """
    edges = cut(edges.select("src", "dst").distinct())
    step = lambda rows, d: rows.join(edges, F.col("node") == F.col("src")).select("origin", F.col("dst").alias("node"), F.lit(d).alias("depth")).distinct()
    front = cut(step(seeds.select("origin", F.col("origin").alias("node")).distinct(), 1))
    seen = front
    for d in range(2, depth + 1):
        front = cut(step(front, d).join(seen, ["origin", "node"], "left_anti"))
        if front.isEmpty():
            break
        seen = seen.unionByName(front)
    return seen


def depths(edges: DataFrame, seeds: DataFrame, max_depth: int | None = None) -> DataFrame:
    """``node`` and its least ``depth`` from any of the seeds (column ``node``), which are at 0."""
    edges = cut(edges.select("src", "dst").distinct())
    front = cut(seeds.select("node").distinct().withColumn("depth", F.lit(0)))
    seen, d = front, 0
    while max_depth is None or d < max_depth:
        d += 1
        found = front.join(edges, F.col("node") == F.col("src")).select(F.col("dst").alias("node")).distinct()
        front = cut(found.join(seen, "node", "left_anti").withColumn("depth", F.lit(d)))
        if front.isEmpty():
            break
        seen = seen.unionByName(front)
        if d % 8 == 0:
            seen = cut(seen)
    return seen
