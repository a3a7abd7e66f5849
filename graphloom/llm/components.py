"""Connected components of an edge list, as rounds of joins and minima (alternating stars)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.llm.common import checkpointed


def components(edges: DataFrame) -> DataFrame:
    """Columns ``node``, ``label``: the smallest node that each node with an edge reaches.

    ``edges`` has columns ``u`` and ``v``. Each round ties a node's greater neighbours to its
    least one, then its lesser ones to the least; it ends when a round changes no edge, after
    about the logarithm of the longest path. Minima are combined before they are shuffled.
    """
    now = checkpointed(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    state = None
    while True:
        found = now.agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("u", "v")).alias("x")).first()
        if tuple(found) == state or not found["n"]:
            break
        state = tuple(found)
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        now = checkpointed(small.unionByName(least.select("u", F.col("m").alias("v"))).distinct())
    labels = now.select(F.col("u").alias("node"), F.col("v").alias("label"))
    return labels.unionByName(labels.select(F.col("label").alias("node"), "label").distinct())
