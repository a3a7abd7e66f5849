"""Searches of a stated query set against all vectors, in blocks.

Rows are dealt by a hash of their id to shards, queries to blocks, both of bounded size, and a
task gets one shard and one block. What it returns for a query is merged over the shards as a
tree, so that no task sees more than a few lists of a query.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Blocks:
    """``shard_rows``: least rows of a shard; with more rows than ``shards`` such shards take,
    shards grow up to ``most_rows``, so that queries are sent to fewer of them. ``block_rows``:
    queries of a block. ``fan_in``: shards whose lists are merged at a time."""

    shard_rows: int = 8192
    most_rows: int = 65_536
    shards: int = 64
    block_rows: int = 16_384
    fan_in: int = 16

    def count(self, rows: int) -> int:
        size = min(self.most_rows, max(self.shard_rows, rows // self.shards))
        return max(1, math.ceil(rows / size))


def usable(vectors: DataFrame, vec_id: str, embedding: str, zero: bool) -> DataFrame:
    """Columns ``id`` and ``v`` of rows with an id and a vector of finite components.

    ``zero``: whether vectors of zeros take part.
    """
    rows = vectors.select(F.col(vec_id).cast("long").alias("id"), F.col(embedding).cast("array<double>").alias("v"))
    sound = F.forall("v", lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < float("inf")), F.lit(False)))
    rows = rows.where(F.col("id").isNotNull() & F.col("v").isNotNull() & sound)
    return rows if zero else rows.where(F.exists("v", lambda x: x != 0))


def matrix(ids: pa.ChunkedArray, vectors: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ids and vectors in order of the id, and the order."""
    ids = ids.to_numpy()
    v = np.concatenate([c.flatten().to_numpy(zero_copy_only=False) for c in vectors.chunks])
    order = np.argsort(ids, kind="stable")
    return ids[order], v.reshape(len(ids), -1)[order], order


def queries_of(rows: DataFrame, is_query: Column) -> DataFrame:
    """Columns ``id`` and ``v``: an id that repeats is asked once, with its first vector in order."""
    return rows.where(is_query).groupBy("id").agg(F.min("v").alias("v"))


def best(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the ``k`` greatest scores, ties to the smaller id; ``ids`` ascend."""
    at = np.arange(len(scores))
    if len(scores) > k:
        at = np.flatnonzero(scores >= np.partition(scores, len(scores) - k)[len(scores) - k])
    return at[np.lexsort((ids[at], -scores[at]))[:k]]


Search = Callable[[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray, np.ndarray]]


def search(rows: DataFrame, queries: DataFrame, task: Search, score_type: str, k: int, smallest: bool, blocks: Blocks) -> DataFrame:
    """Columns query_id, rank, vec_id, score: of each query its ``k`` best rows.

    ``task`` gets ids, vectors and radii of queries (id, v, radius), ids and vectors of rows, and
    returns places of queries, ids of rows and scores. Only vectors of a query's own length are
    its candidates. Rows with a query's id are not its candidates; those that repeat each count.
    """
    shards, parts = blocks.count(rows.count()), max(1, math.ceil(queries.count() / blocks.block_rows))
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = queries.select(F.size("v").alias("dim"), every(shards).alias("shard"), F.pmod(F.xxhash64("id"), F.lit(parts)).cast("int").alias("part"), "id", "v", "radius")
    right = rows.select(F.size("v").alias("dim"), F.pmod(F.xxhash64("id"), F.lit(shards)).cast("int").alias("shard"), every(parts).alias("part"), F.col("id").alias("row_id"), F.col("v").alias("row_v"))
    kind = pa.int64() if score_type == "long" else pa.float64()

    def run(key: tuple, q: pa.Table, x: pa.Table) -> pa.Table:
        names = ["query_id", "vec_id", "score", "shard"]
        if not q.num_rows or not x.num_rows:
            return pa.table([pa.array([], t) for t in (pa.int64(), pa.int64(), kind, pa.int32())], names=names)
        q_ids, q_vectors, order = matrix(q.column("id"), q.column("v"))
        at, ids, scores = task(q_ids, q_vectors, q.column("radius").to_numpy()[order], *matrix(x.column("row_id"), x.column("row_v"))[:2])
        return pa.table([pa.array(q_ids[at]), pa.array(ids), pa.array(scores, kind), pa.array(np.full(len(at), key[1].as_py(), np.int32))], names=names)

    keys = ("dim", "shard", "part")
    lists = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(run, f"query_id long, vec_id long, score {score_type}, shard int")
    while True:
        shards = math.ceil(shards / blocks.fan_in)
        lists = lists.withColumn("shard", (F.col("shard") / blocks.fan_in).cast("int"))
        order = Window.partitionBy("query_id", "shard").orderBy(F.col("score") if smallest else F.desc("score"), "vec_id")
        lists = lists.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
        if shards == 1:
            return lists.select("query_id", "rank", "vec_id", "score")
        lists = lists.drop("rank")
