"""Exact top-k search by inner product: tiled matrix products, partial selection, tree merging.

Vectors are quantised to integers, so that scores are exact. A task multiplies tiles of its
block of queries with its shard, selects the best of each row of a tile, and the lists of a
query are merged as a tree (:mod:`graphloom.llm.vectors`).

Cases: vectors that are null or hold a null or non-finite component, and rows without an id,
take no part. Repeated rows each count; equal scores go to the smaller id. An empty table gives no
rows. Components whose multiple is beyond a double's range are set to its ends, and so are scores
beyond the range of 64 bits. Other columns of the input are not read, whatever their names.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.llm.vectors import Blocks, best, queries_of, search, usable

#: Queries of a tile.
TILE = 128
LONG = np.iinfo(np.int64)


def quantised(v: np.ndarray, scale: int) -> np.ndarray:
    """Integral values; those beyond a double's range are its greatest or least one."""
    with np.errstate(over="ignore"):
        found = np.floor(v * float(scale))
    return np.nan_to_num(found, posinf=np.finfo(np.float64).max, neginf=np.finfo(np.float64).min)


def products(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Inner products of integral vectors, exactly."""
    greatest = max(1, q.shape[1]) * np.abs(q).max(initial=0) * np.abs(x).max(initial=0)
    if greatest < 2**53:  # all partial sums are exact in double precision
        return (q @ x.T).astype(np.int64)
    exact = np.array([[int(n) for n in row] for row in q], object) @ np.array([[int(n) for n in row] for row in x], object).T
    return np.clip(exact, LONG.min, LONG.max).astype(np.int64)


def inner_product_search(vectors: DataFrame, is_query: Column, k: int = 5, scale: int = 256, vec_id: str = "vec_id", embedding: str = "embedding", blocks: Blocks = Blocks()) -> DataFrame:
    """The ``k`` greatest inner products of each query; ``is_query`` is over the column ``id``."""

    def task(q_ids: np.ndarray, q: np.ndarray, _: np.ndarray, ids: np.ndarray, x: np.ndarray):
        q, x = quantised(q, scale), quantised(x, scale)
        at, found, scores = [], [], []
        for lo in range(0, len(q), TILE):
            tile = products(q[lo : lo + TILE], x)
            for i, row in enumerate(tile, lo):
                first, last = np.searchsorted(ids, q_ids[i], "left"), np.searchsorted(ids, q_ids[i], "right")
                rest = ids if first == last else np.delete(ids, slice(first, last))
                row = row if first == last else np.delete(row, slice(first, last))
                top = best(row, rest, k)
                at.append(np.full(len(top), i))
                found.append(rest[top])
                scores.append(row[top])
        return np.concatenate(at), np.concatenate(found), np.concatenate(scores)

    rows = usable(vectors, vec_id, embedding, zero=True)
    queries = queries_of(rows, is_query).withColumn("radius", F.lit(0.0))
    return search(rows, queries, task, "long", k, False, blocks)
