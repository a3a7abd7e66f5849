"""Approximate nearest neighbours by collision-counting hashing.

A shard's index is a sorted array of each of a number of random projections of its vectors. A
query starts with a narrow window around its own value in each array and widens all windows
step by step (virtual rehashing: a wider window is a coarser bucket). Each vector that enters a
window counts a collision; a vector with enough collisions is verified by its exact distance.

How wide the windows get is told by a radius of the query's own, the same in all shards: at
first the distance at which its k-th neighbour is expected, by its distances to a sample and how
fast their number grows. A shard stops at this radius, or before, when its own k-th verified
vector is no farther than the windows stand for. Where the k-th distance over all shards is
beyond the radius, the query is asked again, with that distance as its radius; as it bounds the
true one, this ends. Every row is indexed and there is no limit on candidates: a vector within
the radius has a fixed chance to be missed, ``Params.z`` below its expected collisions. A query
that has no k candidates in the sample has an infinite radius and is compared with all vectors.

Cases: vectors that are null, zero, or hold a null or non-finite component, and rows without an
id, take no part. Repeated rows each count; equal distances go to the smaller id. Vectors of other
lengths than a query's are not its candidates. An empty table gives no rows. Other columns of the
input are not read, whatever their names.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.llm.common import checkpointed
from graphloom.llm.vectors import Blocks, matrix, queries_of, search, usable


@dataclass(frozen=True)
class Params:
    """A vector at the radius collides in a window of ``width`` times the radius with the chance
    that a normal value is within half of that; it is verified from ``z`` standard deviations
    below on, in ``projections`` arrays. ``steps``: shares of the radius to which windows widen.
    ``sample``: at most so many vectors tell the first radius."""

    projections: int = 192
    width: float = 2.0
    z: float = 1.4
    steps: tuple[float, ...] = (0.35, 0.7, 1.0)
    sample: int = 4096
    seed: int = 20

    @property
    def least(self) -> int:
        """Collisions from which on a vector is verified."""
        p = math.erf(self.width / 2 / math.sqrt(2))
        return max(1, math.floor(self.projections * p - self.z * math.sqrt(self.projections * p * (1 - p))))


def best_by_distance(distances: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the ``k`` smallest distances, nearest first, ties to the smaller id."""
    return np.lexsort((ids, distances))[:k]


def distances_to(x: np.ndarray, q: np.ndarray) -> np.ndarray:
    gap = x - q
    return np.sqrt((gap * gap).sum(axis=1))


class Index:
    """Sorted projections of a shard's vectors."""

    def __init__(self, x: np.ndarray, ids: np.ndarray, params: Params):
        self.x, self.ids, self.params = x, ids, params
        self.axes = np.random.default_rng(params.seed).standard_normal((x.shape[1], params.projections))
        values = (x @ self.axes).T
        order = np.argsort(values, axis=1, kind="stable")
        self.sorted = np.take_along_axis(values, order, axis=1)
        self.order = order.reshape(-1)
        self.verified = 0

    def windows(self, q: np.ndarray, radii: np.ndarray) -> np.ndarray:
        """Of each query, step and projection the bounds of its window, as places in ``order``."""
        at, n = q @ self.axes, len(self.x)
        half = np.outer(radii, self.params.steps) * self.params.width / 2
        rounding = 1e-9 * np.abs(at)
        out = np.empty((len(q), len(self.params.steps), 2, self.params.projections), np.int64)
        for j, row in enumerate(self.sorted):
            reach = half + rounding[:, j, None]
            out[:, :, 0, j] = np.searchsorted(row, at[:, j, None] - reach, "left") + j * n
            out[:, :, 1, j] = np.searchsorted(row, at[:, j, None] + reach, "right") + j * n
        return out

    def nearest(self, q: np.ndarray, windows: np.ndarray, radius: float, own: slice, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Places and distances of the ``k`` nearest found, but for those in ``own``."""
        n, params = len(self.x), self.params
        if not np.isfinite(radius):
            places = np.delete(np.arange(n), own)
            return self._top(q, places, distances_to(self.x[places], q), k)
        counts = np.zeros(n, np.int64)
        counts[own] = -params.projections - 1  # never enough
        places, distances = np.empty(0, np.int64), np.empty(0)
        done, before = np.zeros(n, bool), None
        for share, (lo, hi) in zip(params.steps, windows, strict=True):
            if before is None:
                slices = zip(lo.tolist(), hi.tolist(), strict=True)
            else:  # what the wider windows add on both sides
                slices = zip([*lo.tolist(), *before[1].tolist()], [*before[0].tolist(), *hi.tolist()], strict=True)
            before = lo, hi
            counts += np.bincount(np.concatenate([self.order[a:b] for a, b in slices]), minlength=n)
            new = np.flatnonzero((counts >= params.least) & ~done)
            if len(new):
                done[new] = True
                self.verified += len(new)
                places, distances = self._top(q, np.concatenate((places, new)), np.concatenate((distances, distances_to(self.x[new], q))), k)
            if len(places) == k and distances[-1] <= share * radius:
                break
        return places, distances

    def _top(self, q: np.ndarray, places: np.ndarray, distances: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        top = best_by_distance(distances, self.ids[places], k)
        return places[top], distances[top]


def expected_radius(distances: np.ndarray, rows: int, k: int) -> float:
    """Distance of the k-th of ``rows`` neighbours, by those of a sample, ascending.

    The number of neighbours grows with a power of the distance, taken from the sample's k-th
    and tenfold-k-th distance. Infinite if the sample has no k neighbours.
    """
    n = len(distances)
    if n < k:
        return math.inf
    far = min(n, 10 * k) - 1
    near_d, far_d = distances[k - 1], distances[far]
    if rows <= n or far == k - 1 or not 0 < near_d < far_d:
        return float(near_d)
    power = math.log((far + 1) / k) / math.log(far_d / near_d)
    return float(near_d * (n / rows) ** (1 / power))


def _radii(sample: DataFrame, counts: dict[int, int], k: int):
    """Adds ``radius`` to queries; ``counts``: number of rows of each length."""
    held: dict[int, tuple[np.ndarray, np.ndarray]] = {}
    for r in sample.collect():
        held.setdefault(len(r["v"]), ([], []))
        held[len(r["v"])][0].append(r["id"])
        held[len(r["v"])][1].append(r["v"])
    shared = sample.sparkSession.sparkContext.broadcast({d: (np.array(i), np.array(v)) for d, (i, v) in held.items()})

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for own, v in zip(batch.column("id").to_pylist(), batch.column("v").to_pylist(), strict=True):
                ids, x = shared.value.get(len(v), (np.empty(0, np.int64), np.empty((0, len(v)))))
                found = np.sort(distances_to(x[ids != own], np.array(v)))
                out.append(expected_radius(found, counts.get(len(v), 0) - 1, k))
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("v"), pa.array(out, pa.float64())], names=["id", "v", "radius"])

    return add


#: Rounds after which a query that is still open is compared with all vectors.
ROUNDS = 4


def nearest_neighbours(vectors: DataFrame, is_query: Column, k: int = 10, vec_id: str = "vec_id", embedding: str = "embedding", params: Params = Params(), blocks: Blocks = Blocks()) -> DataFrame:
    """The ``k`` nearest vectors found for each query; ``is_query`` is over the column ``id``."""

    def task(q_ids: np.ndarray, q: np.ndarray, radii: np.ndarray, ids: np.ndarray, x: np.ndarray):
        index = Index(x, ids, params)
        at, found, scores = [], [], []
        for lo in range(0, len(q), 256):
            windows = index.windows(q[lo : lo + 256], radii[lo : lo + 256])
            for i, w in enumerate(windows, lo):
                places, distances = index.nearest(q[i], w, radii[i], slice(np.searchsorted(ids, q_ids[i], "left"), np.searchsorted(ids, q_ids[i], "right")), k)
                at.append(np.full(len(places), i))
                found.append(ids[places])
                scores.append(distances)
        return np.concatenate(at), np.concatenate(found), np.concatenate(scores)

    rows = usable(vectors, vec_id, embedding, zero=False)
    counts = {r["dim"]: r["n"] for r in rows.groupBy(F.size("v").alias("dim")).agg(F.count("*").alias("n")).orderBy(F.desc("n")).limit(1000).collect()}
    sample = rows.orderBy(F.xxhash64("id"), "id").limit(params.sample)
    asked = checkpointed(queries_of(rows, is_query).mapInArrow(_radii(sample, counts, k), "id long, v array<double>, radius double"))
    done, rounds = None, 0
    while True:
        rounds += 1
        found = checkpointed(search(rows, asked, task, "double", k, True, blocks))
        reached = found.groupBy(F.col("query_id").alias("id")).agg(F.count("*").alias("n"), F.max("score").alias("score"))
        state = asked.join(reached, "id", "left").withColumn("n", F.coalesce("n", F.lit(0)))
        wider = F.when(F.lit(rounds >= ROUNDS) | (F.col("radius") == 0), math.inf).when(F.col("n") == k, F.col("score")).otherwise(2 * F.col("radius"))
        is_open = (F.col("radius") < math.inf) & ((F.col("n") < k) | (F.col("score") > F.col("radius")))
        again = checkpointed(state.where(is_open).select("id", "v", wider.alias("radius")))
        if again.isEmpty():
            return found if done is None else done.unionByName(found)
        closed = found.join(again.select(F.col("id").alias("query_id")), "query_id", "left_anti")
        done = closed if done is None else done.unionByName(closed)
        asked = again
