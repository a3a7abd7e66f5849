"""Vector searches against plain searches over all rows."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from graphloom.llm import ann, topk
from graphloom.llm.queries import QUERIES
from graphloom.llm.vectors import Blocks

SCHEMA = "vec_id long, embedding array<float>, rank int"


def table(spark, sf):
    rows = spark.read.parquet(f"/root/testdata/{sf}/embeddings.parquet").select("vec_id", "embedding").collect()
    return [(r["vec_id"], r["embedding"]) for r in rows]


def brute_products(rows, every, k):
    rows = [(i, [int(np.floor(256 * float(x))) for x in v]) for i, v in rows if v is not None and all(x is not None and np.isfinite(x) for x in v)]
    out = set()
    for q, a in rows:
        if q % every == 0:
            scores = sorted((-sum(x * y for x, y in zip(a, b, strict=True)), i) for i, b in rows if i != q and len(a) == len(b))
            out |= {(q, n, i, -s) for n, (s, i) in enumerate(scores[:k], 1)}
    return out


def brute_distances(rows, every, k):
    rows = [(i, np.array(v, np.float64)) for i, v in rows if v is not None and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    out = {}
    for q, a in rows:
        if q % every == 0:
            out[q] = sorted((float(np.sqrt(((a - b) ** 2).sum())), i) for i, b in rows if i != q and len(a) == len(b))[:k]
    return out


def as_set(df):
    return {(r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in df.collect()}


def test_products_of_the_table(spark):
    got = QUERIES["op10_exact_top_k"](spark, "/root/testdata/sf0.001")
    assert as_set(got) == brute_products(table(spark, "sf0.001"), 50, 5)


def test_products_over_many_blocks(spark):
    rng = np.random.default_rng(1)
    rows = [(i, [float(x) for x in rng.integers(-3, 4, 6)], 1) for i in range(500)]  # many ties
    got = topk.inner_product_search(spark.createDataFrame(rows, SCHEMA), F.col("id") % 50 == 0, blocks=Blocks(shard_rows=40, block_rows=3, fan_in=2))
    assert as_set(got) == brute_products([r[:2] for r in rows], 50, 5)


@pytest.mark.parametrize("sf", ["sf0.01", "sf0.1"])
def test_recall_on_the_table(spark, sf):
    want = brute_distances(table(spark, sf), 100, 10)
    got = QUERIES["op4_nearest_neighbours"](spark, f"/root/testdata/{sf}").collect()
    by = {}
    for r in got:
        by.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    assert set(by) == set(want)
    hits = 0
    for q, best in want.items():
        found = sorted(by[q])
        assert [r[0] for r in found] == list(range(1, len(best) + 1))
        assert [(s, i) for _, i, s in found] == sorted((s, i) for _, i, s in found)
        hits += len({i for _, i, _ in found} & {i for _, i in best})
    assert hits >= 0.9 * sum(map(len, want.values()))


def test_few_vectors_are_verified(spark):
    rows = [(i, v) for i, v in table(spark, "sf0.1") if v is not None and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    ids, x = np.array([i for i, _ in rows]), np.array([v for _, v in rows])
    index, k = ann.Index(x, ids, ann.Params()), 10
    at, hits, missed_rows = range(0, len(x), 40), 0, len(x) // 4
    for i in at:
        distances = np.sort(ann.distances_to(np.delete(x, i, 0), x[i]))
        # the radius as a quarter of the rows tells it
        radius = ann.expected_radius(np.sort(ann.distances_to(x[[j for j in range(missed_rows) if j != i]], x[i])), len(x) - 1, k)
        assert abs(radius / distances[k - 1] - 1) < 0.15
        _, found = index.nearest(x[i], index.windows(x[i : i + 1], np.array([radius]))[0], radius, slice(i, i + 1), k)
        hits += np.isin(found, distances[:k]).sum()
    assert hits >= 0.9 * k * len(at)
    assert index.verified < 0.3 * len(at) * len(x)


def test_clusters_of_many_sizes_over_shards(spark):
    rng = np.random.default_rng(5)
    centres = rng.standard_normal((30, 16)) * rng.gamma(1, 5, (30, 1))
    x = np.concatenate([c + s * rng.standard_normal((n, 16)) for c, s, n in zip(centres, rng.gamma(1, 1, 30), rng.integers(1, 150, 30), strict=True)])
    rows = [(int(i), [float(np.float32(y)) for y in v], 0) for i, v in enumerate(x)]
    want = brute_distances([r[:2] for r in rows], 100, 10)
    got = ann.nearest_neighbours(spark.createDataFrame(rows, SCHEMA), F.col("id") % 100 == 0, params=ann.Params(sample=200), blocks=Blocks(shard_rows=400, block_rows=7, fan_in=2)).collect()
    found = {(r["query_id"], r["vec_id"]) for r in got}
    assert len(got) == sum(map(len, want.values())) == len({(r["query_id"], r["rank"]) for r in got})
    assert len(found & {(q, i) for q, best in want.items() for _, i in best}) >= 0.9 * len(found)


def test_products_beyond_any_range(spark):
    rows = [(0, [1e308, -1e308], 0), (1, [1e308, 1.0], 0), (2, [-1e308, 1.0], 0), (50, [1.0, 1.0], 0)]
    got = {(r["query_id"], r["vec_id"]): r["score"] for r in topk.inner_product_search(spark.createDataFrame(rows, "vec_id long, embedding array<double>, rank int"), F.col("id") % 50 == 0).collect()}
    assert got[0, 1] == 2**63 - 1 and got[0, 2] == -(2**63) and got[50, 1] == 2**63 - 1


@pytest.mark.parametrize("blocks", [Blocks(), Blocks(shard_rows=3, block_rows=1, fan_in=2)])
def test_vectors_that_take_no_part(spark, blocks):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0]), (1, [0.5, 0.5]), (2, None), (3, [0.0, 0.0]), (4, [nan, 1.0]), (5, [1.0, inf]), (6, [None, 1.0]), (None, [1.0, 1.0]), (7, [0.5, 0.5]), (100, [2.0, 2.0]), (8, [])]
    df = spark.createDataFrame([(*r, 3) for r in rows], SCHEMA)
    real = [r for r in rows if r[0] is not None and r[0] != 8]
    got = topk.inner_product_search(df.where("size(embedding) > 0 OR embedding IS NULL"), F.col("id") % 50 == 0, blocks=blocks)
    assert as_set(got) == brute_products(real, 50, 5)
    near = {(r["query_id"], r["rank"]): (r["score"], r["vec_id"]) for r in ann.nearest_neighbours(df, F.col("id") % 100 == 0, blocks=blocks).collect()}
    want = {(q, n): x for q, best in brute_distances(real, 100, 10).items() for n, x in enumerate(best, 1)}
    assert near == want  # a few candidates are all found
    assert ann.nearest_neighbours(df.where("false"), F.col("id") % 100 == 0).count() == 0


def test_repeated_vectors_do_not_stop_a_search(spark):
    rows = [(i, [1.0, 2.0, 3.0], 0) for i in range(300)]
    got = as_set(ann.nearest_neighbours(spark.createDataFrame(rows, SCHEMA), F.col("id") % 100 == 0, k=3))
    assert got == {(q, n, i, 0.0) for q in (0, 100, 200) for n, i in enumerate([i for i in range(4) if i != q][:3], 1)}
