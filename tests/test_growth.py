"""Steps that must not send or compare more than their input."""

import random
import re
import tracemalloc

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from graphloom import checkpoints
from graphloom.fixtures import Graph
from graphloom.operators import algorithms, brandes, cells, doc_writes, documents, extraction, leiden, near_names, parsing, search_index, shares, summaries
from graphloom.plans import catalogue_text

SF = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_service_calls_send_no_side_to_the_driver(spark):
    one = lambda **values: spark.range(1).select(*[F.concat(F.lit(v), F.col("id").cast("string")).alias(c) for c, v in values.items()])  # noqa: E731  a plan of known size
    names = one(repo="r", filePath="f", symbol="s", name="n")
    bound = one(repo="r", filePath="f", service="sv", protocol="http", name="n")
    found = parsing.service_calls(names, bound)
    assert "Broadcast" not in plan(found)
    assert [tuple(r) for r in found.collect()] == [("s0", "sv0", "http0")]


def test_symbols_are_shuffled_in_views(spark):
    g = Graph(spark, SF)
    for view in (g.calls, g.sym_summaries, g.governs):
        assert "BroadcastHashJoin" not in plan(view)


def test_innermost_symbol_by_cells(spark):
    rng = random.Random(5)
    spans = [("r", f"f{i % 2}", f"id{i}", a, a + rng.choice([0, 0, 1, 3, 8, 60, 700])) for i in range(300) for a in [rng.randrange(1, 900)]]
    lines = [("r", f"f{i % 2}", i) for i in range(1, 1000)]
    got = extraction.innermost(spark.createDataFrame(lines, "repo string, filePath string, line int"), spark.createDataFrame(spans, "repo string, filePath string, id string, lineStart int, lineEnd int"))
    assert "cell" in plan(got)
    want = {}
    for _, file, line in lines:
        around = [(e - s, -s, i) for _, f, i, s, e in spans if f == file and s <= line <= e]
        if around:
            want[file, line] = min(around)[2]
    assert {(r["filePath"], r["line"]): r["src"] for r in got.collect()} == want


def test_members_and_their_summaries_are_shuffled(spark):
    g = Graph(spark, SF)
    assert len(re.findall("BroadcastHashJoin", plan(catalogue_text.members(g)))) <= 1  # modules
    rows = catalogue_text.members(g).withColumns({"role": F.lit("core"), "prompt": F.col("id")})
    assert len(re.findall("BroadcastHashJoin", plan(summaries.run(rows, lambda prompt, tier: "{}")))) <= 2  # modules, on both sides


def test_names_of_a_similarity_join_are_shuffled(spark):
    names = spark.range(2).select(F.when(F.col("id") == 0, "Large_ring_1").otherwise("Hot_bolt_2").alias("name"))
    found = documents.similar_names(names, names, 0.6)
    assert len(re.findall("BroadcastHashJoin", plan(found))) <= 2  # counts of bigrams, on both sides
    assert {(r["name"], r["symbol"]) for r in found.collect()} == {("Large_ring_1", "Large_ring_1"), ("Hot_bolt_2", "Hot_bolt_2")}


def test_searched_documents_are_dealt_by_their_number(spark, monkeypatch):
    """A task scores its own documents: no word's postings and no query's documents meet in one task."""
    monkeypatch.setattr(search_index, "DEALT", 10)
    docs = spark.range(70).select(F.concat(F.lit("p"), F.col("id").cast("string")).alias("path"), F.concat(F.lit("every word of "), F.col("id").cast("string")).alias("text"))
    postings, lengths = search_index.indexed(docs)
    found = search_index.search(postings, lengths, spark.createDataFrame([("a", "every 7"), ("b", "word")], "query string, text string"), k=3)
    text = plan(found)
    assert re.search(r"hashpartitioning\(path#\d+, 7\)", text) and not re.search(r"hashpartitioning\(query#\d+, path#\d+", text)
    assert [tuple(r)[:2] for r in found.orderBy("query", F.desc("score"), "path").collect()] == [("a", "p7"), ("a", "p0"), ("a", "p1"), ("b", "p0"), ("b", "p1"), ("b", "p10")]


def test_components_merge_edges_and_follow_long_paths(spark):
    """A path in falling and rising order, a clique, loops, repeated edges, ends that are no nodes, and a node alone."""
    pairs = [(f"p{i:03}", f"p{i + 1:03}") for i in range(60)] + [(f"q{i * 37 % 101:03}", f"q{(i + 1) * 37 % 101:03}") for i in range(100)]
    pairs += [(f"c{a}", f"c{b}") for a in range(5) for b in range(5)] + [("c0", "gone"), ("gone", "p000"), (None, "p000"), ("x", "x"), ("c1", "c2")]
    names = sorted({n for p in pairs for n in p if n not in (None, "gone")})
    nodes = spark.createDataFrame([(n,) for n in names], "node string")
    got = {r["node"]: r["component"] for r in algorithms.components(nodes, spark.createDataFrame(pairs, "src string, dst string")).collect()}
    assert got == {n: {"p": "p000", "q": "q000", "c": "c0", "x": "x"}[n[0]] for n in names}


def test_rounds_of_communities_shuffle_arrays(spark):
    """A round over edges is by cells, with no row for an edge and no side sent to all tasks by hand."""
    edges = spark.createDataFrame([(a, b) for a in range(30) for b in range(a)], "src long, dst long")
    _, graph = cells.numbered(spark.range(30).withColumnRenamed("id", "node"), edges)
    state = cells.degrees(graph).select("node", "k", F.lit(0.0).alias("loop"), F.col("node").alias("community"), F.lit(1).alias("turn"))
    assert cells.of_kind(graph, cells.EDGES).count() <= cells.LEAST
    moved = leiden._moved(graph, state, 870.0, leiden.Params())
    assert "FlatMapCoGroupsInArrow" in plan(moved) and "ResolvedHint" not in plan(moved)
    rows = moved.collect()
    assert len(rows) == 30 and all(r["inside"] == 0.0 and r["all"] == 29.0 for r in rows)
    assert len({r["community"] for r in rows}) < 30


def test_proposals_carry_no_texts_for_their_paths(spark):
    new = spark.createDataFrame([("a", "x"), ("b.md", "---\nstatus: done\n---\ny"), (None, "---\nstatus: done\n---\nz")], "name string, body string")
    none = new.select(F.col("name").alias("path"), F.lit("x").alias("status"), "body")
    got = doc_writes.proposed(none.where("false"), new)
    assert {(r["path"], r["status"]) for r in got.collect()} == {(".claude/proposals/a.md", "proposed"), (".claude/proposals/b.md", "proposed"), (None, "done")}
    named = plan(doc_writes.proposed(none.where("false"), new.where("name IS NOT NULL")).select("path", "status").where("path IS NOT NULL"))
    assert re.search(r"HashAggregate\(keys=\[path#\d+\], functions=\[\]", named) and "Join" not in named


def test_rounds_of_ranks_shuffle_arrays_and_edges_once(spark, monkeypatch):
    """Many small cells; nodes that are null or stand twice, edges that occur twice, return or go to no node."""
    plans = []

    def cut(df):
        found = algorithms.cut(df)
        plans.append(plan(df))
        return found

    monkeypatch.setattr(shares, "HELD", 20)
    monkeypatch.setattr(shares, "cut", cut)
    rng = random.Random(8)
    pairs = [(f"n{rng.randrange(60)}", f"n{rng.randrange(60)}") for _ in range(300)] + [("n1", "n1"), ("n1", "n2"), ("n1", "n2"), ("n3", "gone"), ("gone", "n4"), (None, "n5"), ("n6", None)]
    names = [f"n{i}" for i in range(70)] + ["n2", None]
    got = algorithms.pagerank(spark.createDataFrame([(n,) for n in names], "node string"), spark.createDataFrame(pairs, "src string, dst string"), rounds=5).collect()
    out = {n: sum(a == n for a, _ in pairs) for n in names}
    rank = dict.fromkeys(names, 0.15)
    for _ in range(5):
        rank = {n: 0.15 + 0.85 * sum(rank[a] / out[a] * names.count(a) for a, b in pairs if n is not None and b == n and a in rank and a is not None) for n in rank}
    assert sorted((r["node"] or "", round(r["pageRank"], 9)) for r in got) == sorted((n or "", round(rank[n], 9)) for n in names)
    # a round joins no edges: what was sent meets the edges of a cell, which are shuffled once and read again
    assert "src#" not in plans[0] and len(re.findall("FlatMapCoGroupsInArrow", plans[0])) >= 5 and "ReusedExchange" in plans[0]


def test_ranks_of_no_rounds(spark):
    nodes, edges = spark.createDataFrame([(1,), (2,)], "node long"), spark.createDataFrame([(1, 2)], "src long, dst long")
    assert [r["pageRank"] for r in algorithms.pagerank(nodes, edges, rounds=0, damping=0.5).collect()] == [0.5, 0.5]


def test_a_cell_of_paths_takes_little_memory():
    """One step of a cell of the greatest size that cells have on average: its edges times the sources that come to each node."""
    nodes, sources, each = 400, 500, brandes.HELD // (400 * 500)
    node = np.repeat(np.arange(nodes), each)
    edges = brandes._row(0, brandes.EDGES, node=node, other=np.arange(len(node)), other_cell=np.arange(len(node)) % 50)
    came = brandes._row(0, brandes.SENT, s=np.tile(np.arange(sources), nodes), node=np.repeat(np.arange(nodes), sources), value=np.ones(nodes * sources))
    table = pa.Table.from_pylist([edges, came], brandes.SCHEMA)
    tracemalloc.start()
    out = brandes._forward(table)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    sent = out.filter(pa.array(out.column("kind").to_numpy() == brandes.SENT))
    assert len(brandes._flat(sent, brandes.SENT, "s", np.int64)) == len(node) * sources
    assert peak < 100e6, peak


def test_nearest_names_are_found_without_all_that_are_alike(spark, monkeypatch):
    """Names of the same words are alike by the square of their number."""
    seen = []

    def alike(*args):
        seen.append(checkpoints.cut(found(*args)))
        return seen[-1]

    found = near_names._alike
    monkeypatch.setattr(near_names, "WORK", 0)
    monkeypatch.setattr(near_names, "_alike", alike)
    known = spark.range(3000).select(F.lit("r").alias("repo"), F.concat(F.lit("Large_ring_"), F.col("id") + 10000).alias("name"), F.col("id").cast("string").alias("id"))
    asked = known.select("repo", F.concat(F.lit("Larxe_ring_"), F.substring("name", 12, 5)).alias("name"), "id")
    got = documents.fuzzy(asked.select(F.col("repo").alias("service"), "name"), known)
    digits = lambda n: frozenset(n[i : i + 2] for i in range(9, len(n) - 1))
    least = {}
    for r in sorted(known.collect(), key=lambda r: r["id"]):
        least.setdefault(digits(r["name"]), r["id"])
    assert got.count() == 3000 and all(r["id"] == least[digits(r["name"])] for r in got.collect())
    assert sum(s.count() for s in seen) < 20 * 3000  # 4,500,000 pairs are alike by 0.6


def test_references_are_read_in_one_pass(spark):
    docs = spark.createDataFrame([("a.md", "s", "---\nsymbols:\n  - r:f.js#n\n  - 'm'\n---\n`Name` [x](graph://symbol/r/f.js#n)\n```\nimport './lib/b.js'\n```\n"), (None, None, None)], "path string, service string, body string")
    found = documents.references(docs)
    text = plan(found)
    assert len(re.findall("Generate", text)) == 1 and "Join" not in text and "Exchange" not in text
    want = {("inline", None, None, "Name"), ("fenced", None, "./lib/b.js", "b"), ("link", "r", "f.js", "n"), ("frontmatter", "r", "f.js", "n"), ("frontmatter", None, None, "m")}
    assert {tuple(r)[2:] for r in found.collect()} == want


def test_trees_of_components_stay_in_all_cells(spark, monkeypatch):
    """By the order of ids nearly all edges of the second round came to the first cells."""
    rng = random.Random(4)
    pairs = [(rng.randrange(4000), rng.randrange(4000)) for _ in range(24_000)]
    edges, kept = spark.createDataFrame(pairs, "src long, dst long"), []

    def merged(graph, state):
        kept.append(cells.merged(graph, state))
        return kept[-1]

    monkeypatch.setattr(cells, "HELD", 2400)  # 20 cells
    monkeypatch.setattr(algorithms, "merged", merged)
    got = algorithms.components(spark.range(4000).withColumnRenamed("id", "node"), edges).collect()
    assert len(got) == 4000 and all(r["component"] <= r["node"] for r in got)
    held = [len(r["at"]) // 4 for r in cells.of_kind(kept[0], cells.EDGES).select("at").collect()]
    assert len(held) >= 18 and max(held) < 0.3 * sum(held)
