"""Graph algorithms against plain Python on random graphs, and hand-made cases of the passes."""

import datetime
import random
from collections import deque

import pytest
from pyspark.sql import functions as F

from graphloom.functions import frontmatter, text
from graphloom.operators import algorithms, brandes, documents, extraction, passes, summaries, tools, traverse, upsert
from graphloom.operators.leiden import Params, leiden
from graphloom.streaming import jobs


def graph(spark, seed, n=40, m=70):
    rng = random.Random(seed)
    pairs = sorted({(rng.randrange(n), rng.randrange(n)) for _ in range(m)})
    return spark.createDataFrame([(i,) for i in range(n)], "node long"), spark.createDataFrame(pairs, "src long, dst long"), n, pairs


def bfs(n, pairs, sources):
    depth, queue = {s: 0 for s in sources}, deque(sources)
    while queue:
        v = queue.popleft()
        for a, b in pairs:
            if a == v and b not in depth:
                depth[b] = depth[v] + 1
                queue.append(b)
    return depth


@pytest.mark.parametrize("seed", [1, 2])
def test_depths(spark, seed):
    _, edges, n, pairs = graph(spark, seed)
    got = traverse.depths(edges, spark.createDataFrame([(0,), (5,)], "node long")).collect()
    assert {r["node"]: r["depth"] for r in got} == bfs(n, pairs, [0, 5])


def test_neighbours_may_return_to_their_origin(spark):
    edges = spark.createDataFrame([(1, 2), (2, 1), (2, 3)], "src long, dst long")
    got = traverse.neighbours(edges, spark.createDataFrame([(1,)], "origin long"), 2).collect()
    assert {(r["node"], r["depth"]) for r in got} == {(2, 1), (1, 2), (3, 2)}


def test_pagerank(spark):
    nodes, edges, n, pairs = graph(spark, 3)
    rank = dict.fromkeys(range(n), 0.15)
    out = {v: sum(a == v for a, _ in pairs) for v in range(n)}
    for _ in range(20):
        rank = {v: 0.15 + 0.85 * sum(rank[a] / out[a] for a, b in pairs if b == v) for v in range(n)}
    got = {r["node"]: r["pageRank"] for r in algorithms.pagerank(nodes, edges).collect()}
    assert got == pytest.approx(rank)


def test_betweenness(spark):
    nodes, edges, n, pairs = graph(spark, 4, 20, 40)
    pairs = [p for p in pairs if p[0] != p[1]]
    dist = {s: bfs(n, pairs, [s]) for s in range(n)}

    def paths(s):
        count = {s: 1}
        for v in sorted(dist[s], key=dist[s].get):
            if v != s:
                count[v] = sum(count[a] for a, b in pairs if b == v and a in dist[s] and dist[s][a] + 1 == dist[s][v])
        return count

    sigma = {s: paths(s) for s in range(n)}
    want = {v: sum(sigma[s][v] * sigma[v][t] / sigma[s][t] for s in range(n) for t in dist[s] if len({s, v, t}) == 3 and v in dist[s] and t in dist[v] and dist[s][v] + dist[v][t] == dist[s][t]) for v in range(n)}
    got = {r["node"]: r["betweenness"] for r in algorithms.betweenness(nodes, edges.where("src <> dst")).collect()}
    assert got == pytest.approx(want)


def test_betweenness_in_steps_and_after_most_sources_are_done(spark, monkeypatch):
    """A hub and a long path, rows expanded a few at a time: most sources end early, one goes on."""
    monkeypatch.setattr(brandes, "HELD", 6)
    pairs = [(0, i) for i in range(1, 9)] + [(i, 9) for i in range(1, 9)] + [(20 + i, 21 + i) for i in range(5)]
    nodes = spark.createDataFrame([(f"n{i}",) for i in (*range(10), *range(20, 26), 30)], "node string")
    edges = spark.createDataFrame([(f"n{a}", f"n{b}") for a, b in pairs], "src string, dst string")
    got = {r["node"]: r["betweenness"] for r in algorithms.betweenness(nodes, edges).collect()}
    want = {**{f"n{i}": 0.125 for i in range(1, 9)}, "n21": 4.0, "n22": 6.0, "n23": 6.0, "n24": 4.0}
    assert got == pytest.approx({n: want.get(n, 0.0) for n in got}) and len(got) == 17


def test_components(spark):
    nodes, edges, n, pairs = graph(spark, 5, 60, 45)
    both = pairs + [(b, a) for a, b in pairs]
    want = {v: min(bfs(n, both, [v])) for v in range(n)}
    assert {r["node"]: r["component"] for r in algorithms.components(nodes, edges).collect()} == want


def quality(of, pairs):
    """Modularity of an undirected multigraph, by its definition."""
    m, inside, degree = len(pairs), 0, {}
    for a, b in pairs:
        inside += of[a] == of[b]
        for v in (a, b):
            degree[of[v]] = degree.get(of[v], 0) + 1
    return inside / m - sum((k / (2 * m)) ** 2 for k in degree.values())


def test_communities_of_two_cliques(spark):
    pairs = [(a, b) for c in (range(5), range(5, 10)) for a in c for b in c if a < b] + [(4, 5)]
    nodes = spark.createDataFrame([(i,) for i in range(11)], "node long")
    got = {r["node"]: r["community"] for r in leiden(nodes, spark.createDataFrame(pairs, "src long, dst long")).collect()}
    assert got == {**dict.fromkeys(range(5), 0), **dict.fromkeys(range(5, 10), 5), 10: 10}


def test_communities_are_as_good_as_planted_ones_and_connected(spark):
    rng = random.Random(7)
    group = {v: v // 15 for v in range(60)}
    pairs = [(a, b) for a in range(60) for b in range(60) if a != b and rng.random() < (0.3 if group[a] == group[b] else 0.015)]
    df = spark.createDataFrame(pairs, "src long, dst long")
    found = leiden(spark.createDataFrame([(i,) for i in range(60)], "node long"), df).cache()
    got = {r["node"]: r["community"] for r in found.collect()}
    assert set(got) == set(range(60)) and all(got[c] == c for c in got.values())
    assert quality(got, pairs) >= quality(group, pairs) - 0.02
    inside = [p for p in pairs + [(b, a) for a, b in pairs] if got[p[0]] == got[p[1]]]
    assert all(set(bfs(60, inside, [c])) == {v for v in got if got[v] == c} for c in set(got.values()))
    both = df.union(df.select("dst", "src")).groupBy("src", "dst").agg(F.count("*").cast("double").alias("w"))
    assert algorithms.modularity(both, found) == pytest.approx(quality(got, pairs))


def plain_louvain(n, pairs):
    """Moves one node at a time to the best neighbouring community, then condenses, until nothing gains."""
    m2 = 2 * len(pairs)
    w = {}
    for a, b in pairs:
        for u, v in ((a, b), (b, a)):
            w.setdefault(u, {}).setdefault(v, 0)
            w[u][v] += 1
    of = {v: v for v in range(n)}
    graph, top = w, {v: v for v in range(n)}
    while True:
        label = {v: v for v in graph}
        k = {v: sum(graph[v].values()) for v in graph}
        all_ = dict(k)
        moved, any_move = True, False
        while moved:
            moved = False
            for v in sorted(graph):
                to = {}
                for u, x in graph[v].items():
                    if u != v:
                        to[label[u]] = to.get(label[u], 0) + x
                all_[label[v]] -= k[v]
                best = max([label[v], *to], key=lambda c: (to.get(c, 0) - k[v] * all_[c] / m2, c == label[v]))
                moved |= best != label[v]
                label[v] = best
                all_[best] += k[v]
            any_move |= moved
        if len(set(label.values())) == len(graph):
            return of
        top = {v: label[top[v]] for v in top}
        of = dict(top)
        new = {}
        for u in graph:
            for v, x in graph[u].items():
                new.setdefault(label[u], {}).setdefault(label[v], 0)
                new[label[u]][label[v]] += x
        graph = new


def test_communities_are_as_good_as_those_of_moves_one_by_one(spark):
    rng = random.Random(2)
    pairs = [(a, b) for a in range(200) for b in range(a) if rng.random() < (0.25 if a // 20 == b // 20 else 0.01)]
    nodes, edges = spark.createDataFrame([(i,) for i in range(200)], "node long"), spark.createDataFrame(pairs, "src long, dst long")
    want = quality(plain_louvain(200, pairs), pairs)
    sent = {r["node"]: r["community"] for r in leiden(nodes, edges).collect()}
    assert quality(sent, pairs) >= 0.99 * want
    shuffled = {r["node"]: r["community"] for r in leiden(nodes, edges, Params(broadcast=0, lots=4)).collect()}
    assert quality(shuffled, pairs) >= 0.97 * want


def test_communities_of_no_edges_and_odd_rows(spark):
    nodes = spark.createDataFrame([("a",), ("b",), (None,), ("a",)], "node string")
    loops = spark.createDataFrame([("a", "a"), ("a", "gone"), (None, "b")], "src string, dst string")
    assert sorted(map(tuple, leiden(nodes, loops).collect())) == [("a", "a"), ("b", "b")]
    linked = spark.createDataFrame([("a", "b"), ("b", "a"), ("a", None)], "src string, dst string")
    assert sorted(map(tuple, leiden(nodes, linked).collect())) == [("a", "a"), ("b", "a")]
    assert leiden(nodes.limit(0), linked).count() == 0


def test_roles_with_null_community(spark):
    nodes = spark.createDataFrame([(1, 1), (2, 1), (3, None), (4, 2)], "node long, communityId int")
    edges = spark.createDataFrame([(1, 2), (1, 4), (1, 4), (3, 1)], "src long, dst long")
    got = {r["node"]: r["role"] for r in algorithms.roles(nodes, edges).collect()}
    assert got == {1: "bridge", 2: "core", 3: "core", 4: "core"}


def test_edge_delta_gate(spark):
    rows = spark.createDataFrame([(102, 100), (110, 100), (5, None)], "a int, b int")
    assert [r[0] for r in rows.select(algorithms.edge_delta(F.col("a"), F.col("b"))).collect()] == [False, True, True]


def test_empty_graph(spark):
    nodes, edges = spark.createDataFrame([], "node long"), spark.createDataFrame([], "src long, dst long")
    for found in (algorithms.degree(nodes, edges), algorithms.pagerank(nodes, edges), algorithms.components(nodes, edges), algorithms.betweenness(nodes, edges), traverse.depths(edges, nodes)):
        assert found.count() == 0


def test_upsert_is_idempotent(spark):
    old = spark.createDataFrame([("a", 1), ("b", 2)], "k string, v int")
    new = spark.createDataFrame([("b", 3), ("b", 4), ("c", 5)], "k string, v int")
    once = upsert.upsert(old, new, ["k"], order="v")
    twice = upsert.upsert(once, new, ["k"], order="v")
    assert {tuple(r) for r in once.collect()} == {tuple(r) for r in twice.collect()} == {("a", 1), ("b", 4), ("c", 5)}


@pytest.mark.parametrize("name, slug", [("Rate Limiter, v2!", "rate-limiter-v2"), ("Orders", "order"), ("class", "class"), ("Naïve Bayes", "naive-baye"), (None, None)])
def test_slugify(spark, name, slug):
    df = spark.createDataFrame([(name,)], "n string")
    assert df.select(text.slugify(F.col("n"))).first()[0] == slug


def test_cosine_and_codec(spark):
    df = spark.createDataFrame([([1.0, 0.0], [1.0, 0.0]), ([1.0, 0.0], [0.0, 1.0]), ([1.0], [1.0, 2.0]), ([0.0, 0.0], [1.0, 1.0])], "a array<float>, b array<float>")
    assert [r[0] for r in df.select(text.cosine(F.col("a"), F.col("b"))).collect()] == [1.0, 0.0, 0.0, 0.0]
    assert df.select(text.floats_from_base64(text.floats_to_base64(F.col("b")))).first()[0] == [1.0, 0.0]


def test_paths_names_and_versions(spark):
    df = spark.createDataFrame([("src/app.js", "../shared/utils.js", "@scope/pkg/deep", "r:a/b.js#x", "5.11.0-rc1")], "f string, s string, p string, i string, v string")
    row = df.select(text.joined_path("f", "s"), text.package_name(F.col("p")), text.fqn_part(F.col("i"), "filePath"), text.semver(F.col("v"))).first()
    assert tuple(row) == ("shared/utils.js", "@scope/pkg", "a/b.js", [5, 11, 0])


def test_markdown(spark):
    body = "# Title\n<!-- gone -->\n**bold** and _it_ and `code`\n\n```js\nlet x\n```\n\n\n\n[link](http://a) ![alt](b.png)\n- item\n> quote"
    got = spark.createDataFrame([(body,)], "b string").select(text.strip_markdown(F.col("b"))).first()[0]
    assert got == "Title\n\nbold and it and code\n\nlink alt\nitem\nquote"


def test_frontmatter(spark):
    good = "---\ntitle: T\ntype: adr\nstatus: current\nauthor: a\ncreated: 2024-01-01\nupdated: 2024-02-01\nsymbols:\n  - a\n  - b\n---\nbody"
    bad = "---\ntitle: T\ntype: nope\nstatus: x\ncreated: later\n---\n"
    rows = frontmatter.parse(spark.createDataFrame([(good,), (bad,), ("none",)], "body string")).collect()
    assert rows[0]["valid"] and rows[0]["content"] == "body"
    assert not rows[1]["valid"] and rows[1]["title"] == "T" and {"missing author", "bad type nope", "bad status x", "bad date created"} <= set(rows[1]["errors"])
    assert not rows[2]["valid"]
    items = spark.createDataFrame([(good,)], "b string").select(frontmatter.list_field(F.col("b"), "symbols")).first()[0]
    assert items == ["a", "b"]


def test_references(spark):
    body = "Uses `processPayment`, `promise` and `abc`.\n[x](graph://symbol/r/src/a.js#Foo) [x](graph://symbol/r/src/a.js#Foo)\n```js\nimport { a } from './lib/b.js'\nconst c = require('../c')\nimport d from 'pkg'\n```\n"
    df = spark.createDataFrame([("d.md", "r", body)], "path string, service string, body string")
    got = sorted(tuple(r) for r in documents.references(df).select("channel", "name").collect())
    assert got == [("fenced", "b"), ("fenced", "c"), ("inline", "processPayment"), ("link", "Foo"), ("link", "Foo")]


def test_sections_chunks_and_templates(spark):
    df = spark.createDataFrame([("p", "# A\ntext\n## B\nmore\n### C\nx")], "path string, body string")
    assert [r["text"] for r in documents.chunks(df).orderBy("chunk").collect()] == ["# A\ntext\n", "## B\nmore\n### C\nx"]
    once = df.select(documents.with_section(F.col("body"), F.lit("s")).alias("b"))
    assert once.select(documents.with_section(F.col("b"), F.lit("s"))).first()[0] == once.first()[0]
    assert df.select(documents.fill_template(F.lit("{{a}} {{b}} {{a}}"), {"a": F.lit("x")})).first()[0] == "x {{b}} x"


def test_effects_and_catches(spark):
    df = spark.createDataFrame([("fs.readFile",), ("setTimeout",), ("add",), ("fetch",)], "c string")
    assert [r[0] for r in df.select(extraction.effect(F.col("c"))).collect()] == ["file-read", "timer", None, "network-call"]


def test_volatility(spark):
    rows = [("r", "f", datetime.datetime(2024, 1, 30), "A@x"), ("r", "f", datetime.datetime(2024, 1, 1), "a@x"), ("r", "f", datetime.datetime(2020, 1, 1), "b@x")]
    df = spark.createDataFrame(rows, "repo string, filePath string, ts timestamp, email string")
    row = passes.git_volatility(df, F.lit("2024-01-31").cast("timestamp")).first()
    assert (row["changeFrequency"], row["authorCount"], row["gitAge"]) == (0.667, 1, 1491)


def test_summaries(spark):
    m = spark.createDataFrame([("r", 1, 1.0, 0, False, 0.0, None)], "repo string, communityId int, pageRank double, fanIn long, isPublicApi boolean, changeFrequency double, tier string")
    none = spark.createDataFrame([], "repo string, communityId int")
    assert summaries.pending_communities(m, none).first()["score"] == pytest.approx(0.4)


def test_vector_search(spark):
    v = spark.createDataFrame([(i, [1.0, float(i)]) for i in range(30)], "vec_id long, embedding array<float>")
    got = tools.vector_top_k([1.0, 0.0], v, k=0)
    assert [r["vec_id"] for r in got.collect()] == [0, 1, 2, 3, 4]
    assert tools.vector_top_k([1.0, 0.0], v, k=99).count() == 20


def test_streams(spark, tmp_path):
    rows = [(i, i % 3, datetime.datetime(2024, 1, 1, 0, 0, i % 7)) for i in range(30)]
    df = spark.createDataFrame(rows, "event_id long, key long, ts timestamp")
    df.repartition(2).write.parquet(str(tmp_path / "in"))
    stream = jobs.watch(spark, str(tmp_path / "in"), df.schema)
    batch = jobs.rate_limited(df.withColumnRenamed("key", "user"), "user", "ts", 4, 100)
    assert batch.where("allowed").count() == 12
    limited = jobs.rate_limit_stream(stream, 4, 100)
    assert jobs.once(limited, str(tmp_path / "c1"), mode="append").where("allowed").count() == 12
    jobs.upserts(stream, ["key"], str(tmp_path / "t"), str(tmp_path / "c2"), "event_id").awaitTermination()
    assert {(r["key"], r["event_id"]) for r in jobs.current(spark, str(tmp_path / "t")).collect()} == {(0, 27), (1, 28), (2, 29)}


def test_contexts_of_paths_with_thousands_of_patterns(spark):
    rng = random.Random(6)
    folder = lambda depth: "/".join(rng.choice(["src", "lib", "a", "b", "", "x.js"]) for _ in range(depth))
    paths = [folder(rng.randint(1, 5)) for _ in range(300)] + ["src", "src/", "", "/", "a//b", "srcx/a"]
    patterns = [folder(rng.randint(1, 4)) + rng.choice(["", "/"]) for _ in range(400)] + ["src/", "src", ""] + [f"none-{i}/" for i in range(5000)]
    contexts = [(f"c{i % 90}", p, i // 2) for i, p in enumerate(patterns)]
    fits = lambda path, p: path.startswith(p) if p.endswith("/") else path == p or path.startswith(p + "/")
    rows = spark.createDataFrame([(i, p) for i, p in enumerate(paths)] + [(-1, None)], "id int, path string")
    got = {r["id"]: (r["contextId"], r["ambiguous"]) for r in passes.bounded_context(rows, spark.createDataFrame(contexts, "contextId string, pattern string, declarationOrder int")).collect()}
    for i, path in enumerate(paths):
        hits = [(o, c) for c, p, o in contexts if fits(path, p)]
        assert got[i] == (min(hits)[1] if hits else None, len({c for _, c in hits}) > 1), path
    assert got[-1] == (None, False) and len(got) == len(paths) + 1
