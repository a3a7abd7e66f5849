import random
import time
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from graphloom.bundle import GraphBundle
from graphloom.operators import passes, rolling
from graphloom.plans import engine, enrichment, runs
from graphloom.plans.runner import Pass, run
from graphloom.plans.vector_tables import Change, Model, VectorTables
from graphloom.sources import config
from graphloom.streaming import jobs


def rows(df, *cols):
    return {tuple(r) for r in df.select(*cols).collect()}


def test_models_of_vectors(spark, tmp_path):
    t = VectorTables(spark, str(tmp_path / "v"))
    df = lambda x: spark.createDataFrame(x, "id string, embedding array<double>")
    assert t.model() is None and t.rows("s") is None and t.nearest("s", [1.0], "id").count() == 0
    for name, n in (("", 2), (None, 2), ("m", 0), ("m", -1), ("m", 1.5), ("m", True)):
        with pytest.raises(ValueError):
            t.use(name, n)
    with pytest.raises(ValueError):
        t.put("s", df([("a", [1.0, 0.0])]), "id")
    two = Model("m", 2)
    assert t.use("m", 2) == Change("installed", None, two) and t.use("m", 2) == Change("unchanged", two, two)
    t.put("s", df([("a", [1.0, 0.0]), ("b", [0.0, 1.0])]), "id")
    t.put("s", df([("b", [1.0, 1.0])]), "id")
    assert [r["id"] for r in t.nearest("s", [1.0, 1.0], "id").collect()] == ["b", "a"]
    assert t.nearest("s", [1.0, 1.0, 1.0], "id").count() == 0
    for wrong in ([1.0], None):
        with pytest.raises(ValueError):
            t.put("s", df([("c", wrong)]), "id")
    assert rows(t.states(["s", "none"]), "name", "state", "n") == {("s", "ONLINE", 2), ("none", "MISSING", 0)}
    assert t.use("m", 3) == Change("rotated", two, Model("m", 3)) and t.rows("s") is None
    assert t.use("other", 3).action == "rotated" and VectorTables(spark, str(tmp_path / "v")).model() == Model("other", 3)
    spark.createDataFrame([(None, 1)], "model string, dimensions int").withColumn("updatedAt", F.current_timestamp()).write.parquet(str(tmp_path / "v/meta/version=9"))
    assert t.model() is None and t.use("m", 2).action == "installed"


def test_runs(spark):
    g = GraphBundle(spark)
    r = runs.Runs(g)
    go = r.start("doc-graph", lambda i: time.sleep(1) or {"n": 3})
    assert r.status(go, "doc-graph").first()["status"] == "running"
    bad = r.start("doc-graph", lambda i: 1 / 0, wait=True)
    assert r.wait(go) == "completed" and r.status(go).first()["stats"] == '{"n": 3}'
    assert (r.status(bad).first()["status"], r.status(bad).first()["error"]) == ("failed", "division by zero")
    for wrong in ((go, "enrichment"), ("nothing", None)):
        with pytest.raises(KeyError):
            r.status(*wrong)
    slow = r.start("doc-graph", lambda i: {"n": spark.range(10**13).selectExpr("sum(id % 7)").collect()})
    time.sleep(1)
    r.cancel(slow)
    r.wait(slow, 20)
    assert r.status(slow).first()["status"] == "cancelled"
    refs = spark.createDataFrame([(go, "x"), (bad, "y"), (slow, "z")], "runId string, name string")
    assert rows(runs.latest(g["runs"], refs, "doc-graph"), "name") == {("x",)} and runs.latest(g["runs"], refs, "other").count() == 0
    g["runs"] = g["runs"].withColumn("status", F.when(F.col("runId") == go, "running").otherwise(F.col("status")))
    assert runs.Runs(g)._records[go]["status"] == "failed"


def test_reconciliation_in_the_background(spark):
    g = GraphBundle(spark)
    engine.call(g, "docs.create", path="a.md", body="See `NoSuchThing`.")
    row = engine.call(g, "admin.docGraphRun", wait=False).first()
    assert runs.of(g).wait(row["runId"]) == "completed"
    assert engine.call(g, "admin.docGraphStatus", runId=row["runId"]).first()["stats"] == '{"inline.unresolved": 1}'
    assert rows(engine.call(g, "admin.docGraphUnresolved"), "path", "name") == {("a.md", "NoSuchThing")}


def test_concepts_reach_the_graph(spark):
    words = lambda w: " ".join([w] * 120)

    def complete(text):
        if "fail" in text:
            raise RuntimeError("no model")
        name = {"pay": "Payments", "bill": "Billing"}.get(text.split()[0], "Payment")
        return '{"concepts": [{"name": "%s", "description": "d", "confidence": %s}, {"name": "--"}]}' % (name, "0.9" if "sure" in text else "0.4")

    embed = lambda text: [1.0, 0.01 * len(text)] if text[0] in "PB" else [0.0, 1.0]
    g = GraphBundle(spark)
    for path, text in (("a.md", words("pay")), ("b.md", words("bill")), ("c.md", words("fail")), ("concepts/x.md", words("pay"))):
        engine.call(g, "docs.create", path=path, body=text)
    got = enrichment.enrich(g, complete, embed)
    # billing is near to payment, which came first, and so is one with it
    assert got == {"docsScanned": 3, "candidatesExtracted": 2, "conceptsCreated": 1, "conceptsUpdated": 0, "errors": 1}
    assert rows(g["concepts"], "id", "name") == {("payment", "Payments")}
    assert rows(g["mentioned_in"], "concept", "doc", "confidence") == {("payment", "a.md", 0.4), ("payment", "b.md", 0.4)}
    engine.call(g, "docs.update", path="a.md", body=words("pay sure"))
    row = engine.call(g, "admin.enrichmentRun", complete=complete, embed=embed, prefix="a").first()
    assert runs.of(g).wait(row["runId"]) == "completed"
    assert '"conceptsCreated": 0, "conceptsUpdated": 1' in engine.call(g, "admin.enrichmentStatus", runId=row["runId"]).first()["stats"]
    assert rows(g["mentioned_in"], "doc", "confidence") == {("a.md", 0.9), ("b.md", 0.4)}
    assert engine.call(g, "concepts.list").first()["mentionCount"] == 2


def test_summaries_are_triggered(spark):
    g = GraphBundle(spark)
    base = {"repo": "r", "filePath": "a.js", "communityId": 1, "pageRank": 0.5, "hash": "h"}
    g.upsert("symbols", spark.createDataFrame([(*base.values(), n) for n in "xy"], ["repo", "filePath", "communityId", "pageRank", "hash", "name"]))
    with pytest.raises(ValueError):
        engine.call(g, "admin.triggerSummarization", repo="", complete=None)
    for mode, n in (("incremental", 2), ("incremental", 0), ("full", 2)):
        row = engine.call(g, "admin.triggerSummarization", repo="r", mode=mode, complete=lambda p, t: '{"purpose": "does"}').first()
        assert runs.of(g).wait(row["runId"]) == "completed", engine.call(g, "admin.summarizationStatus", runId=row["runId"]).first()
        assert f'"summaries": {n}' in engine.call(g, "admin.summarizationStatus", runId=row["runId"]).first()["stats"]
    assert rows(g["symbol_summaries"], "symbolFqn", "purpose", "contentHash", "stale") == {("r:a.js#x", "does", "h", False), ("r:a.js#y", "does", "h", False)}


def test_rolling_volatility(spark, tmp_path):
    rng, now = random.Random(3), datetime(2024, 6, 1)
    made = [("r", f"f{rng.randrange(9)}", now - timedelta(minutes=rng.randrange(60 * 24 * 500)), rng.choice(["A@x", "a@x", "b@x", "c@x", None])) for _ in range(800)]
    made += [("r", "one", now - timedelta(days=90), None), ("r", "old", now - timedelta(days=400), "z@x")]
    commits = spark.createDataFrame(made, "repo string, filePath string, ts timestamp, email string")
    want = rows(passes.git_volatility(commits, F.lit(now)), "filePath", "changeFrequency", "authorCount", "lastModified", "gitAge")
    for k in range(3):
        commits.where(F.pmod(F.hash("ts"), F.lit(3)) == k).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = jobs.watch(spark, str(tmp_path / "in"), commits.schema, files_per_trigger=1)
    rolling.keep(stream, str(tmp_path / "days"), str(tmp_path / "cp")).awaitTermination()
    for days in (rolling.daily(commits), jobs.current(spark, str(tmp_path / "days"))):
        assert rows(rolling.volatility(days, F.lit(now.date())), "filePath", "changeFrequency", "authorCount", "lastModified", "gitAge") == want
    many = spark.range(20000).selectExpr("'r' AS repo", "'f' AS filePath", "timestamp '2024-05-30' AS ts", "concat(id, '@x') AS email")
    assert abs(rolling.volatility(rolling.daily(many), F.lit(now.date())).first()["authorCount"] - 20000) < 1000
    assert rolling.volatility(rolling.daily(commits.limit(0)), F.lit(now.date())).count() == 0


def test_cache_with_an_age_limit(spark, tmp_path):
    at = lambda s: datetime(2024, 1, 1) + timedelta(seconds=s)
    kind = "key string, ts timestamp, event_id long, value string"
    batches = [[("a", at(0), 1, "x"), ("a", at(59), 2, None), ("a", at(60), 3, None), ("b", at(5), 4, None)], [("a", at(61), 5, "y"), ("a", at(100), 6, "z"), ("a", at(159), 7, None)], [("a", at(160), 8, None), ("c", at(600), 9, "q")], [("c", at(601), 10, None)]]
    for k, batch in enumerate(batches):
        spark.createDataFrame(batch, kind).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        time.sleep(1.1 if k < len(batches) - 1 else 0)  # files are read in order of their times
    stream = jobs.watch(spark, str(tmp_path / "in"), kind, files_per_trigger=1)
    got = jobs.once(jobs.cached(stream, 60), str(tmp_path / "cp"), mode="append")
    assert rows(got, "event_id", "value") == {(2, "x"), (3, None), (4, None), (7, "z"), (8, None), (10, "q")}


def test_configuration(tmp_path):
    path = tmp_path / "c.yaml"
    assert config.load(str(path)) == config.DEFAULTS
    path.write_text("a: [")
    assert config.load(str(path)) == config.DEFAULTS
    path.write_text("orchestrator: {passTimeoutSeconds: 9, enabled: null, passes: {a: {enabled: false}, b: {}, c: 3}}\nrateLimits: {perToken: [1]}\nmine: {x: 1}\n")
    got = config.load(str(path))
    assert got["orchestrator"]["passTimeoutSeconds"] == 9 and got["orchestrator"]["enabled"] is True and got["rateLimits"] == {"defaults": {"perMinute": 60, "perHour": 500}, "perToken": [1]} and got["mine"] == {"x": 1}
    passes_ = config.configured([Pass(n, lambda g: {}, enabled=n != "b") for n in "abc"], got)
    assert [(p.name, p.enabled) for p in passes_] == [("a", False), ("b", True), ("c", True)]
    got["orchestrator"]["passes"]["z"] = 1
    assert config.DEFAULTS["orchestrator"]["passes"] == {}


@pytest.mark.parametrize("text", ["repos: 3", "repos: [{url: 'git@h:a'}]", "repos: [{name: 'a b', url: 'git@h:a'}]", "repos: [{name: ., url: 'git@h:a'}]", "repos: [{name: a, url: 'https://h/a'}]", "repos: [{name: a}]", "repos: [{name: a, url: 'git@h:a'}, {name: a, url: 'git@h:a'}]", "repos: [{name: a, url: 'git@h:a', boundedContexts: 3}]", "repos: [{name: a, url: 'git@h:a', boundedContexts: [{paths: [x]}]}]", "repos: [{name: a, url: 'git@h:a', boundedContexts: [{id: c, paths: []}]}]", "repos: [{name: a, url: 'git@h:a', boundedContexts: [{id: c, paths: [1]}]}]", "repos: [{name: a, url: 'git@h:a', boundedContexts: [{id: c, paths: [x]}, {id: c, paths: [y]}]}]"])
def test_repositories_that_are_refused(tmp_path, text):
    (tmp_path / "r.yaml").write_text(text)
    with pytest.raises(config.ConfigError):
        config.repos(str(tmp_path / "r.yaml"))


def test_repositories(spark, tmp_path):
    path = tmp_path / "r.yaml"
    assert config.repos(str(path)) is None
    path.write_text("")
    assert config.repos(str(path)) == []
    path.write_text("defaults: {branch: dev, cloneDepth: -1}\nrepos: [{name: a, url: 'git@h:o/a', boundedContexts: [{id: c, name: C, paths: [src/, lib, 3]}]}, {name: b, url: 'ssh://h/b', branch: x, cloneDepth: 2, ignorePatterns: [t, 1]}]")
    a, b = config.repos(str(path))
    assert (a.branch, a.cloneDepth, b.branch, b.cloneDepth, b.ignorePatterns) == ("dev", 0, "x", 2, ["t"])
    nodes, patterns = config.contexts(spark, [a, b])
    assert rows(nodes, "repo", "contextId", "name", "description") == {("a", "c", "C", None)} and rows(patterns, "pattern", "declarationOrder") == {("src/", 0), ("lib", 1)}
    hit = passes.bounded_context(spark.createDataFrame([("src/x.js",), ("q",)], "path string"), patterns)
    assert rows(hit, "path", "contextId") == {("src/x.js", "c"), ("q", None)}


def test_passes_over_commits_and_contexts(spark):
    g = GraphBundle(spark)
    g.upsert("symbols", spark.createDataFrame([("r", "src/a.js", "x", "old"), ("s", "src/a.js", "y", "old"), ("r", "b.js", "z", "old")], "repo string, filePath string, name string, boundedContextId string"))
    commits = spark.createDataFrame([("r", "src/a.js", datetime(2024, 5, 30), "a@x")] * 3, "repo string, filePath string, ts timestamp, email string")
    patterns = spark.createDataFrame([("r", "c", "src/", 0), ("r", "d", "src/a.js", 1)], "repo string, contextId string, pattern string, declarationOrder int")
    got = run(g, engine.sourced(commits, patterns, F.lit(datetime(2024, 6, 1).date())))
    assert [(r.status, r.stats) for r in got] == [("success", {"files": 1}), ("success", {"assigned": 1, "ambiguous": 1})]
    assert rows(g["symbols"], "name", "changeFrequency", "authorCount", "gitAge", "boundedContextId") == {("x", 1.0, 1, 2, "c"), ("y", None, None, None, None), ("z", None, None, None, None)}
