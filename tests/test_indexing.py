import pandas as pd
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from graphloom.bundle import GraphBundle
from graphloom.plans import engine
from graphloom.plans.isolation import isolated
from graphloom.sources import files as source
from graphloom.sources.feed import Feed, changes
from graphloom.streaming import jobs

FILES = "repo string, filePath string, hash string, text string"
LIB = "/** Saves. */\nexport function save(x) {\n  if (x) { return x; }\n}\nexport { save as put, missing };\n"
APP = "import { save } from './lib.js';\nfunction main() {\n  save(1);\n}\n"


def rows(df, *cols):
    return {tuple(r) for r in df.select(*cols).collect()}


def table(spark, texts, repo="r"):
    return spark.createDataFrame([(repo, p, None if t is None else str(hash(t)), t) for p, t in texts.items()], FILES)


@F.pandas_udf(T.StringType())
def picky(texts: pd.Series) -> pd.Series:
    if texts.str.contains("BOOM").any():
        raise ValueError("no reading this")
    return texts


def test_one_bad_file_of_1000_leaves_999(spark):
    texts = {f"a/{i}.js": f"export function f{i}() {{\n  return {i};\n}}\n" for i in range(1000)}
    texts["a/77.js"] = "BOOM"
    g = GraphBundle(spark)
    got = engine.index(g, table(spark, texts), before=[lambda df: df.withColumn("text", picky("text"))])
    assert got == {"indexed": 999, "errors": 1}
    assert g["modules"].where("hash IS NOT NULL").count() == 999 and g["symbols"].count() == 999
    assert rows(g["index_errors"], "repo", "filePath", "reason") == {("r", "a/77.js", "ValueError: no reading this")}
    assert g["modules"].where("path = 'a/1.js'").first()["hash"] == str(hash(texts["a/1.js"]))


def test_unreadable_files_are_told_and_cleared(spark):
    g = GraphBundle(spark)
    several = table(spark, {"lib.js": LIB, "none.js": None}).unionByName(table(spark, {"twice.js": "let a = 1;"})).unionByName(table(spark, {"twice.js": "let b = 1;"})).unionByName(table(spark, {"lib.js": LIB}))
    assert engine.index(g, several) == {"indexed": 1, "errors": 2}
    assert rows(g["index_errors"], "filePath", "reason") == {("none.js", "no text"), ("twice.js", "several contents")}
    engine.index(g, table(spark, {"twice.js": "let b = 1;"}))
    assert rows(g["index_errors"], "filePath") == {("none.js",)}
    assert engine.index(GraphBundle(spark), spark.createDataFrame([], FILES)) == {"indexed": 0, "errors": 0}


def test_a_job_at_fault_raises(spark):
    def broken(part):
        raise RuntimeError("folder is gone")

    with pytest.raises(RuntimeError):
        isolated(table(spark, {"a.js": "a", "b.js": "b"}), broken)


def test_bytes_that_are_no_text(spark, tmp_path):
    (tmp_path / "a.js").write_bytes(b"let a = '\xff\xfe';")
    assert source.source_files(spark, str(tmp_path), "r").first()["text"] == "let a = '��';"


def test_edges_within_files(spark):
    g = GraphBundle(spark)
    engine.index(g, table(spark, {"lib.js": LIB, "app.js": APP}))
    save = "r:lib.js#save"
    assert rows(g["exports"], "module", "exportName", "symbol") == {("lib.js", "save", save)}
    assert rows(g["parent_scope"].where("filePath = 'lib.js'"), "scopeId", "parentId") == {("s1", "s0"), ("s2", "s1")}
    assert rows(g["annotated_by"], "symbol", "kind", "commentLine") == {(save, "jsdoc", 1)}
    assert (5, save) in rows(g["resolves_to"], "line", "symbol") and rows(g["resolves_to"].where("filePath = 'app.js'"), "symbol") == set()


def test_follow_forgets_what_is_gone(spark):
    g = GraphBundle(spark)
    engine.index(g, table(spark, {"other.js": APP}, "s"))
    assert engine.follow(g, table(spark, {"lib.js": LIB, "app.js": APP})) == {"indexed": 2, "errors": 0, "deleted": 0}
    assert g["calls"].where("repo = 'r'").count() == 1
    assert engine.follow(g, table(spark, {"app.js": APP})) == {"indexed": 0, "errors": 0, "deleted": 1}
    assert rows(g["symbols"], "repo", "name") == {("r", "main"), ("s", "main")}
    assert g["calls"].count() == 0 and g["exports"].count() == 0 and g["annotated_by"].count() == 0
    assert rows(g["imports"], "repo") == {("s",)}
    engine.follow(g, spark.createDataFrame([], FILES), repos=spark.createDataFrame([("r",)], "repo string"))
    assert rows(g["symbols"], "repo") == {("s",)}


def test_changes(spark):
    df = lambda x: spark.createDataFrame(x, "k string, v string")
    before, now = df([("a", "1"), ("b", "1"), ("c", None), ("d", None), (None, "1")]), df([("a", "1"), ("b", "2"), ("b", "1"), ("c", None), ("e", None), (None, "2")])
    assert rows(changes(before, now, ["k"], "v"), "k", "event", "v") == {("b", "updated", "2"), ("d", "deleted", None), ("e", "created", None)}
    assert changes(now.limit(0), now.limit(0), ["k"], "v").count() == 0


def test_feed_over_looks_and_as_a_stream(spark, tmp_path):
    df = lambda x: spark.createDataFrame(x, "repo string, path string, v string")
    feed = Feed(spark, str(tmp_path / "feed"), ["repo", "path"], "v")
    seen = [rows(feed.poll(df(x)), "path", "event", "look") for x in ([("r", "a", "1"), ("r", "b", "1")], [("r", "a", "2"), ("s", "c", "1")], [("r", "a", "2")], [("r", "a", "3")])]
    assert seen == [{("a", "created", 1), ("b", "created", 1)}, {("a", "updated", 2), ("b", "deleted", 2), ("c", "created", 2)}, {("c", "deleted", 3)}, {("a", "updated", 4)}]
    assert feed.events().count() == 7
    batches = []
    stream = jobs.watch(spark, str(tmp_path / "feed/events"), "repo string, path string, event string, v string, look int")
    jobs.on_changes(stream, str(tmp_path / "checkpoint"), ["repo", "path"], "look", lambda repo_events: batches.extend(map(tuple, repo_events.select("repo", "path", "event").collect()))).awaitTermination()
    assert sorted(batches) == [("r", "a", "updated"), ("r", "b", "deleted"), ("s", "c", "deleted")]
