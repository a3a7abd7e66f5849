import time

import pytest
from pyspark.sql import functions as F

from graphloom.bundle import GraphBundle
from graphloom.operators import extraction, tools
from graphloom.plans import engine
from graphloom.plans.runner import Pass, as_table, ordered, run
from graphloom.sources import files

APP = """import { save } from './lib/store.js';
import fs from 'node:fs/promises';
import _ from 'lodash/merge';
// entry
export async function main(a) {
  const x = load(a);
  save(x);
  setTimeout(main, 5);
}
function load(p) {
  if (!p) throw new errors.NotFound('x');
  return fs.readFile(p);
}
export default class Box {
  put(v) { this.v = v; }
}
var later = () => config.get('db.url');
"""
STORE = "export function save(x) {\n  return process.env.HOME;\n}\n"


@pytest.fixture(scope="module")
def graph(spark, tmp_path_factory):
    root = tmp_path_factory.mktemp("repo")
    (root / "src/lib").mkdir(parents=True)
    (root / "node_modules/x").mkdir(parents=True)
    (root / "src/app.js").write_text(APP)
    (root / "src/lib/store.js").write_text(STORE)
    (root / "src/readme.md").write_text("no code")
    (root / "node_modules/x/a.js").write_text("x()")
    found = files.source_files(spark, str(root), "r")
    g = GraphBundle(spark)
    engine.index(g, found)
    g.root = str(root)
    return g


def rows(df, *cols):
    return {tuple(r) for r in df.select(*cols).collect()}


def test_files_are_those_of_code(graph, spark):
    assert rows(files.source_files(spark, graph.root, "r"), "filePath") == {("src/app.js",), ("src/lib/store.js",)}


def test_symbols(graph):
    found = rows(graph["symbols"].where("filePath = 'src/app.js'"), "name", "kind", "isExported", "isAsync", "lineStart", "lineEnd")
    assert found == {("main", "function", True, True, 5, 9), ("load", "function", False, False, 10, 13), ("Box", "class", True, False, 14, 16), ("later", "function", False, False, 17, 17)}


def test_imports_and_packages(graph):
    assert rows(graph["imports"], "source", "target") == {("src/app.js", "src/lib/store.js")}
    assert rows(graph["external_packages"], "name") == {("node:fs",), ("lodash",)}


def test_calls_resolve_in_the_file_and_through_imports(graph):
    assert rows(graph["calls"], "src", "dst", "confidence") == {("r:src/app.js#main", "r:src/app.js#load", "exact"), ("r:src/app.js#main", "r:src/lib/store.js#save", "inferred")}


def test_behaviour(graph):
    got = {r["name"]: r for r in graph["symbols"].collect()}
    assert got["load"]["hasIO"] and got["load"]["effectKinds"] == ["file-read"] and got["load"]["throwTypes"] == ["NotFound"]
    assert not got["main"]["hasIO"] and got["main"]["effectKinds"] == ["timer"]
    assert got["Box"]["hasMutation"] and not got["Box"]["isPure"]
    assert got["later"]["configKeysRead"] == ["db.url"]


def test_index_is_idempotent(graph, spark):
    before = {n: graph[n].count() for n in ("modules", "symbols", "calls", "call_sites", "imports")}
    engine.index(graph, files.source_files(spark, graph.root, "r"))
    assert before == {n: graph[n].count() for n in before}


def test_passes_and_tools(graph, spark):
    records = engine.analyse(graph)
    assert [r.status for r in records] == ["success"] * 7, records
    got = {r["name"]: r for r in graph["symbols"].collect()}
    assert (got["main"]["fanOut"], got["load"]["fanIn"], got["load"]["depthFromEntry"]) == (2, 1, 1)
    assert ("r:src/app.js#main", "NotFound", True) in rows(graph["throws"], "symbol", "errorType", "propagated")
    assert rows(engine.call(graph, "graph.callers", key="load"), "name", "depth") == {("main", 1)}
    assert engine.call(graph, "graph.query", text="SELECT count(*) AS n FROM symbols").first()["n"] == 5
    with pytest.raises(ValueError):
        engine.call(graph, "graph.query", text="DROP TABLE symbols")
    spark.sql("CREATE OR REPLACE TEMP VIEW src AS SELECT 1 AS a")
    for text in (
        "WITH t AS (SELECT 1 AS a) INSERT INTO tgt SELECT * FROM t",
        "FROM src INSERT INTO tgt SELECT a INSERT INTO tgt SELECT a",
        "INSERT OVERWRITE DIRECTORY '/tmp/never' USING parquet SELECT 1",
        "CREATE TABLE x AS SELECT 1",
        "SELECT reflect('java.lang.System', 'gc')",
        "CACHE TABLE src",
        "SET a = b",
        "EXPLAIN SELECT 1",
        "DESCRIBE src",
        "MERGE INTO tgt USING src ON tgt.a = src.a WHEN MATCHED THEN DELETE",
        "DELETE FROM tgt WHERE a IN (SELECT a FROM src)",
        "BEGIN INSERT INTO tgt VALUES (1); END",
    ):
        with pytest.raises(Exception):  # noqa: B017  by the guard, or by the parser
            tools.open_query(spark, text)
        with pytest.raises(Exception):  # noqa: B017
            spark.table("tgt")
    for text in (
        "WITH t AS (SELECT a FROM src) SELECT (SELECT max(a) FROM t) AS m, count(*) OVER () AS n FROM t JOIN src USING (a) WHERE a IN (SELECT a FROM src) UNION ALL (SELECT 1, 2 LIMIT 1)",
        "SELECT a, count(*) FROM src LATERAL VIEW explode(array(1, 2)) t AS x GROUP BY a HAVING count(*) > 0 ORDER BY a",
        "SELECT * FROM VALUES (1, 2), (3, 4) AS t(a, b) PIVOT (sum(b) FOR a IN (1, 3))",
        "SELECT a FROM src TABLESAMPLE (50 PERCENT) EXCEPT SELECT 1",
        "WITH RECURSIVE r AS (SELECT 1 AS i UNION ALL SELECT i + 1 FROM r WHERE i < 3) SELECT DISTINCT i FROM r",
    ):
        assert tools.open_query(spark, text).columns
    with pytest.raises(KeyError):
        engine.call(graph, "no.tool")


def test_bundle_is_written_and_read(graph, spark, tmp_path):
    graph.write(str(tmp_path))
    again = GraphBundle.read(spark, str(tmp_path), ["symbols", "calls"])
    assert rows(again["symbols"], "name") == rows(graph["symbols"], "name")


def test_module_systems(spark):
    texts = {"e": "export { a } from './a.js';\n", "c": "const a = require('a');", "n": "let a = 1;", "m": "import a from 'a';\nmodule.exports = a;"}
    df = spark.createDataFrame([("r", k, v) for k, v in texts.items()], "repo string, filePath string, text string")
    got = {r["path"]: (r["moduleSystem"], r["isBarrel"]) for r in extraction.modules(df).collect()}
    assert got == {"e": ("esm", True), "c": ("cjs", False), "n": ("none", False), "m": ("mixed", False)}


def test_comments_and_docstrings(spark):
    df = spark.createDataFrame([("r", "a", "/** Adds.\n * two numbers\n * @param x */\nfunction a() {}\n/* SPDX */\n// one")], "repo string, filePath string, text string")
    assert rows(extraction.comments(df), "kind", "hasDocTags") == {("jsdoc", True), ("license", False), ("line", False)}
    assert df.select(extraction.docstring(F.col("text"))).first()[0] == "Adds.\ntwo numbers"


PAY = """/** Pays. */
import { SQSClient } from '@aws-sdk/client-sqs';
/**
 * Charges a card.
 * @param x
 */
function charge(x) {
  if (flags.isEnabled('new-pay')) { return process.env.PAY_URL; }
  try { send(x); } catch (e) { if (e instanceof Declined) { throw new Refused(); } }
}
function send(x) { return new SQSClient(x, 1); }
const twin = () => charge(1);
export { charge, twin as pay };
"""
TEST = "import { charge } from './pay.js';\nfunction check() {\n  charge(2);\n}\n"


def test_index_writes_all_facts_and_replaces_them(spark):
    table = lambda text: spark.createDataFrame([("r", "src/pay.js", str(hash(text)), text), ("r", "src/pay.test.js", "t", TEST)], "repo string, filePath string, hash string, text string")
    g = GraphBundle(spark)
    engine.index(g, table(PAY))
    charge = "r:src/pay.js#charge"
    assert rows(g["modules"].where("docstring IS NOT NULL"), "path", "docstring", "language") == {("src/pay.js", "Pays.", "javascript")}
    assert rows(g["symbols"].where("name = 'charge'"), "isExported", "exportKind", "docstring", "signature") == {(True, "named", "Charges a card.", "function charge(x)")}
    assert rows(g["catches"], "symbol", "errorType") == {(charge, "Declined")}
    assert rows(g["throws"], "symbol", "errorType") == {(charge, "Refused")} and rows(g["error_flows"], "errorType") == {("Refused",)}
    assert rows(g["reads_config"], "symbol", "key", "accessPattern") == {(charge, "PAY_URL", "process.env")} and rows(g["config_items"], "key") == {("PAY_URL",)}
    assert rows(g["reads_flag"], "symbol", "flag", "checkKind") == {(charge, "new-pay", "is-enabled")} and rows(g["flags"], "name", "providerHint") == {("new-pay", "unleash")}
    assert rows(g["external_services"], "name", "protocol") == {("sqs", "amqp")} or g["external_services"].count() == 1
    assert rows(g["imports_service"], "module") == {("src/pay.js",)} and rows(g["calls_service"], "symbol") == {("r:src/pay.js#send",)}
    assert ("s0", "module") in rows(g["scopes"], "scopeId", "kind") and g["comments"].count() == 2 and g["code_references"].count() > 10
    assert ("SQSClient", 2, True) in rows(g["call_sites"], "calleeExpression", "argumentCount", "isNewExpression")
    records = engine.analyse(g)
    assert [r.status for r in records] == ["success"] * 7, records
    assert rows(g["test_asserts"], "test", "symbol") >= {("r:src/pay.test.js#check", charge)}
    assert {r["repo"] for r in g["metrics_meta"].collect()} == {"r"} and g["communities"].agg(F.sum("size")).first()[0] == 4
    assert engine.PASSES[0].run(g) == {"repos": 0}  # no calls have changed since
    assert engine.call(g, "graph.symbolDetails", key="charge").first()["module"] == "src/pay.js"
    assert engine.call(g, "graph.serviceTopology").count() == 1 and engine.call(g, "graph.symbolContext", key="charge").first()["callers"] == "check,twin"
    node = engine.call(g, "summaries.getNode", key="charge").first()
    assert (node["thrownTypes"], node["configKeys"], node["testCoverage"]) == (["Refused"], ["PAY_URL"], True)
    community = g["symbols"].where("name = 'charge'").first()["communityId"]
    assert ("charge",) in rows(engine.call(g, "graph.communityContext", community=community), "name")
    assert engine.call(g, "graph.semanticSearch", vector=None).count() == 0 and not engine.ready(g, "symbol_summaries")
    # a file that lost a symbol loses its facts
    engine.index(g, table("export const nothing = 1;\n"))
    for name in ("throws", "catches", "reads_config", "reads_flag", "calls_service", "imports_service", "comments"):
        assert g[name].count() == 0, name
    assert rows(g["symbols"].where("filePath = 'src/pay.js'"), "name") == {("nothing",)}


def test_documents_through_tools(spark):
    g = GraphBundle(spark)
    g["symbols"] = spark.createDataFrame([("r", "a.js", "LoadUser", "function")], "repo string, filePath string, name string, kind string")
    for c in [c for c in GraphBundle(spark)["symbols"].columns if c not in g["symbols"].columns]:
        g["symbols"] = g["symbols"].withColumn(c, F.lit(None).cast(GraphBundle(spark)["symbols"].schema[c].dataType))
    body = "---\ntitle: T\ntype: adr\nstatus: current\nauthor: me\ncreated: 2024-01-01\nupdated: 2024-01-02\nsymbols:\n  - r:a.js#LoadUser\n---\n# Head\nSee `LoadUsers` and the *payment* flow.\n"
    engine.call(g, "docs.create", path="x/one.md", body=body)
    with pytest.raises(ValueError):
        engine.call(g, "docs.create", path="x/one.md", body=body)
    assert (engine.call(g, "docs.read", path="x/one.md").first()["type"], engine.call(g, "docs.list").count()) == ("adr", 1)
    engine.call(g, "docs.propose", name="idea", body="# Idea of payment")
    assert rows(g["documents"].where("status = 'proposed'"), "path") == {(".claude/proposals/idea.md",)}
    assert [r["path"] for r in engine.call(g, "docs.search", query="payment flow").collect()] == ["x/one.md", ".claude/proposals/idea.md"]
    assert rows(engine.call(g, "docs.search", query="payment", filters={"type": "adr"}), "path") == {("x/one.md",)}
    assert rows(engine.call(g, "admin.docGraphRun"), "how", "channel", "n") == {("exact", "frontmatter", 1), ("fuzzy", "inline", 1)}
    assert rows(g["documented_by"], "doc_path", "symbol") == {("x/one.md", "r:a.js#LoadUser")}
    assert engine.call(g, "admin.docGraphRun").count() == 0  # nothing changed since
    assert rows(engine.call(g, "graph.symbolsInDoc", path="x/one.md"), "name", "link") == {("LoadUser", "documented_by")}
    g["templates"] = spark.createDataFrame([("t", "# {{a}} {{b}}")], "name string, body string")
    engine.call(g, "docs.applyTemplate", template="t", path="y.md", a="A")
    assert engine.call(g, "docs.read", path="y.md").first()["body"] == "# A {{b}}"
    engine.call(g, "docs.delete", path="y.md")
    engine.call(g, "docs.delete", path="y.md")
    with pytest.raises(KeyError):
        engine.call(g, "docs.read", path="y.md")


def ok(_):
    return {"n": 1}


def bad(_):
    raise RuntimeError("no")


def test_runner(spark):
    g = GraphBundle(spark)
    a, b, c = Pass("a", ok), Pass("b", bad, needs=("a",)), Pass("c", ok, needs=("b",))
    assert [p.name for p in ordered([c, b, a])] == ["a", "b", "c"]
    got = run(g, [a, b, c, Pass("d", ok, enabled=False), Pass("e", ok)])
    assert [(r.name, r.status) for r in got] == [("a", "success"), ("b", "failed"), ("c", "skipped"), ("d", "skipped"), ("e", "success")]
    assert [r.status for r in run(g, [Pass("b", bad, on_error="abort"), a])] == ["failed", "skipped"]
    assert as_table(spark, got, "r").count() == 5
    for wrong in ([a, a], [c], [Pass("x", ok, needs=("y",)), Pass("y", ok, needs=("x",))]):
        with pytest.raises(ValueError):
            ordered(wrong)


def test_timeout(spark):
    slow = Pass("slow", lambda g: g.spark.range(10**13).selectExpr("sum(id % 7) AS s").collect() and {}, timeout=1.5)
    start = time.time()
    assert [r.status for r in run(GraphBundle(spark), [slow])] == ["timeout"]
    assert time.time() - start < 20
    ends = time.time() + 10
    while spark.sparkContext.statusTracker().getActiveJobsIds() and time.time() < ends:
        time.sleep(0.2)
    assert not spark.sparkContext.statusTracker().getActiveJobsIds()
