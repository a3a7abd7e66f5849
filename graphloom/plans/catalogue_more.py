"""Registered queries on finer facts of source text, reconciliation, concepts and summaries."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.checkpoints import dealt
from graphloom.fixtures import Graph
from graphloom.operators import concepts, doc_writes, documents, extraction, parsing, rules, summaries
from graphloom.plans.catalogue import query, rounded
from graphloom.plans.catalogue_text import MEMBERS, RESOLVED, members, resolved

# ---- one small file for each symbol

PACKAGES = [p for p, _, _ in rules.SDK_SERVICES]
SPEC_SQL = "CASE sym_key % " + str(len(PACKAGES)) + " " + " ".join(f"WHEN {i} THEN '{p}'" for i, p in enumerate(PACKAGES)) + " END"
#: ``NAME``, ``SPEC`` and ``GROUP`` are the symbol's.
SOURCE = """/** Doc of NAME. */
import { Client } from 'SPEC';
export { NAME as alias };
function NAME(a) {
  try { Client(a); } catch (err) { if (err instanceof errors.EGROUP) { x; } }
  total += a; // total
}
"""


def source_files(g: Graph) -> DataFrame:
    spec = F.get(F.array(*[F.lit(p) for p in PACKAGES]), (F.col("sym_key") % len(PACKAGES)).cast("int"))
    text: Column = F.lit(SOURCE)
    for mark, value in (("NAME", F.col("name")), ("SPEC", spec), ("GROUP", F.col("communityId").cast("string"))):
        text = F.replace(text, F.lit(mark), value)
    # texts are far larger than the rows they are made from, whose few bytes would be one task
    rows = g.sym.select("repo", "filePath", "sym_key", "name", "communityId")
    return dealt(rows).select("repo", F.concat("filePath", F.lit("/"), F.col("sym_key").cast("string")).alias("filePath"), text.alias("text"))


FILE_SQL = "repo, concat(filePath, '/', sym_key) AS \"filePath\""


@query(f"SELECT {FILE_SQL}, concat('Doc of ', name, '.') AS docstring FROM sym")
def module_docstrings(g: Graph) -> DataFrame:
    return source_files(g).select("repo", "filePath", parsing.module_docstring(F.col("text")).alias("docstring"))


@query(f"SELECT {FILE_SQL}, true AS \"isStrict\" FROM sym")
def strict_modules(g: Graph) -> DataFrame:
    return parsing.strict(source_files(g))


@query(f"SELECT {FILE_SQL}, name, 'alias' AS \"exportName\", 'named' AS \"exportKind\" FROM sym")
def export_lists(g: Graph) -> DataFrame:
    return parsing.exports(source_files(g))


@query(f"""SELECT {FILE_SQL}, v.id AS "scopeId", v.kind, v.a AS "lineStart", v.b AS "lineEnd", v.id = 's0' AS "isStrict", v.parent AS "parentId" FROM sym,
(VALUES ('s0', 'module', 1, 8, NULL), ('s1', 'function', 4, 7, 's0'), ('s2', 'block', 5, 5, 's1'), ('s3', 'catch', 5, 5, 's1'), ('s4', 'block', 5, 5, 's3')) AS v(id, kind, a, b, parent)""")
def code_scopes(g: Graph) -> DataFrame:
    return parsing.scopes(source_files(g))


@query(f"""SELECT {FILE_SQL}, coalesce(v.name, sym.name) AS name, v.line, v.col AS "column", v.r AS "isRead", v.w AS "isWrite", v.c AS "isCall" FROM sym,
(VALUES ('Client', 2, 10, true, false, false), (NULL, 3, 10, true, false, false), ('Client', 5, 9, true, false, true), ('a', 5, 16, true, false, false), ('err', 5, 29, true, false, false),
('err', 5, 40, true, false, false), ('errors', 5, 55, true, false, false), ('x', 5, 0, true, false, false), ('total', 6, 3, true, true, false), ('a', 6, 12, true, false, false)) AS v(name, line, col, r, w, c)
WHERE v.line = 6 OR (v.line = 5 AND v.name IN ('Client', 'a', 'errors'))""")
def code_references(g: Graph) -> DataFrame:
    rows = parsing.references(source_files(g)).where("line = 6 OR (line = 5 AND name IN ('Client', 'a', 'errors'))")
    return rows.select("repo", "filePath", "name", "line", "column", "isRead", "isWrite", "isCall")


@query(f"SELECT {FILE_SQL}, concat('E', communityId) AS \"errorType\", concat('if (err instanceof errors.E', communityId, ') {{ x; }}') AS \"catchBlock\" FROM sym".replace("{{", "{").replace("}}", "}"))
def catch_info(g: Graph) -> DataFrame:
    rows = source_files(g).select("repo", "filePath", F.explode(parsing.caught(F.col("text"))).alias("c"))
    return rows.select("repo", "filePath", "c.errorType", "c.catchBlock")


@query("WITH v AS (SELECT * FROM (VALUES " + ", ".join(f"({i}, '{s}', '{k}')" for i, (_, s, k) in enumerate(rules.SDK_SERVICES)) + f") AS t(k, service, protocol)) SELECT concat(repo, ':', filePath, '/', sym_key) AS symbol, service, protocol FROM sym JOIN v ON v.k = sym_key % {len(PACKAGES)}")
def service_call_edges(g: Graph) -> DataFrame:
    files = source_files(g)
    bound = parsing.service_imports(extraction.imports(files), parsing.service_table(g.spark))
    names = parsing.references(files).where("line = 5").select("repo", "filePath", F.concat("repo", F.lit(":"), "filePath").alias("symbol"), "name")
    return parsing.service_calls(names, bound)


@query(f"SELECT {FILE_SQL}, name, 4 AS \"lineStart\", 7 AS \"lineEnd\", concat('function ', name, '(a)') AS signature FROM sym")
def symbol_spans(g: Graph) -> DataFrame:
    return extraction.symbols(source_files(g)).select("repo", "filePath", "name", "lineStart", "lineEnd", "signature")


@query(f"SELECT {FILE_SQL}, kind, line, tags FROM (SELECT repo, filePath, sym_key, v.* FROM sym, (VALUES ('jsdoc', 1, false), ('line', 6, false)) AS v(kind, line, tags))")
def comment_places(g: Graph) -> DataFrame:
    return parsing.comment_places(source_files(g)).select("repo", "filePath", "kind", F.col("lineStart").alias("line"), F.col("hasDocTags").alias("tags"))


@query(f"SELECT {FILE_SQL}, 'Client' AS callee, 1 AS \"argumentCount\" FROM sym")
def call_arguments(g: Graph) -> DataFrame:
    return extraction.call_sites(source_files(g)).where("line = 5").select("repo", "filePath", "callee", "argumentCount")


# ---- reconciliation and documents

TYPO = "concat(substr(name, 1, 3), 'x', substr(name, 5))"
GRAMS = "list_distinct(list_transform(range(1, length({c})), lambda i: lower({c})[i:i + 1]))"


@query(f"""WITH r AS MATERIALIZED (SELECT DISTINCT CASE WHEN sym_key % 2 = 0 THEN repo END AS service, {TYPO} AS name FROM sym),
a AS MATERIALIZED (SELECT DISTINCT name, {GRAMS.format(c='name')} AS g FROM r), b AS MATERIALIZED (SELECT name AS symbol, repo, id, {GRAMS.format(c='name')} AS h FROM sym),
ag AS (SELECT name, len(g) AS n, unnest(g) AS x FROM a), bg AS (SELECT symbol, id, repo, len(h) AS m, unnest(h) AS x FROM b),
s AS MATERIALIZED (SELECT name, id, repo, 2.0 * count(*) / (n + m) AS score FROM ag JOIN bg USING (x) GROUP BY name, id, repo, n, m HAVING 2.0 * count(*) / (n + m) >= 0.6 - 1e-9)
SELECT r.service, r.name, round(max(s.score) + 1e-9, 6) AS score, arg_min(s.id, (-s.score, s.id)) AS id FROM r JOIN s ON s.name = r.name AND (r.service IS NULL OR r.service = s.repo) GROUP BY r.service, r.name""")
def fuzzy_refs(g: Graph) -> DataFrame:
    name = F.concat(F.substring("name", 1, 3), F.lit("x"), F.expr("substring(name, 5)"))
    refs = g.sym.select(F.when(F.col("sym_key") % 2 == 0, F.col("repo")).alias("service"), name.alias("name"))
    return documents.fuzzy(refs, g.sym).select("service", "name", rounded("score").alias("score"), "id")


@query("SELECT path, sha256(body) AS hash FROM docs WHERE doc_id % 2 = 1 AND path LIKE 'services/%'")
def doc_scan(g: Graph) -> DataFrame:
    known = F.when(F.col("doc_id") % 2 == 0, F.sha2("body", 256)).when(F.col("doc_id") % 3 == 0, "old")
    return documents.to_scan(g.docs.withColumn("lastEnrichedHash", known), "services/").select("path", "hash")


def headed(g: Graph) -> DataFrame:
    """Documents whose frontmatter lists their symbol, by id, by path and by name."""
    s = g.sym.select("sym_key", "repo", "filePath", "name", "id")
    head = F.concat(F.lit("---\ntitle: x\ntype: "), "type", F.lit("\nstatus: draft\nauthor: a b\nsymbols:\n  - "), "id", F.lit("\n  - \""), "filePath", F.lit("#"), "name", F.lit("\"\n  - "), "name", F.lit("\ndomain: d1\n---\n"), "body")
    return g.docs.join(s, "sym_key").select("doc_id", "path", "service", head.alias("body"))


@query("""SELECT d.path AS doc_path, CASE WHEN v.k = 1 THEN s.repo END AS repo, CASE WHEN v.k < 3 THEN s."filePath" END AS "filePath", s.name FROM docs d JOIN sym s ON s.sym_key = d.sym_key, (VALUES (1), (2), (3)) AS v(k)""")
def frontmatter_refs(g: Graph) -> DataFrame:
    return documents.declared(headed(g))


@query(f"WITH {RESOLVED} SELECT path AS doc_path, target, CASE WHEN arg_max(how, (channel, name, how)) = 'fuzzy' THEN 'inferred' ELSE 'exact' END AS confidence, max(channel) AS channel FROM resolved WHERE target IS NOT NULL GROUP BY path, target")
def reference_edges(g: Graph) -> DataFrame:
    return documents.reference_edges(resolved(g), ["channel", "name", "how"])[1]


@query("SELECT path, status FROM (SELECT path, 'x' AS status FROM docs WHERE doc_id % 3 <> 0 AND doc_id % 5 <> 0 UNION ALL SELECT path, 'draft' FROM docs WHERE doc_id % 3 = 0 AND doc_id % 5 <> 0)")
def docs_write(g: Graph) -> DataFrame:
    """A third of the documents written anew, then a fifth deleted."""
    old = g.docs.select("path", F.lit("x").alias("status"), "body")
    out = doc_writes.updated(old, headed(g).where("doc_id % 3 = 0").select("path", "body"))
    return doc_writes.deleted(out, g.docs.where("doc_id % 5 = 0").select("path")).select("path", "status")


@query("SELECT concat('.claude/proposals/', doc_id, CASE WHEN doc_id % 2 = 0 THEN '.md' ELSE '.md' END) AS path, 'proposed' AS status FROM docs")
def docs_propose(g: Graph) -> DataFrame:
    none = g.docs.select("path", F.lit("x").alias("status"), "body").where("false")
    name = F.concat(F.col("doc_id").cast("string"), F.when(F.col("doc_id") % 2 == 0, ".md").otherwise(""))
    return doc_writes.proposed(none, headed(g).select(name.alias("name"), "body")).select("path", "status")


@query("SELECT concat('t/', doc_id) AS path, concat('# ', type, ' of {{owner}}') AS body FROM docs")
def docs_from_template(g: Graph) -> DataFrame:
    templates = g.spark.createDataFrame([("plain", "# {{type}} of {{owner}}"), ("other", "{{type}}")], "name string, body string")
    wanted = g.docs.select(F.concat(F.lit("t/"), F.col("doc_id").cast("string")).alias("path"), F.lit("plain").alias("template"), "type")
    return doc_writes.from_template(g.docs.select("path", "body").where("false"), templates, wanted, ["type"])


@query("SELECT path FROM docs WHERE doc_id % 4 <> 1")
def docs_index(g: Graph) -> DataFrame:
    path = F.when(F.col("doc_id") % 4 == 1, F.concat(F.lit("concepts/"), "path")).otherwise(F.col("path"))
    return doc_writes.index_rows(g.docs.select(path.alias("path"), "body")).select("path")


# ---- concepts


@query("SELECT path FROM docs WHERE length(body) >= 400")
def concept_doc_filter(g: Graph) -> DataFrame:
    return concepts.worth_reading(g.docs).select("path")


@query("SELECT sym_key, name, CASE sym_key % 3 WHEN 0 THEN 0.5 WHEN 1 THEN 1.0 ELSE 0.25 END AS confidence FROM sym")
def concept_candidates(g: Graph) -> DataFrame:
    given = F.expr("CASE sym_key % 3 WHEN 0 THEN '' WHEN 1 THEN ', \"confidence\": 7' ELSE ', \"confidence\": 0.25' END")
    answer = F.concat(F.lit("Here: {\"concepts\": [{\"name\": \" "), "name", F.lit(" \", \"evidence\": \"a } b \\\" {\""), given, F.lit("}, {\"name\": \"  \"}, {\"confidence\": 1}]} and {more}"))
    return g.sym.select("sym_key", F.inline(concepts.candidates(answer))).select("sym_key", "name", "confidence")


def greedy_sql(threshold: float) -> str:
    """One vector after the other: a list of those that made a concept, and the nearest of them."""
    cos = "list_cosine_similarity(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[]))"
    return f"""WITH RECURSIVE near AS MATERIALIZED (SELECT a.vec_id AS id, b.vec_id AS earlier, {cos} AS cos FROM embeddings a JOIN embeddings b ON b.vec_id < a.vec_id WHERE {cos} > {threshold}),
o AS MATERIALIZED (SELECT e.vec_id AS id, row_number() OVER (ORDER BY e.vec_id) AS k, (SELECT list(earlier) FROM near WHERE near.id = e.vec_id) AS early FROM embeddings e),
r AS (SELECT CAST(0 AS BIGINT) AS k, CAST([] AS BIGINT[]) AS made UNION ALL SELECT o.k, CASE WHEN o.early IS NULL OR NOT list_has_any(r.made, o.early) THEN list_append(r.made, o.id) ELSE r.made END FROM r JOIN o ON o.k = r.k + 1),
m AS MATERIALIZED (SELECT unnest(made) AS concept FROM (SELECT made FROM r ORDER BY k DESC LIMIT 1))
SELECT o.id, coalesce((SELECT concept FROM m WHERE m.concept = o.id), (SELECT arg_min(n.earlier, (-n.cos, n.earlier)) FROM near n JOIN m ON m.concept = n.earlier WHERE n.id = o.id)) AS concept FROM o"""


@query(greedy_sql(concepts.MERGE))
def concept_dedup(g: Graph) -> DataFrame:
    """Concepts in the order of their ids, merged beyond the fixed cosine."""
    return concepts.greedy_merge(g.embeddings.select(F.col("vec_id").alias("id"), F.col("embedding").cast("array<double>").alias("v")))


@query(greedy_sql(0.25))
def concept_dedup_loose(g: Graph) -> DataFrame:
    """The same with a cosine that many pairs reach, so that what comes first decides."""
    return concepts.greedy_merge(g.embeddings.select(F.col("vec_id").alias("id"), F.col("embedding").cast("array<double>").alias("v")), 0.25)


# ---- summaries


def stubs(g: Graph) -> DataFrame:
    """Members as the summarising operators take them."""
    rows = members(g)
    names = g.sym.select("id", "name")
    return rows.join(names.hint("merge"), "id").withColumn("role", F.when(F.col("sym_key") % 11 == 0, "bridge").otherwise("core"))


@query(f"WITH {MEMBERS} SELECT repo, communityId, id, row_number() OVER (PARTITION BY repo, communityId ORDER BY pr DESC, id) AS \"at\", tier IS NOT NULL AS \"hasSummary\" FROM members")
def community_members(g: Graph) -> DataFrame:
    tiers = g.sym_summaries.select("symbolFqn", "tier")
    return summaries.community(stubs(g).drop("tier"), tiers).select("repo", "communityId", "id", F.col("at").cast("long").alias("at"), "hasSummary")


@query("""SELECT s.id, coalesce((SELECT string_agg(t.errorType, ',') FROM throws_direct t WHERE t.sym_key = s.sym_key), '') AS thrown, coalesce((SELECT string_agg(c.service, ',' ORDER BY c.service) FROM calls_service c WHERE c.sym_key = s.sym_key), '') AS services,
EXISTS (SELECT 1 FROM calls k JOIN sym t ON t.sym_key = k.src WHERE k.dst = s.sym_key AND t.filePath LIKE '%.test.js') AS tested FROM sym s""")
def node_details(g: Graph) -> DataFrame:
    ids = g.sym.select("sym_key", F.col("id").alias("symbol"))
    throws, services = g.throws_direct.select("sym_key", "errorType").join(ids, "sym_key"), g.calls_service.select("sym_key", "service").join(ids, "sym_key")
    tests = g.calls.join(g.sym.where(F.col("filePath").endswith(".test.js")).select(F.col("sym_key").alias("src")), "src").select(F.col("dst").alias("sym_key")).join(ids, "sym_key")
    none = ids.select("symbol", F.lit("").alias("key")).where("false")
    rows = summaries.node_details(g.sym.select("id"), throws, services, none, tests)
    return rows.select("id", F.array_join("thrownTypes", ",").alias("thrown"), F.array_join("services", ",").alias("services"), F.col("testCoverage").alias("tested"))


@query("SELECT sym_key, left(repeat(concat(name, ' '), 40), 150) AS purpose, CAST(10 AS INT) AS tags FROM sym WHERE sym_key % 2 = 0")
def summary_payload(g: Graph) -> DataFrame:
    answer = F.when(F.col("sym_key") % 2 == 0, F.concat(F.lit("{\"purpose\": \""), F.repeat(F.concat("name", F.lit(" ")), F.lit(40)), F.lit("\", \"semanticTags\": " + json.dumps([str(i) for i in range(14)]) + "}"))).otherwise("sorry")
    rows = g.sym.select("sym_key", summaries.payload(answer).alias("p")).where("p IS NOT NULL")
    return rows.select("sym_key", "p.purpose", F.size("p.semanticTags").alias("tags"))


@query("SELECT symbolFqn, CASE WHEN sym_key % 4 = 0 THEN 'canonical' ELSE tier END AS tier, sym_key % 4 <> 0 AND stale AS stale FROM sym_summaries")
def summary_write(g: Graph) -> DataFrame:
    columns = [F.lit("p").alias("purpose"), F.array(F.lit("t")).alias("semanticTags"), F.lit(0).cast("timestamp").alias("generatedAt")]
    old = g.sym_summaries.select("symbolFqn", "tier", "stale", *columns)
    new = g.sym_summaries.where("sym_key % 4 = 0").select("symbolFqn", F.lit("canonical").alias("tier"), *columns)
    return summaries.written(old, new).select("symbolFqn", "tier", "stale")


@query(f"WITH {MEMBERS} SELECT repo, communityId, row_number() OVER (ORDER BY round(0.4 * avg(pr) + 0.3 * avg(fanIn) + 0.2 * avg(CAST(is_public AS DOUBLE)) - avg(CASE WHEN tier = 'canonical' THEN 1.0 ELSE 0.0 END) + 1e-9, 6) DESC, repo, communityId) AS turn FROM members GROUP BY repo, communityId")
def summary_queue(g: Graph) -> DataFrame:
    fresh = g.spark.createDataFrame([], "repo string, communityId int")
    pending = summaries.pending_communities(members(g), fresh).withColumn("score", rounded("score"))
    return summaries.in_turn(pending).select("repo", "communityId", F.col("turn").cast("long").alias("turn"))


@query(f"""WITH {MEMBERS}, f AS (SELECT *, row_number() OVER (PARTITION BY repo, communityId ORDER BY pr DESC, sym_key) <= 10 OR sym_key % 11 = 0 AS focal FROM members)
SELECT id AS symbolFqn, CASE WHEN focal AND (pr >= 0.05 OR is_public OR sym_key % 11 = 0) THEN 'canonical' ELSE 'provisional' END AS tier, concat('About ', id) AS purpose FROM f WHERE focal OR tier IS NULL OR tier <> 'canonical'""")
def summary_run(g: Graph) -> DataFrame:
    """One run with a model that answers at once."""
    rows = stubs(g).withColumn("prompt", F.col("id"))
    return summaries.run(rows, lambda prompt, tier: json.dumps({"purpose": f"About {prompt}"})).select("symbolFqn", "tier", "purpose")
