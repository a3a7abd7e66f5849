"""Registered queries: an operator over the derived graph, and SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from graphloom.checkpoints import cut
from graphloom.fixtures import Graph, with_views
from graphloom.operators import algorithms, leiden, passes, rolling, rules, tools

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    """Registers a function of the graph under its name, with its SQL over the views."""

    def register(f: Callable[[Graph], DataFrame]) -> Callable[[Graph], DataFrame]:
        QUERIES[f.__name__] = lambda spark, sf_dir: f(Graph(spark, sf_dir))
        if sql is not None:
            ORACLES[f.__name__] = with_views(sql)
        return f

    return register


def rounded(c: Column | str, digits: int = 6) -> Column:
    """Rounded away from ties that two engines could break differently."""
    return F.round((F.col(c) if isinstance(c, str) else c) + 1e-9, digits)


def nodes(g: Graph) -> DataFrame:
    return g.sym.select(F.col("sym_key").alias("node"), "repo", "isExported", "communityId")


def edges(g: Graph) -> DataFrame:
    return g.calls.select("src", "dst")


def layer_sql(path: str) -> str:
    ordered = sorted(rules.LAYERS, key=lambda r: -r[2])
    return "CASE " + " ".join(f"WHEN regexp_matches({path}, '{p}') THEN '{layer}'" for p, layer, _ in ordered) + " ELSE 'unknown' END"


def any_sql(path: str, patterns: list[str]) -> str:
    return "(" + " OR ".join(f"regexp_matches({path}, '{p}')" for p in patterns) + ")"


#: The most called symbol, the target of traversals.
TARGET = "target AS (SELECT s.sym_key, s.id FROM sym s JOIN (SELECT dst, count(*) AS n FROM calls GROUP BY dst) c ON c.dst = s.sym_key ORDER BY n DESC, s.id LIMIT 1)"
CALLER = "caller_target AS (SELECT s.sym_key, s.id FROM sym s JOIN (SELECT src, count(*) AS n FROM calls GROUP BY src) c ON c.src = s.sym_key ORDER BY n DESC, s.id LIMIT 1)"


def most_linked(g: Graph, end: str) -> str:
    counts = g.calls.groupBy(F.col(end).alias("sym_key")).agg(F.count("*").alias("n"))
    row = g.sym.join(counts, "sym_key").orderBy(F.desc("n"), "id").select("id").first()
    return row["id"] if row else ""


# ---- look-ups


@query("SELECT id, name, kind, lineStart AS line FROM sym WHERE contains(name, 'al') ORDER BY name, id LIMIT 20")
def find_symbol(g: Graph) -> DataFrame:
    return tools.find_symbol(g.sym, "al").select("id", "name", "kind", F.col("lineStart").alias("line"))


@query("SELECT id, name FROM sym WHERE contains(name, 'e') AND kind = 'function' AND repo = 'main' AND contains(filePath, 'api') ORDER BY name, id LIMIT 100")
def find_symbol_filtered(g: Graph) -> DataFrame:
    return tools.find_symbol(g.sym, "e", kind="function", repo="main", file_path="api", limit=150).select("id", "name")


@query(f"""SELECT s.id, s.kind, m.path AS module, m.loc, {layer_sql('s.filePath')} AS layer, u.tier
FROM sym s LEFT JOIN mod m ON m.repo = s.repo AND m.path = s.filePath LEFT JOIN sym_summaries u ON u.symbolFqn = s.id""")
def symbol_details(g: Graph) -> DataFrame:
    modules = g.mod.select("repo", F.col("path").alias("filePath"), F.col("path").alias("module"), "loc")
    tiers = g.sym_summaries.select(F.col("symbolFqn").alias("id"), "tier")
    rows = g.sym.join(modules, ["repo", "filePath"], "left").join(tiers, "id", "left")
    return rows.select("id", "kind", "module", "loc", passes.architectural_layer(F.col("filePath")).alias("layer"), "tier")


def module_imports(g: Graph) -> DataFrame:
    """Modules import those whose symbols they call."""
    a, b = g.sym.select(F.col("sym_key").alias("src"), F.col("filePath").alias("source")), g.sym.select(F.col("sym_key").alias("dst"), F.col("filePath").alias("target"))
    return g.calls.join(a, "src").join(b, "dst").where("source <> target").select("repo", "source", "target").distinct()


IMPORTS = "imports AS (SELECT DISTINCT c.repo, a.filePath AS source, b.filePath AS target FROM calls c JOIN sym a ON a.sym_key = c.src JOIN sym b ON b.sym_key = c.dst WHERE a.filePath <> b.filePath)"


@query(f"""WITH {IMPORTS}, first AS (SELECT path FROM mod WHERE repo = 'main' AND starts_with(path, 'src/') ORDER BY path LIMIT 50)
SELECT f.path, i.target FROM first f LEFT JOIN imports i ON i.repo = 'main' AND i.source = f.path""")
def module_graph(g: Graph) -> DataFrame:
    return tools.module_graph(g.mod, module_imports(g), "main", "src/")


@query("SELECT repo, name, protocol FROM ext_services ORDER BY repo, name")
def list_services(g: Graph) -> DataFrame:
    return g.ext_services.select("repo", "name", "protocol").orderBy("repo", "name")


@query("""WITH callers AS (SELECT DISTINCT c.service AS name, concat_ws('/', s.repo, s.filePath) AS caller FROM calls_service c JOIN sym s ON s.sym_key = c.sym_key)
SELECT e.name, e.protocol, coalesce(string_agg(caller, ',' ORDER BY caller), '') AS callers, count(caller) AS n_callers
FROM ext_services e LEFT JOIN callers USING (name) GROUP BY e.name, e.protocol""")
def service_topology(g: Graph) -> DataFrame:
    calling = g.calls_service.select("sym_key", "service").join(g.sym, "sym_key").select("repo", F.col("filePath").alias("module"), "service")
    return tools.service_topology(g.ext_services, calling.limit(0), calling)


@query("SELECT s.id, string_agg(DISTINCT g.doc_path, ',' ORDER BY g.doc_path) AS docs FROM governs g JOIN sym s ON s.sym_key = g.sym_key GROUP BY s.id")
def related_docs(g: Graph) -> DataFrame:
    return tools.related_docs(g.governs.join(g.sym.select("sym_key", "id"), "sym_key"), g.docs, ["id"])


@query("SELECT g.doc_path, count(*) AS n, min(s.id) AS first_symbol FROM governs g JOIN sym s ON s.sym_key = g.sym_key GROUP BY g.doc_path")
def symbols_in_doc(g: Graph) -> DataFrame:
    return g.governs.join(g.sym, "sym_key").groupBy("doc_path").agg(F.count("*").alias("n"), F.min("id").alias("first_symbol"))


@query("SELECT path, type, status FROM docs WHERE starts_with(path, 'services/src1') AND NOT starts_with(path, 'concepts/')")
def docs_list(g: Graph) -> DataFrame:
    return g.docs.where(F.col("path").startswith("services/src1") & ~F.col("path").startswith("concepts/")).select("path", "type", "status")


@query("SELECT 'Symbol' AS label, count(*) AS n FROM sym UNION ALL SELECT 'Module', count(*) FROM mod UNION ALL SELECT 'Document', count(*) FROM docs")
def diagnostics_counts(g: Graph) -> DataFrame:
    return tools.diagnostics({"Symbol": g.sym, "Module": g.mod, "Document": g.docs})


@query(f"""WITH ins AS (SELECT DISTINCT c.dst AS k, s.name FROM calls c JOIN sym s ON s.sym_key = c.src),
i AS (SELECT k, string_agg(name, ',' ORDER BY name) AS callers FROM (SELECT *, row_number() OVER (PARTITION BY k ORDER BY name) AS r FROM ins) WHERE r <= 5 GROUP BY k),
outs AS (SELECT DISTINCT c.src AS k, s.name FROM calls c JOIN sym s ON s.sym_key = c.dst),
o AS (SELECT k, string_agg(name, ',' ORDER BY name) AS callees FROM (SELECT *, row_number() OVER (PARTITION BY k ORDER BY name) AS r FROM outs) WHERE r <= 5 GROUP BY k),
d AS (SELECT sym_key AS k, string_agg(DISTINCT doc_path, ',' ORDER BY doc_path) AS docs FROM governs GROUP BY sym_key)
SELECT s.id, {layer_sql('s.filePath')} AS layer, s.communityId, i.callers, o.callees, d.docs, u.symbolFqn IS NOT NULL AS "summaryAvailable"
FROM sym s LEFT JOIN i ON i.k = s.sym_key LEFT JOIN o ON o.k = s.sym_key LEFT JOIN d ON d.k = s.sym_key LEFT JOIN sym_summaries u ON u.symbolFqn = s.id""")
def symbol_context(g: Graph) -> DataFrame:
    out = tools.symbol_context(g.sym, edges(g), g.sym_summaries, g.governs, passes.architectural_layer(F.col("filePath")))
    return out.select("id", "layer", "communityId", "callers", "callees", "docs", "summaryAvailable")


FAN = "fan AS (SELECT s.sym_key, coalesce(i.n, 0) AS fanIn, coalesce(o.n, 0) AS fanOut FROM sym s LEFT JOIN (SELECT dst, count(*) AS n FROM calls GROUP BY dst) i ON i.dst = s.sym_key LEFT JOIN (SELECT src, count(*) AS n FROM calls GROUP BY src) o ON o.src = s.sym_key)"


@query(f"""WITH {FAN}, t AS (SELECT s.communityId, s.id, f.fanIn, row_number() OVER (PARTITION BY s.communityId ORDER BY f.fanIn DESC, s.sym_key) AS pos FROM sym s JOIN fan f USING (sym_key))
SELECT t.communityId, t.id, t.fanIn, u.tier FROM t LEFT JOIN sym_summaries u ON u.symbolFqn = t.id WHERE t.pos <= 10""")
def community_context(g: Graph) -> DataFrame:
    fan = algorithms.degree(nodes(g), edges(g)).select(F.col("node").alias("sym_key"), "fanIn")
    top = tools.top_symbols(g.sym.join(fan, "sym_key"), "fanIn", "communityId")
    return top.join(g.sym_summaries.select(F.col("symbolFqn").alias("id"), "tier"), "id", "left").select("communityId", "id", "fanIn", "tier")


@query("SELECT conv_id, turn, role FROM conversations ORDER BY conv_id DESC, turn DESC, role LIMIT 50")
def pass_run_history(g: Graph) -> DataFrame:
    return g.conversations.orderBy(F.desc("conv_id"), F.desc("turn"), "role").limit(50).select("conv_id", "turn", "role")


# ---- traversal

REACH = """r AS (SELECT {b} AS node, 1 AS depth FROM calls JOIN {t} t ON calls.{a} = t.sym_key
UNION SELECT c.{b}, r.depth + 1 FROM r JOIN calls c ON c.{a} = r.node WHERE r.depth < 3)
SELECT s.id, s.name, min(r.depth) AS depth FROM r JOIN sym s ON s.sym_key = r.node
WHERE s.sym_key NOT IN (SELECT sym_key FROM {t}) GROUP BY s.id, s.name"""


@query(f"WITH RECURSIVE {TARGET}, " + REACH.format(a="dst", b="src", t="target"))
def callers_depth3(g: Graph) -> DataFrame:
    return tools.related(g.sym, edges(g), most_linked(g, "dst"), 3).select("id", "name", "depth")


@query(f"WITH RECURSIVE {CALLER}, " + REACH.format(a="src", b="dst", t="caller_target"))
def callees_depth3(g: Graph) -> DataFrame:
    return tools.related(g.sym, edges(g), most_linked(g, "src"), 3, callers=False).select("id", "name", "depth")


@query(f"""WITH RECURSIVE {TARGET}, r AS (SELECT src AS node, 1 AS depth FROM calls JOIN target t ON calls.dst = t.sym_key
UNION SELECT c.src, r.depth + 1 FROM r JOIN calls c ON c.dst = r.node WHERE r.depth < 3)
SELECT t.id, (SELECT count(DISTINCT node) FROM r WHERE node <> t.sym_key) AS callers,
coalesce((SELECT string_agg(DISTINCT errorType, ',' ORDER BY errorType) FROM throws_direct d WHERE d.sym_key = t.sym_key), '') AS thrown FROM target t""")
def impact_of(g: Graph) -> DataFrame:
    return tools.impact_of(g.sym, edges(g), g.throws_direct, most_linked(g, "dst"))


@query("""WITH RECURSIVE r AS (SELECT DISTINCT c.src AS sym_key, t.errorType, 1 AS depth FROM throws_direct t JOIN calls c ON c.dst = t.sym_key
UNION SELECT c.src, r.errorType, r.depth + 1 FROM r JOIN calls c ON c.dst = r.sym_key WHERE r.depth < 5)
SELECT DISTINCT sym_key, errorType FROM r WHERE NOT EXISTS (SELECT 1 FROM catches k WHERE k.sym_key = r.sym_key AND k.errorType = r.errorType)
AND NOT EXISTS (SELECT 1 FROM throws_direct k WHERE k.sym_key = r.sym_key AND k.errorType = r.errorType)""")
def throws_propagation(g: Graph) -> DataFrame:
    return passes.throws_propagation(edges(g), g.throws_direct.select("sym_key", "errorType"), g.catches.select("sym_key", "errorType"))


@query(f"""WITH hops AS (SELECT src, dst FROM calls UNION SELECT a.src, b.dst FROM calls a JOIN calls b ON b.src = a.dst),
pairs AS (SELECT DISTINCT t.sym_key AS test_key, t.filePath AS testFile, p.sym_key AS prod_key, p.filePath AS f, p.name AS n
FROM hops h JOIN sym t ON t.sym_key = h.src JOIN sym p ON p.sym_key = h.dst WHERE {any_sql('t.filePath', rules.TESTS)} AND NOT {any_sql('p.filePath', rules.TESTS)})
SELECT test_key, prod_key, testFile, CASE WHEN {any_sql('testFile', rules.E2E)} THEN 'e2e' WHEN {any_sql('testFile', rules.INTEGRATION)} THEN 'integration' ELSE 'unit' END AS "coverageKind"
FROM (SELECT *, row_number() OVER (PARTITION BY test_key ORDER BY f, n, prod_key) AS r FROM pairs) WHERE r <= 10""")
def test_asserts(g: Graph) -> DataFrame:
    return passes.test_asserts(g.sym, edges(g))


@query("""WITH RECURSIVE r AS (SELECT sym_key AS node, 0 AS depth FROM sym WHERE isExported AND sym_key NOT IN (SELECT dst FROM calls)
UNION SELECT c.dst, r.depth + 1 FROM r JOIN calls c ON c.src = r.node WHERE r.depth < 40),
m AS (SELECT node, min(depth) AS depth FROM r GROUP BY node)
SELECT s.sym_key, coalesce(m.depth, -1) AS "depthFromEntry", m.depth IS NOT NULL AS "reachableFromEntry" FROM sym s LEFT JOIN m ON m.node = s.sym_key""")
def reachability(g: Graph) -> DataFrame:
    return algorithms.reachability(nodes(g), edges(g)).withColumnRenamed("node", "sym_key")


@query(f"""WITH {TARGET}, {FAN} SELECT s.id, f.fanIn FROM (SELECT DISTINCT src FROM calls JOIN target t ON calls.dst = t.sym_key) c
JOIN sym s ON s.sym_key = c.src JOIN fan f ON f.sym_key = c.src ORDER BY f.fanIn DESC, s.id LIMIT 20""")
def expand_callers_top20(g: Graph) -> DataFrame:
    fan = algorithms.degree(nodes(g), edges(g)).select(F.col("node").alias("sym_key"), "fanIn")
    target = tools.named(g.sym, most_linked(g, "dst")).select(F.col("sym_key").alias("dst"))
    callers = g.calls.join(target, "dst").select(F.col("src").alias("sym_key")).distinct()
    return callers.join(g.sym, "sym_key").join(fan, "sym_key").orderBy(F.desc("fanIn"), "id").limit(20).select("id", "fanIn")


@query("""SELECT a.id AS caller, b.id AS callee FROM calls c JOIN sym a ON a.sym_key = c.src JOIN sym b ON b.sym_key = c.dst
WHERE a.communityId IS NULL OR b.communityId IS NULL OR a.communityId <> b.communityId""")
def cross_community_callees(g: Graph) -> DataFrame:
    a = g.sym.select(F.col("sym_key").alias("src"), F.col("id").alias("caller"), F.col("communityId").alias("ca"))
    b = g.sym.select(F.col("sym_key").alias("dst"), F.col("id").alias("callee"), F.col("communityId").alias("cb"))
    return edges(g).join(a, "src").join(b, "dst").where("ca IS NULL OR cb IS NULL OR ca <> cb").select("caller", "callee")


# ---- metrics


@query(f"WITH {FAN} SELECT sym_key, fanIn, fanOut FROM fan")
def degree(g: Graph) -> DataFrame:
    return algorithms.degree(nodes(g), edges(g)).select(F.col("node").alias("sym_key"), "fanIn", "fanOut")


@query(f"WITH {FAN} SELECT s.id, s.name, f.fanIn, f.fanOut FROM fan f JOIN sym s USING (sym_key) ORDER BY f.fanIn DESC, s.id LIMIT 20")
def most_central(g: Graph) -> DataFrame:
    fan = algorithms.degree(nodes(g), edges(g)).select(F.col("node").alias("sym_key"), "fanIn", "fanOut")
    return g.sym.join(fan, "sym_key").orderBy(F.desc("fanIn"), "id").limit(20).select("id", "name", "fanIn", "fanOut")


def pagerank_sql(rounds: int = 20) -> str:
    parts = ["d AS (SELECT src, count(*) AS o FROM calls GROUP BY src)", "p0 AS (SELECT sym_key, 1.0 - 0.85 AS pr FROM sym)"]
    for k in range(1, rounds + 1):
        parts.append(f"p{k} AS (SELECT s.sym_key, (1.0 - 0.85) + 0.85 * coalesce(x.s, 0.0) AS pr FROM sym s LEFT JOIN (SELECT c.dst, sum(CAST(p.pr AS DOUBLE) / d.o) AS s FROM calls c JOIN d USING (src) JOIN p{k - 1} p ON p.sym_key = c.src GROUP BY c.dst) x ON x.dst = s.sym_key)")
    return "WITH " + ",\n".join(parts) + f"\n, pr AS (SELECT sym_key, CAST(pr AS DOUBLE) AS pr FROM p{rounds})\n"


def ranks(g: Graph) -> DataFrame:
    return algorithms.pagerank(nodes(g).select("node"), edges(g)).select(F.col("node").alias("sym_key"), "pageRank")


@query(pagerank_sql() + 'SELECT sym_key, round(pr + 1e-9, 6) AS "pageRank" FROM pr')
def pagerank(g: Graph) -> DataFrame:
    return ranks(g).select("sym_key", rounded("pageRank").alias("pageRank"))


@query(pagerank_sql() + 'SELECT s.id, round(pr + 1e-9, 6) AS "pageRank" FROM pr JOIN sym s USING (sym_key) ORDER BY round(pr + 1e-9, 6) DESC, s.id LIMIT 20')
def pagerank_top20(g: Graph) -> DataFrame:
    rows = ranks(g).join(g.sym, "sym_key").select("id", rounded("pageRank").alias("pageRank"))
    return rows.orderBy(F.desc("pageRank"), "id").limit(20)


@query("SELECT repo, count(*) AS cur, count(*) FILTER (WHERE src % 20 <> 0) AS last, abs(count(*) - count(*) FILTER (WHERE src % 20 <> 0)) / greatest(count(*) FILTER (WHERE src % 20 <> 0), 1) >= 0.05 AS run FROM calls GROUP BY repo")
def edge_delta_gate(g: Graph) -> DataFrame:
    rows = g.calls.groupBy("repo").agg(F.count("*").alias("cur"), F.count_if(F.col("src") % 20 != 0).alias("last"))
    return rows.withColumn("run", algorithms.edge_delta(F.col("cur"), F.col("last")))


@query("""WITH RECURSIVE u AS (SELECT src AS a, dst AS b FROM calls UNION SELECT dst, src FROM calls),
r AS (SELECT sym_key AS node, sym_key AS seen FROM sym UNION SELECT r.node, u.b FROM r JOIN u ON u.a = r.seen)
SELECT node AS sym_key, min(seen) AS component FROM r GROUP BY node""")
def components(g: Graph) -> DataFrame:
    return algorithms.components(nodes(g), edges(g)).select(F.col("node").alias("sym_key"), "component")


ROLES = """roles AS (SELECT s.sym_key, s.repo, s.communityId, coalesce(x.intra, 0) AS intra, coalesce(x.inter, 0) AS inter,
CASE WHEN x.inter > 0.5 * (x.intra + x.inter) THEN 'bridge' WHEN x.inter > 0.15 * (x.intra + x.inter) THEN 'boundary' ELSE 'core' END AS role
FROM sym s LEFT JOIN (SELECT c.src, count(*) FILTER (WHERE a.communityId = b.communityId) AS intra, count(*) FILTER (WHERE a.communityId <> b.communityId) AS inter
FROM calls c JOIN sym a ON a.sym_key = c.src JOIN sym b ON b.sym_key = c.dst GROUP BY c.src) x ON x.src = s.sym_key)"""


@query(f"WITH {ROLES} SELECT sym_key, intra, inter, role FROM roles")
def community_roles(g: Graph) -> DataFrame:
    return algorithms.roles(nodes(g), edges(g)).select(F.col("node").alias("sym_key"), "intra", "inter", "role")


@query(f"""WITH {ROLES}, i AS (SELECT a.repo, a.communityId, count(*) AS n FROM calls c JOIN sym a ON a.sym_key = c.src JOIN sym b ON b.sym_key = c.dst WHERE a.communityId = b.communityId GROUP BY 1, 2)
SELECT r.repo, r.communityId, count(*) AS size, count(*) FILTER (WHERE role = 'core') AS "coreCount", count(*) FILTER (WHERE role = 'boundary') AS "boundaryCount", count(*) FILTER (WHERE role = 'bridge') AS "bridgeCount",
round(CASE WHEN count(*) < 2 THEN 0.0 ELSE coalesce(max(i.n), 0) / (count(*) * (count(*) - 1)) END + 1e-9, 6) AS cohesion
FROM roles r LEFT JOIN i ON i.repo = r.repo AND i.communityId = r.communityId GROUP BY r.repo, r.communityId""")
def community_nodes(g: Graph) -> DataFrame:
    rows = algorithms.community_nodes(algorithms.roles(nodes(g), edges(g)), edges(g))
    return rows.withColumn("cohesion", rounded("cohesion"))


@query()
def betweenness(g: Graph) -> DataFrame:
    return algorithms.betweenness(nodes(g), edges(g), samples=500).select(F.col("node").alias("sym_key"), rounded("betweenness").alias("betweenness"))


@query()
def communities(g: Graph) -> DataFrame:
    return leiden.leiden(nodes(g), edges(g)).select(F.col("node").alias("sym_key"), "community")


@query("""WITH RECURSIVE pair AS (SELECT src AS u, dst AS v FROM calls WHERE src <> dst UNION SELECT dst, src FROM calls WHERE src <> dst),
r AS (SELECT sym_key AS node, sym_key AS reached FROM sym UNION SELECT r.node, pair.v FROM r JOIN pair ON pair.u = r.reached),
c AS (SELECT node, min(reached) AS component FROM r GROUP BY node)
SELECT component, count(*) AS symbols, CAST(0 AS BIGINT) AS "leaving", CAST(0 AS BIGINT) AS "apart", CAST(0 AS BIGINT) AS misnamed, true AS "dense" FROM c GROUP BY component""")
def community_invariants(g: Graph) -> DataFrame:
    """What holds for communities, for each component: all its symbols are in one, none leaves the component, none
    is in several parts, each is called by its least symbol; and their modularity is no less than that of components."""
    of = cut(leiden.leiden(nodes(g), edges(g)))
    label = lambda a, b: of.select(F.col("node").alias(a), F.col("community").alias(b))
    inner = edges(g).join(label("src", "a"), "src").join(label("dst", "b"), "dst").where("a = b").select("src", "dst")
    parts = algorithms.components(of.select("node"), inner).withColumnRenamed("component", "part")
    whole = cut(algorithms.components(nodes(g), edges(g)))
    rows = whole.join(of, "node", "left").join(parts, "node", "left")
    home = whole.select(F.col("node").alias("community"), F.col("component").alias("home"))
    rows = rows.join(home, "community", "left")
    graph = edges(g).where("src <> dst")
    graph = graph.union(graph.select("dst", "src")).groupBy("src", "dst").agg(F.count("*").cast("double").alias("w"))
    dense = algorithms.modularity(graph, of) >= algorithms.modularity(graph, whole.withColumnRenamed("component", "community"))
    wrong = lambda c: F.count_if(~F.coalesce(c, F.lit(False)))
    least = F.min("node").over(Window.partitionBy("community"))
    rows = rows.withColumn("least", least)
    return rows.groupBy("component").agg(F.count("community").alias("symbols"), wrong(F.col("home") == F.col("component")).alias("leaving"), wrong(F.col("part") == F.col("community")).alias("apart"), wrong(F.col("least") == F.col("community")).alias("misnamed")).withColumn("dense", F.lit(dense))


# ---- passes


@query("SELECT doc_id, sha256(array_to_string(string_split(text, chr(10))[(doc_id % 3 + 1):(doc_id % 3 + 3)], chr(10))) AS hash FROM documents")
def content_hash(g: Graph) -> DataFrame:
    start = (F.col("doc_id") % 3 + 1).cast("int")
    rows = g.documents.withColumns({"lineStart": start, "lineEnd": start + 2})
    return rows.select("doc_id", passes.content_hash(rows).alias("hash"))


@query("SELECT doc_id FROM documents d WHERE NOT EXISTS (SELECT 1 FROM documents s WHERE s.doc_id % 4 <> 0 AND s.doc_id = d.doc_id AND sha256(s.text) = sha256(d.text))")
def changed_files(g: Graph) -> DataFrame:
    files = g.documents.select("doc_id", F.lit("r").alias("repo"), F.col("doc_id").cast("string").alias("path"), F.sha2("text", 256).alias("hash"))
    return passes.changed_files(files, files.where("doc_id % 4 <> 0").select("repo", "path", "hash")).select("doc_id")


NOW = "TIMESTAMP '2024-01-31 00:00:00'"


VOLATILITY = f"""SELECT repo, filePath, round(count(*) FILTER (WHERE ts >= {NOW} - INTERVAL 14 DAY) / 14.0 * 30 + 1e-9, 3) AS "changeFrequency",
count(DISTINCT CASE WHEN ts >= {NOW} - INTERVAL 7 DAY THEN lower(email) END) AS "authorCount", strftime(max(ts), '%Y-%m-%d %H:%M:%S') AS "lastModified",
CAST(greatest(0, floor((epoch({NOW}) - floor(epoch(min(ts)))) / 86400)) AS INT) AS "gitAge" FROM commits GROUP BY repo, filePath"""


@query(VOLATILITY)
def git_volatility(g: Graph) -> DataFrame:
    now = F.expr("TIMESTAMP_NTZ '2024-01-31 00:00:00'")
    rows = passes.git_volatility(g.commits, now, 14, 7)
    return rows.withColumn("lastModified", F.date_format("lastModified", "yyyy-MM-dd HH:mm:ss"))


@query(VOLATILITY)
def volatility_rolled(g: Graph) -> DataFrame:
    """The same from days that were counted in two batches and merged."""
    late = F.col("ts") >= F.expr("TIMESTAMP_NTZ '2024-01-16 12:00:00'")
    days = rolling.merged(rolling.daily(g.commits.where(late)), rolling.daily(g.commits.where(~late)))
    rows = rolling.volatility(days, F.expr("DATE '2024-01-31'"), 14, 7)
    return rows.withColumn("lastModified", F.date_format("lastModified", "yyyy-MM-dd HH:mm:ss"))


PUBLIC = """public AS (SELECT s.*, coalesce(s.isExported, false) AND NOT coalesce(m.isBarrel, false) AND NOT starts_with(s.name, '_') AND NOT contains(coalesce(s.docstring, ''), '@internal') AS is_public
FROM sym s LEFT JOIN mod m ON m.repo = s.repo AND m.path = s.filePath)"""


@query(f'WITH {PUBLIC} SELECT sym_key, is_public AS "isPublicApi" FROM public')
def public_api(g: Graph) -> DataFrame:
    return passes.public_api(g.sym, g.mod).select("sym_key", "isPublicApi")


@query(f"WITH {PUBLIC} SELECT repo, count(*) AS symbols, count(*) FILTER (WHERE isExported) AS exported, count(*) FILTER (WHERE is_public) AS public, count(*) FILTER (WHERE starts_with(name, '_')) AS underscored FROM public GROUP BY repo")
def public_api_counters(g: Graph) -> DataFrame:
    rows = passes.public_api(g.sym, g.mod).groupBy("repo")
    return rows.agg(F.count("*").alias("symbols"), F.count_if("isExported").alias("exported"), F.count_if("isPublicApi").alias("public"), F.count_if(F.col("name").startswith("_")).alias("underscored"))


@query(f"SELECT sym_key, {layer_sql('filePath')} AS layer FROM sym")
def architectural_layer(g: Graph) -> DataFrame:
    return g.sym.select("sym_key", passes.architectural_layer(F.col("filePath")).alias("layer"))


@query(f"SELECT {layer_sql('filePath')} AS layer, count(*) AS n FROM sym GROUP BY 1")
def layer_histogram(g: Graph) -> DataFrame:
    return g.sym.groupBy(passes.architectural_layer(F.col("filePath")).alias("layer")).agg(F.count("*").alias("n"))


#: Declared contexts for the query: id, pattern, order.
CONTEXTS = [("billing", "src/api/", 0), ("identity", "src/services", 1), ("edge", "src/api/brand-11.js", 2), ("core", "src/", 3)]


@query("""WITH c(id, p, o) AS (VALUES ('billing', 'src/api/', 0), ('identity', 'src/services', 1), ('edge', 'src/api/brand-11.js', 2), ('core', 'src/', 3)),
h AS (SELECT m.repo, m.path, c.id, c.o FROM mod m JOIN c ON CASE WHEN c.p LIKE '%/' THEN starts_with(m.path, c.p) ELSE m.path = c.p OR starts_with(m.path, concat(c.p, '/')) END)
SELECT m.repo, m.path, arg_min(h.id, h.o) AS "contextId", count(DISTINCT h.id) > 1 AS ambiguous FROM mod m LEFT JOIN h USING (repo, path) GROUP BY m.repo, m.path""")
def bounded_context(g: Graph) -> DataFrame:
    contexts = g.spark.createDataFrame(CONTEXTS, "contextId string, pattern string, declarationOrder int")
    return passes.bounded_context(g.mod.select("repo", "path"), contexts)


@query("SELECT DISTINCT d.path AS doc_path, s.sym_key FROM docs d JOIN sym s ON s.sym_key = d.sym_key + 1 JOIN sym t ON t.filePath = s.filePath AND t.name = s.name AND t.sym_key = s.sym_key WHERE d.type = 'adr'")
def governs_edges(g: Graph) -> DataFrame:
    named = g.sym.select((F.col("sym_key") - 1).alias("doc_id"), F.when(F.col("sym_key") % 2 == 0, F.col("repo")).alias("repo"), "filePath", "name")
    declared = g.docs.where("type = 'adr'").join(named, "doc_id").select(F.col("path").alias("doc_path"), "repo", "filePath", "name")
    return passes.governs(declared, g.docs, g.sym)


@query("SELECT u.symbolFqn FROM sym_summaries u JOIN sym s ON s.id = u.symbolFqn WHERE sha256(s.name) <> CASE WHEN u.stale THEN 'old' ELSE sha256(s.name) END")
def stale_summaries(g: Graph) -> DataFrame:
    symbols = g.sym.withColumn("hash", F.sha2("name", 256))
    made = g.sym_summaries.join(symbols.select(F.col("id").alias("symbolFqn"), F.col("hash").alias("h")).hint("merge"), "symbolFqn").withColumn("contentHash", F.when(F.col("stale"), "old").otherwise(F.col("h")))
    return passes.stale(symbols, made.select("symbolFqn", "contentHash")).select("symbolFqn")


@query(f"SELECT path, CASE WHEN {any_sql('path', rules.E2E)} THEN 'e2e' WHEN {any_sql('path', rules.INTEGRATION)} THEN 'integration' ELSE 'unit' END AS kind FROM (SELECT replace(path, 'src/misc', CASE WHEN length(path) % 2 = 0 THEN 'e2e' ELSE 'integration' END) AS path FROM mod)")
def coverage_kind(g: Graph) -> DataFrame:
    path = F.replace("path", F.lit("src/misc"), F.when(F.length("path") % 2 == 0, "e2e").otherwise("integration"))
    return g.mod.select(path.alias("path")).select("path", passes.coverage_kind(F.col("path")).alias("kind"))
