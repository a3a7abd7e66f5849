"""Registered queries on extraction, documents, vectors, summaries and state."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphloom.fixtures import Graph
from graphloom.functions import frontmatter, text
from graphloom.checkpoints import checkpoint_folder
from graphloom.operators import algorithms, concepts, documents, extraction, parsing, passes, rules, search_index, summaries, tools, upsert
from graphloom.plans.catalogue import FAN, PUBLIC, ROLES, edges, nodes, query, rounded
from graphloom.streaming import jobs

# ---- extraction

#: Callees that stand in for those of a symbol's body, by key.
CALLEES = ["fs.readFile", "setTimeout", "axios.get", "db.query", "document.write", "spawn", "ddb.update", "compute"]
CALLEE_SQL = "CASE sym_key % 8 " + " ".join(f"WHEN {i} THEN '{c}'" for i, c in enumerate(CALLEES)) + " END"
EFFECT_SQL = "CASE " + " ".join(f"WHEN regexp_matches(callee, '{p}') THEN '{k}'" for p, k in rules.EFFECTS) + " END"


def by_key(values: list[str]) -> Column:
    return F.get(F.array(*[F.lit(v) for v in values]), (F.col("sym_key") % len(values)).cast("int"))


@query(f"""SELECT sym_key, callee, effect, coalesce(effect IN ({", ".join(f"'{k}'" for k in rules.IO_EFFECTS)}), false) AS "hasIO"
FROM (SELECT sym_key, callee, {EFFECT_SQL} AS effect FROM (SELECT sym_key, {CALLEE_SQL} AS callee FROM sym))""")
def effect_kinds(g: Graph) -> DataFrame:
    rows = g.sym.select("sym_key", by_key(CALLEES).alias("callee"))
    rows = rows.withColumn("effect", extraction.effect(F.col("callee")))
    return rows.withColumn("hasIO", F.coalesce(extraction.has_io(F.array("effect")), F.lit(False)))


BODY = "concat('const a = config.get(''', name, '''); process.env.', upper(kind), '; process.env[''', repo, ''']; config.get(''', name, ''')')"


def bodies(g: Graph) -> DataFrame:
    parts = ["const a = config.get('", F.col("name"), "'); process.env.", F.upper("kind"), "; process.env['", F.col("repo"), "']; config.get('", F.col("name"), "')"]
    return g.sym.withColumn("body", F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts]))


@query("SELECT sym_key, name AS config_keys, concat(upper(kind), ',', repo) AS env_keys FROM sym")
def config_keys(g: Graph) -> DataFrame:
    body = F.col("body")
    return bodies(g).select("sym_key", F.array_join(extraction.config_keys(body), ",").alias("config_keys"), F.array_join(extraction.env_keys(body), ",").alias("env_keys"))


FLAG_METHODS = ["variation", "isEnabled", "isOn", "isActive", "plain"]


@query("""SELECT sym_key, m AS method, concat('flag_', kind) AS flag, CASE m WHEN 'variation' THEN 'launchdarkly' WHEN 'isEnabled' THEN 'unleash' WHEN 'isOn' THEN 'growthbook' ELSE 'custom' END AS provider
FROM (SELECT *, CASE sym_key % 5 WHEN 0 THEN 'variation' WHEN 1 THEN 'isEnabled' WHEN 2 THEN 'isOn' WHEN 3 THEN 'isActive' END AS m FROM sym) WHERE m IS NOT NULL""")
def flag_detection(g: Graph) -> DataFrame:
    body = F.concat(F.lit("client."), by_key(FLAG_METHODS), F.lit("('flag_"), F.col("kind"), F.lit("', false)"))
    rows = g.sym.select("sym_key", F.inline(extraction.flag_checks(body)))
    return rows.withColumn("provider", extraction.flag_provider(F.col("method")))


PACKAGES = [p for p, _, _ in rules.SDK_SERVICES]


@query("WITH v AS (SELECT * FROM (VALUES " + ", ".join(f"({i}, '{s}', '{k}')" for i, (_, s, k) in enumerate(rules.SDK_SERVICES)) + f") AS t(k, service, protocol)) SELECT v.service, v.protocol, count(*) AS importers FROM sym JOIN v ON v.k = sym_key % {len(PACKAGES) + 4} GROUP BY 1, 2")
def sdk_services(g: Graph) -> DataFrame:
    imported = g.sym.select(by_key([*[p + "/lib/x" if not p.startswith("@") else p for p in PACKAGES], "a", "b", "c", "d"]).alias("spec"))
    return parsing.services_of(imported, parsing.service_table(g.spark))


@query("SELECT sym_key, 'E' || (communityId) AS errorType FROM sym WHERE sym_key % 7 = 0 UNION SELECT sym_key, 'Error' FROM sym WHERE sym_key % 14 = 0")
def throws_edges(g: Graph) -> DataFrame:
    body = F.concat(F.lit("throw new errors.E"), F.col("communityId").cast("string"), F.lit("('x');"), F.when(F.col("sym_key") % 14 == 0, " throw ;").otherwise(""))
    body = F.when(F.col("sym_key") % 7 == 0, body).otherwise("return rethrown;")
    rows = g.sym.select("sym_key", F.explode(extraction.thrown(body)).alias("errorType"))
    return upsert.edges_once(rows, ["sym_key", "errorType"])


@query("SELECT s.sym_key, c.line FROM sym s JOIN (SELECT repo, filePath, lineStart - CAST(sym_key % 4 AS INT) AS line FROM sym WHERE docstring IS NOT NULL) c ON c.repo = s.repo AND c.filePath = s.filePath AND (s.lineStart = c.line OR s.lineStart = c.line + 1)")
def annotated_by(g: Graph) -> DataFrame:
    comments = g.sym.where("docstring IS NOT NULL").select("repo", "filePath", (F.col("lineStart") - (F.col("sym_key") % 4).cast("int")).alias("lineEnd"))
    return parsing.annotated(g.sym.drop("lineEnd"), comments).select("sym_key", F.col("lineEnd").alias("line"))


@query("SELECT r.k AS ref, s.sym_key FROM (SELECT sym_key AS k, repo, filePath, CASE WHEN sym_key % 3 = 0 THEN 'nothing' ELSE name END AS name FROM sym) r JOIN sym s USING (repo, filePath, name)")
def resolves_to(g: Graph) -> DataFrame:
    refs = g.sym.select(F.col("sym_key").alias("ref"), "repo", "filePath", F.when(F.col("sym_key") % 3 == 0, "nothing").otherwise(F.col("name")).alias("name"))
    return parsing.resolved_names(refs, g.sym.select("repo", "filePath", "name", "sym_key")).select("ref", "sym_key")


@query("WITH sc AS (SELECT repo, filePath, CAST(lineStart // 10 AS INT) AS scope, CASE WHEN lineStart > 10 THEN CAST(lineStart // 20 AS INT) END AS parent FROM sym) SELECT a.repo, a.filePath, a.scope, b.scope AS parent_scope FROM sc a JOIN sc b ON a.repo = b.repo AND a.filePath = b.filePath AND a.parent = b.scope")
def scope_parents(g: Graph) -> DataFrame:
    scopes = g.sym.select("repo", "filePath", F.expr("lineStart div 10").cast("int").alias("scope"), F.when(F.col("lineStart") > 10, F.expr("lineStart div 20")).cast("int").alias("parent_scope"))
    return parsing.scope_edges(scopes, "scope", "parent_scope")


@query("""WITH sites AS (SELECT a.repo, a.filePath, a.lineStart + 3 AS line, b.name AS callee FROM calls c JOIN sym a ON a.sym_key = c.src JOIN sym b ON b.sym_key = c.dst),
imp AS (SELECT DISTINCT a.repo, a.filePath, b.name, b.filePath AS target FROM calls c JOIN sym a ON a.sym_key = c.src JOIN sym b ON b.sym_key = c.dst WHERE b.sym_key % 2 = 0),
i AS (SELECT x.*, s.id AS src FROM sites x JOIN sym s ON s.repo = x.repo AND s.filePath = x.filePath AND x.line BETWEEN s.lineStart AND s.lineEnd)
SELECT DISTINCT i.src, coalesce(o.id, f.id) AS dst, CASE WHEN o.id IS NOT NULL THEN 'exact' ELSE 'inferred' END AS confidence
FROM i LEFT JOIN sym o ON o.repo = i.repo AND o.filePath = i.filePath AND o.name = i.callee
LEFT JOIN imp m ON m.repo = i.repo AND m.filePath = i.filePath AND m.name = i.callee LEFT JOIN sym f ON f.repo = m.repo AND f.filePath = m.target AND f.name = m.name
WHERE coalesce(o.id, f.id) IS NOT NULL AND coalesce(o.id, f.id) <> i.src""")
def resolve_calls(g: Graph) -> DataFrame:
    a = g.sym.select(F.col("sym_key").alias("src"), "repo", "filePath", "lineStart")
    b = g.sym.select(F.col("sym_key").alias("dst"), F.col("name").alias("callee"), F.col("filePath").alias("target"))
    both = edges(g).join(a, "src").join(b, "dst")
    sites = both.select("repo", "filePath", (F.col("lineStart") + 3).alias("line"), "callee")
    imported = both.where("dst % 2 = 0").select("repo", "filePath", F.col("callee").alias("name"), "target").distinct()
    return extraction.resolve_calls(sites, g.sym, imported)


@query("SELECT m.repo, m.path, s.sym_key, s.name AS \"exportName\" FROM mod m JOIN sym s ON s.repo = m.repo AND s.filePath = m.path WHERE s.isExported")
def exports_edges(g: Graph) -> DataFrame:
    return parsing.exported_symbols(g.sym, g.mod.select("repo", "path")).select("repo", "path", "sym_key", "exportName")


@query("SELECT DISTINCT repo, concat(regexp_replace(filePath, '/[^/]*$', ''), '/lib-', communityId, '.js') AS path FROM sym WHERE concat(regexp_replace(filePath, '/[^/]*$', ''), '/lib-', communityId, '.js') NOT IN (SELECT path FROM mod)")
def import_stubs(g: Graph) -> DataFrame:
    spec = F.concat(F.lit("./lib-"), F.col("communityId").cast("string"), F.lit(".js"))
    imports = g.sym.select("repo", text.joined_path(F.col("filePath"), spec).alias("target"))
    return upsert.stubs(g.mod.select("repo", "path"), imports)


# ---- documents


@query("SELECT d.path, s.name FROM docs d JOIN sym s ON s.sym_key = d.sym_key UNION ALL SELECT path, concat('Missing', doc_id) FROM docs")
def inline_code_refs(g: Graph) -> DataFrame:
    return g.docs.select("path", F.explode(documents.inline_code(F.col("body"))).alias("name"))


@query("SELECT d.path, concat('./', replace(lower(p.p_brand), '#', '-'), '.js') AS target FROM docs d JOIN part p ON p.p_partkey = d.sym_key")
def fenced_import_refs(g: Graph) -> DataFrame:
    return g.docs.select("path", F.explode(documents.fenced_imports(F.col("body"))).alias("target"))


@query("SELECT d.path, s.repo, s.filePath, s.name FROM docs d JOIN sym s ON s.sym_key = d.sym_key")
def graph_links(g: Graph) -> DataFrame:
    return g.docs.select("path", F.inline(documents.graph_links(F.col("body"))))


RESOLVED = """refs AS (SELECT d.path, 'inline' AS channel, s.name, d.service, NULL AS ref_id FROM docs d JOIN sym s ON s.sym_key = d.sym_key
UNION ALL SELECT path, 'inline', concat('Missing', doc_id), service, NULL FROM docs
UNION ALL SELECT d.path, 'link', s.name, d.service, s.id FROM docs d JOIN sym s ON s.sym_key = d.sym_key
UNION ALL SELECT d.path, 'fenced', replace(lower(p.p_brand), '#', '-'), d.service, NULL FROM docs d JOIN part p ON p.p_partkey = d.sym_key),
seg AS (SELECT regexp_replace(regexp_extract(path, '[^/]*$'), '\\.(js|ts)$', '') AS segment, min(path) AS module FROM mod GROUP BY 1),
svc AS (SELECT repo, name, min(id) AS id FROM sym GROUP BY repo, name),
found AS MATERIALIZED (SELECT r.path, r.channel, r.name, r.service, r.ref_id, v.id AS svc_id, CASE WHEN r.channel = 'fenced' THEN g.module ELSE coalesce(r.ref_id, v.id) END AS hit
FROM refs r LEFT JOIN seg g ON r.channel = 'fenced' AND g.segment = r.name LEFT JOIN svc v ON v.repo = r.service AND v.name = r.name),
lost AS MATERIALIZED (SELECT DISTINCT name, service FROM found WHERE hit IS NULL AND channel <> 'fenced'),
lg AS (SELECT name, len(g) AS n, unnest(g) AS x FROM (SELECT name, list_distinct(list_transform(range(1, length(name)), lambda i: lower(name)[i:i + 1])) AS g FROM (SELECT DISTINCT name FROM lost))),
kg AS (SELECT id, repo, len(h) AS m, unnest(h) AS x FROM (SELECT id, repo, list_distinct(list_transform(range(1, length(name)), lambda i: lower(name)[i:i + 1])) AS h FROM sym)),
alike AS MATERIALIZED (SELECT name, id, repo, 2.0 * count(*) / (n + m) AS score FROM lg JOIN kg USING (x) GROUP BY name, id, repo, n, m HAVING 2.0 * count(*) / (n + m) >= 0.6 - 1e-9),
best AS MATERIALIZED (SELECT l.name, l.service, arg_min(a.id, (-a.score, a.id)) AS id FROM lost l JOIN alike a ON a.name = l.name AND (l.service IS NULL OR l.service = a.repo) GROUP BY l.name, l.service),
resolved AS (SELECT f.path, f.channel, f.name, coalesce(f.hit, b.id) AS target,
CASE WHEN coalesce(f.hit, b.id) IS NULL THEN 'unresolved' WHEN f.channel = 'fenced' THEN 'module' WHEN f.ref_id IS NOT NULL THEN 'exact' WHEN f.svc_id IS NOT NULL THEN 'service' ELSE 'fuzzy' END AS how
FROM found f LEFT JOIN best b ON f.hit IS NULL AND f.channel <> 'fenced' AND b.name = f.name AND b.service IS NOT DISTINCT FROM f.service)"""


def resolved(g: Graph) -> DataFrame:
    return documents.resolve(documents.references(g.docs), g.sym, g.mod)


@query(f"WITH {RESOLVED} SELECT path, channel, name, target, how FROM resolved")
def resolve_cascade(g: Graph) -> DataFrame:
    return resolved(g)


@query(f"WITH {RESOLVED} SELECT path, name, 'no graph match found' AS reason FROM resolved WHERE how = 'unresolved'")
def unresolved_refs(g: Graph) -> DataFrame:
    return resolved(g).where("how = 'unresolved'").select("path", "name", F.lit("no graph match found").alias("reason"))


@query(f"WITH {RESOLVED} SELECT how, channel, count(*) AS n FROM resolved GROUP BY how, channel")
def doc_graph_status(g: Graph) -> DataFrame:
    return resolved(g).groupBy("how", "channel").agg(F.count("*").alias("n"))


@query(f"SELECT path, sha256(CASE WHEN doc_id % 2 = 0 THEN concat('a', chr(10), '{rules.RELATED_BEGIN}', chr(10), type, chr(10), '{rules.RELATED_END}', 'z') ELSE concat('plain', chr(10), chr(10), '{rules.RELATED_BEGIN}', chr(10), type, chr(10), '{rules.RELATED_END}', chr(10)) END) AS hash FROM docs")
def related_code_section(g: Graph) -> DataFrame:
    old = f"a\n{rules.RELATED_BEGIN}\nold\n{rules.RELATED_END}z"
    body = F.when(F.col("doc_id") % 2 == 0, old).otherwise("plain ")
    return g.docs.select("path", F.sha2(documents.with_section(body, F.col("type")), 256).alias("hash"))


@query("SELECT page_id, trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(html, '<!--.*?-->', ' ', 'gs'), '<script[^>]*>.*?</script>', ' ', 'gs'), '<style[^>]*>.*?</style>', ' ', 'gs'), '<[^>]*>', ' ', 'g'), '[ \\t\\r\\n]+', ' ', 'g')) AS text FROM pages")
def strip_html(g: Graph) -> DataFrame:
    return g.pages.select("page_id", text.strip_html(F.col("html")).alias("text"))


@query("SELECT path, concat('# ', type, ' for ', path, ' by {{author}}; again ', type) AS body FROM docs")
def template_apply(g: Graph) -> DataFrame:
    template = F.lit("# {{type}} for {{path}} by {{author}}; again {{type}}")
    return g.docs.select("path", documents.fill_template(template, {"type": F.col("type"), "path": F.col("path")}).alias("body"))


@query("""SELECT path, NOT (type = 'bogus' OR status = '') AS valid,
CASE WHEN status = '' THEN 'missing status' ELSE '' END AS missing, type AS kept_type FROM docs""")
def frontmatter_validate(g: Graph) -> DataFrame:
    head = F.concat(F.lit("---\ntitle: x\ntype: "), "type", F.lit("\nstatus: "), "status", F.lit("\nauthor: 'a b'\ncreated: 2024-01-02\nupdated: 2024-01-03\n---\n"), "body")
    rows = frontmatter.parse(g.docs.select("path", head.alias("body")))
    missing = F.array_join(F.filter("errors", lambda e: e.startswith("missing")), ",")
    return rows.select("path", "valid", missing.alias("missing"), F.col("type").alias("kept_type"))


# ---- vectors, search and concepts

COSINE = "list_cosine_similarity(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[]))"


@query(f"SELECT b.vec_id, round((1 + {COSINE}) / 2 + 1e-9, 6) AS score FROM (SELECT embedding FROM embeddings WHERE vec_id = 0) a, embeddings b ORDER BY (1 + {COSINE}) / 2 DESC, b.vec_id LIMIT 20")
def semantic_search_topk(g: Graph) -> DataFrame:
    first = g.embeddings.where("vec_id = 0").select("embedding").first()
    return tools.vector_top_k(list(first["embedding"]), g.embeddings, 20).select("vec_id", rounded("score").alias("score"))


@query(f"SELECT b.vec_id AS a, a.vec_id AS b, round({COSINE} + 1e-9, 6) AS cos FROM embeddings a JOIN embeddings b ON b.vec_id < a.vec_id WHERE {COSINE} > 0.3")
def concept_near_pairs(g: Graph) -> DataFrame:
    """Pairs above a cosine, of any label."""
    vectors = g.embeddings.select(F.col("vec_id").alias("id"), F.col("embedding").cast("array<double>").alias("v"))
    return concepts.near_earlier(vectors, 0.3).select(F.col("earlier").alias("a"), F.col("id").alias("b"), rounded("cos").alias("cos"))


SLUG = "regexp_replace(regexp_replace(regexp_replace(regexp_replace({c}, '[^a-z0-9\\s-]', '', 'g'), '\\s+', '-', 'g'), '-+', '-', 'g'), '^-|-$', '', 'g')"
SLUG_SQL = "CASE WHEN length({s}) > 2 AND {s} LIKE '%s' AND {s} NOT LIKE '%ss' THEN left({s}, length({s}) - 1) ELSE {s} END"


@query(f"WITH s AS (SELECT p_partkey, {SLUG.format(c='lower(concat(p_name, CASE WHEN p_partkey % 3 = 0 THEN chr(33) ELSE chr(115) END))')} AS s FROM part) SELECT p_partkey, {SLUG_SQL.format(s='s')} AS slug FROM s")
def concept_slugify(g: Graph) -> DataFrame:
    name = F.concat("p_name", F.when(F.col("p_partkey") % 3 == 0, "!").otherwise("s"))
    return g.part.select("p_partkey", text.slugify(name).alias("slug"))


@query(f"WITH s AS (SELECT p_partkey, {SLUG.format(c='lower(p_name)')} AS s FROM part), t AS (SELECT p_partkey, {SLUG_SQL.format(s='s')} AS slug FROM s) SELECT slug, min(p_partkey) AS first_key, count(*) AS n FROM t GROUP BY slug")
def concept_slug_dedup(g: Graph) -> DataFrame:
    return g.part.groupBy(text.slugify_ascii(F.col("p_name")).alias("slug")).agg(F.min("p_partkey").alias("first_key"), F.count("*").alias("n"))


@query("SELECT user_id AS concept, event_type AS doc, max(value) AS confidence, CAST(arg_max(event_id, (ts, event_id)) AS BIGINT) AS evidence FROM events GROUP BY 1, 2")
def mention_merge(g: Graph) -> DataFrame:
    rows = g.events.select(F.col("user_id").alias("concept"), F.col("event_type").alias("doc"), F.col("value").alias("confidence"), F.col("event_id").alias("evidence"), F.col("ts").alias("at"))
    return documents.mention_merge(rows)


@query("""WITH q AS (SELECT item_id, unnest(list_distinct(regexp_extract_all(lower(text), '[a-z]+'))) AS w FROM benchmark),
d AS (SELECT doc_id, w, count(*) AS tf FROM (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[a-z]+')) AS w FROM documents) GROUP BY 1, 2),
f AS (SELECT w, count(*) AS df FROM d GROUP BY w), n AS (SELECT count(*) AS n FROM documents),
s AS (SELECT q.item_id, d.doc_id, round(sum((1 + ln(d.tf)) * ln(1 + n.n / f.df)) + 1e-9, 4) AS score FROM q JOIN d USING (w) JOIN f USING (w), n GROUP BY 1, 2)
SELECT item_id, doc_id, score FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS r FROM s) WHERE r <= 10""")
def doc_search_tfidf(g: Graph) -> DataFrame:
    words = lambda c: F.regexp_extract_all(F.lower(c), F.lit("[a-z]+"), F.lit(0))
    asked = g.benchmark.select("item_id", F.explode(F.array_distinct(words(F.col("text")))).alias("w"))
    n = g.documents.count()
    found = search_index.dealt(g.documents.select("doc_id", "text"), "doc_id", n).select("doc_id", F.explode(words(F.col("text"))).alias("w"))
    found = found.join(asked.select("w").distinct(), "w", "left_semi").groupBy("doc_id", "w").agg(F.count("*").alias("tf"))
    found = search_index.dealt(found, "doc_id", n)
    df = found.groupBy("w").agg((F.log(1 + n / F.count("*"))).alias("idf"))
    scores = found.join(search_index.sent(asked.join(df, "w")), "w").groupBy("item_id", "doc_id").agg(F.round(F.sum((1 + F.log("tf")) * F.col("idf")) + 1e-9, 4).alias("score"))
    order = Window.partitionBy("item_id").orderBy(F.desc("score"), "doc_id")
    return scores.withColumn("r", F.row_number().over(order)).where("r <= 10").drop("r")


@query(f"""WITH q AS (SELECT item_id, unnest(list_distinct(list_filter(regexp_split_to_array(lower(text), '[^\\p{{L}}\\p{{N}}]+'), lambda x: x <> ''))) AS w FROM benchmark),
t AS (SELECT doc_id, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^\\p{{L}}\\p{{N}}]+'), lambda x: x <> '') AS t FROM documents),
n AS (SELECT count(*) AS n, avg(len(t)) AS mean FROM t), d AS (SELECT doc_id, w, count(*) AS tf, any_value(len) AS len FROM (SELECT doc_id, unnest(t) AS w, len(t) AS len FROM t) GROUP BY 1, 2),
f AS (SELECT w, ln(1 + (any_value(n) - count(*) + 0.5) / (count(*) + 0.5)) AS idf FROM d, n GROUP BY w),
s AS (SELECT q.item_id, CAST(d.doc_id AS VARCHAR) AS path, round(sum(idf * tf * {search_index.K1 + 1} / (tf + {search_index.K1} * (1 - {search_index.B} + {search_index.B} * len / mean))) + 1e-9, 4) AS score FROM q JOIN d USING (w) JOIN f USING (w), n GROUP BY 1, 2)
SELECT item_id, path, score FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, path) AS r FROM s) WHERE r <= 10""")
def doc_search_bm25(g: Graph) -> DataFrame:
    postings, lengths = search_index.indexed(g.documents.select(F.col("doc_id").cast("string").alias("path"), "text"))
    found = search_index.search(postings, lengths, g.benchmark.select(F.col("item_id").alias("query"), "text"))
    return found.select(F.col("query").alias("item_id"), "path", "score")


@query("SELECT s.sym_key, round(CASE WHEN lower(s.name) = 'almond_7' THEN 1.0 ELSE 1.0 - levenshtein(lower(s.name), 'almond_7') / greatest(length(s.name), 8) END + 1e-9, 6) AS score FROM sym s WHERE 1.0 - levenshtein(lower(s.name), 'almond_7') / greatest(length(s.name), 8) >= 0.3")
def fulltext_symbol(g: Graph) -> DataFrame:
    score = text.name_similarity(F.col("name"), F.lit("almond_7"))
    return g.sym.select("sym_key", score.alias("score")).where("score >= 0.3").select("sym_key", rounded("score").alias("score"))


# ---- summaries

MEMBERS = f"{FAN}, {PUBLIC}, members AS (SELECT p.sym_key, p.repo, p.communityId, p.id, CAST(f.fanIn AS DOUBLE) / 10 AS pr, f.fanIn, p.is_public, u.tier, coalesce(u.stale, false) AS stale FROM public p JOIN fan f USING (sym_key) LEFT JOIN sym_summaries u ON u.symbolFqn = p.id)"


def members(g: Graph) -> DataFrame:
    """Symbols with the columns that summarising needs; a tenth of fanIn stands for PageRank."""
    fan = algorithms.degree(nodes(g), edges(g)).select(F.col("node").alias("sym_key"), "fanIn")
    tiers = g.sym_summaries.select(F.col("symbolFqn").alias("id"), "tier", "stale")
    rows = passes.public_api(g.sym, g.mod).join(fan.hint("merge"), "sym_key").join(tiers.hint("merge"), "id", "left")
    return rows.select("sym_key", "repo", "communityId", "id", (F.col("fanIn") / 10).alias("pageRank"), "fanIn", "isPublicApi", F.lit(0.0).alias("changeFrequency"), "tier", F.coalesce("stale", F.lit(False)).alias("stale"))


@query(f"WITH {MEMBERS} SELECT repo, communityId, count(*) AS size, round(0.4 * avg(pr) + 0.3 * avg(fanIn) + 0.2 * avg(CAST(is_public AS DOUBLE)) - avg(CASE WHEN tier = 'canonical' THEN 1.0 ELSE 0.0 END) + 1e-9, 6) AS score FROM members WHERE NOT (repo = 'aux' AND communityId = 1) GROUP BY repo, communityId")
def pending_communities(g: Graph) -> DataFrame:
    fresh = g.spark.createDataFrame([("aux", 1)], "repo string, communityId int")
    return summaries.pending_communities(members(g), fresh).withColumn("score", rounded("score"))


@query(f"""WITH {MEMBERS} SELECT repo, count(*) AS total, count(*) FILTER (WHERE tier = 'canonical') AS canonical, count(*) FILTER (WHERE tier = 'provisional') AS provisional, count(*) FILTER (WHERE stale) AS stale,
count(*) - count(tier) AS unsummarised, round(100.0 * count(tier) / count(*) + 1e-9, 1) AS pct, round((count(*) - count(tier)) * CAST(0.003 AS DOUBLE) + count(*) FILTER (WHERE tier = 'provisional') * CAST(0.0025 AS DOUBLE) + 1e-9, 4) AS cost FROM members GROUP BY repo""")
def coverage_report(g: Graph) -> DataFrame:
    return tools.coverage(members(g), ["repo"])


@query("SELECT count(*) AS total, count(*) FILTER (WHERE quality = 1) AS canonical, count(*) FILTER (WHERE quality = 0) AS provisional, count(*) FILTER (WHERE toxic = 1) AS stale, count(*) - count(quality) AS unsummarised, round(100.0 * count(quality) / count(*) + 1e-9, 1) AS pct, round((count(*) - count(quality)) * CAST(0.003 AS DOUBLE) + count(*) FILTER (WHERE quality = 0) * CAST(0.0025 AS DOUBLE) + 1e-9, 4) AS cost FROM documents LEFT JOIN labels USING (doc_id)")
def summarization_coverage(g: Graph) -> DataFrame:
    tier = F.when(F.col("quality") == 1, "canonical").when(F.col("quality") == 0, "provisional")
    rows = g.documents.select("doc_id").join(g.labels, "doc_id", "left").select(tier.alias("tier"), F.coalesce(F.col("toxic") == 1, F.lit(False)).alias("stale"))
    return tools.coverage(rows, [])


@query(f"WITH {MEMBERS}, {ROLES} SELECT m.id FROM (SELECT *, row_number() OVER (PARTITION BY repo, communityId ORDER BY pr DESC, sym_key) AS pos FROM members) m JOIN roles r USING (sym_key) WHERE m.pos <= 10 OR r.role = 'bridge'")
def focal_set(g: Graph) -> DataFrame:
    roles = algorithms.roles(nodes(g), edges(g)).select(F.col("node").alias("sym_key"), "role")
    return summaries.focal_set(members(g).join(roles, "sym_key")).select("id")


@query(f"WITH {MEMBERS}, {ROLES} SELECT m.id, m.pr >= 0.5 OR m.is_public OR r.role = 'bridge' AS canonical FROM members m JOIN roles r USING (sym_key)")
def canonical_threshold(g: Graph) -> DataFrame:
    roles = algorithms.roles(nodes(g), edges(g)).select(F.col("node").alias("sym_key"), "role")
    rows = members(g).join(roles, "sym_key")
    return rows.select("id", summaries.canonical(F.col("pageRank"), F.col("isPublicApi"), F.col("role"), 0.5).alias("canonical"))


@query("""WITH a AS (SELECT c.src AS sym_key, CASE WHEN (c.src + c.dst) % 2 = 0 THEN s.name ELSE 'wrong' || c.dst END AS value, (c.src + c.dst) % 2 = 0 AS ok FROM calls c JOIN sym s ON s.sym_key = c.dst)
SELECT sym_key, count(*) AS total, count(*) FILTER (WHERE ok) AS held, CASE WHEN count(*) FILTER (WHERE ok) = count(*) THEN 'validated' WHEN count(*) FILTER (WHERE ok) > 0 THEN 'partial' ELSE 'unvalidated' END AS status FROM a GROUP BY sym_key""")
def validate_assertions(g: Graph) -> DataFrame:
    callee = g.sym.select(F.col("sym_key").alias("dst"), "name")
    facts = edges(g).join(callee, "dst").select(F.col("src").alias("sym_key"), F.lit("calls").alias("kind"), F.col("name").alias("value"), "dst")
    said = F.when((F.col("sym_key") + F.col("dst")) % 2 == 0, F.col("value")).otherwise(F.concat(F.lit("wrong"), F.col("dst").cast("string")))
    return summaries.validate(facts.select("sym_key", "kind", said.alias("value")), facts)


@query("""WITH c AS (SELECT conv_id, turn, ceil(length(text) / 4.0) / 1000 * CAST(0.0003 AS DOUBLE) + ceil(length(role) / 4.0) / 1000 * CAST(0.0015 AS DOUBLE) AS cost FROM conversations)
SELECT conv_id, turn, round(spent + 1e-9, 6) AS spent FROM (SELECT *, coalesce(sum(cost) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS spent FROM c) WHERE spent < 0.0002""")
def cost_ceiling(g: Graph) -> DataFrame:
    calls = g.conversations.select("conv_id", "turn", summaries.token_cost(F.length("text"), F.length("role")).alias("cost"))
    return summaries.within_ceiling(calls, "conv_id", "turn", "cost", 0.0002).select("conv_id", "turn", rounded("spent").alias("spent"))


@query(f"WITH {MEMBERS} SELECT repo, communityId, round(least(20.0, 100.0 * count(tier) / count(*)) + 1e-9, 6) AS \"coveragePct\" FROM members GROUP BY repo, communityId")
def cluster_coverage(g: Graph) -> DataFrame:
    rows = members(g)
    claimed = rows.select("repo", "communityId").distinct().withColumn("claimed", F.lit(20.0))
    return summaries.cluster_coverage(rows, claimed).select("repo", "communityId", rounded("coveragePct").alias("coveragePct"))


# ---- state


@query("SELECT repo, filePath, name, CASE WHEN sym_key % 5 = 0 THEN lineStart + 1 ELSE lineStart END AS \"lineStart\" FROM sym UNION ALL SELECT repo, filePath, concat(name, '_new'), lineStart FROM sym WHERE sym_key % 100 = 0")
def upsert_symbols(g: Graph) -> DataFrame:
    keys = ["repo", "filePath", "name"]
    old = g.sym.select(*keys, "lineStart")
    moved = g.sym.where("sym_key % 5 = 0").select(*keys, (F.col("lineStart") + 1).alias("lineStart"))
    new = g.sym.where("sym_key % 100 = 0").select("repo", "filePath", F.concat("name", F.lit("_new")).alias("name"), "lineStart")
    stale = moved.withColumn("lineStart", F.col("lineStart") - 1)  # the same key twice: the later line stays
    return upsert.upsert(old, moved.unionByName(stale).unionByName(new), keys, order="lineStart")


@query("SELECT o_orderkey AS parent, l_linenumber AS child, l_quantity AS q FROM lineitem JOIN orders ON o_orderkey = l_orderkey WHERE o_orderkey % 10 <> 0 UNION ALL SELECT o_orderkey, 1, 0.0 FROM orders WHERE o_orderkey % 10 = 0")
def replace_children(g: Graph) -> DataFrame:
    parents = g.orders.select(F.col("o_orderkey").alias("parent"))
    old = g.lineitem.select(F.col("l_orderkey").alias("parent"), F.col("l_linenumber").alias("child"), F.col("l_quantity").alias("q")).join(parents, "parent", "left_semi")
    changed = parents.where("parent % 10 = 0")
    return upsert.replace_children(old, changed.select("parent", F.lit(1).alias("child"), F.lit(0.0).alias("q")), ["parent"], changed)


@query("""WITH m AS (SELECT *, row_number() OVER (PARTITION BY user_id, date_trunc('minute', ts) ORDER BY ts, event_id) AS im FROM events),
h AS (SELECT *, row_number() OVER (PARTITION BY user_id, date_trunc('hour', ts), im <= 1 ORDER BY ts, event_id) AS ih FROM m) SELECT event_id, im <= 1 AND ih <= 2 AS allowed FROM h""")
def rate_limit_fixed_window(g: Graph) -> DataFrame:
    return jobs.rate_limited(g.events, "user_id", "ts", per_minute=1, per_hour=2).select("event_id", "allowed")


@query("SELECT event_type, strftime(date_trunc('day', ts), '%Y-%m-%d') AS day, count(*) AS n FROM events GROUP BY 1, 2")
def stream_commit_windows(g: Graph) -> DataFrame:
    stream = jobs.watch(g.spark, g.sf_dir, g.events.schema, glob="events.parquet").withColumn("at", F.col("ts").cast("timestamp"))
    counts = jobs.rolling_counts(stream, ["event_type"], "at", "1 day")
    return jobs.once(counts, checkpoint_folder(g.spark, f"stream-{uuid.uuid4().hex}")).select("event_type", F.date_format("start", "yyyy-MM-dd").alias("day"), "n")


# ---- questions that the graph answers


@query("SELECT repo, filePath, count(*) AS n FROM commits GROUP BY repo, filePath ORDER BY n DESC, repo, filePath LIMIT 20")
def most_changed(g: Graph) -> DataFrame:
    return g.commits.groupBy("repo", "filePath").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "repo", "filePath").limit(20)


@query("SELECT s.id, c.service FROM calls_service c JOIN sym s USING (sym_key)")
def calls_service(g: Graph) -> DataFrame:
    return g.calls_service.select("sym_key", "service").join(g.sym.select("sym_key", "id"), "sym_key").select("id", "service")


@query("SELECT id FROM sym WHERE isExported AND sym_key NOT IN (SELECT dst FROM calls)")
def exported_never_called(g: Graph) -> DataFrame:
    return g.sym.where("isExported").join(g.calls.select(F.col("dst").alias("sym_key")), "sym_key", "left_anti").select("id")


@query("SELECT DISTINCT s.id FROM sym s JOIN throws_direct t USING (sym_key) WHERE t.errorType = 'E1'")
def throws_type(g: Graph) -> DataFrame:
    return g.throws_direct.where("errorType = 'E1'").join(g.sym.select("sym_key", "id"), "sym_key").select("id").distinct()


@query(f"WITH {ROLES} SELECT s.id FROM roles r JOIN sym s USING (sym_key) WHERE r.role = 'boundary'")
def boundary_symbols(g: Graph) -> DataFrame:
    found = algorithms.roles(nodes(g), edges(g)).where("role = 'boundary'").select(F.col("node").alias("sym_key"))
    return g.sym.join(found, "sym_key").select("id")


@query("SELECT s.id FROM sym s WHERE s.isExported AND s.sym_key NOT IN (SELECT c.dst FROM calls c JOIN sym t ON t.sym_key = c.src WHERE t.filePath LIKE '%.test.js') AND s.filePath NOT LIKE '%.test.js'")
def untested_exports(g: Graph) -> DataFrame:
    is_test = passes.matches_any(F.col("filePath"), rules.TESTS)
    tested = g.calls.join(g.sym.where(is_test).select(F.col("sym_key").alias("src")), "src").select(F.col("dst").alias("sym_key"))
    return g.sym.where(F.col("isExported") & ~is_test).join(tested, "sym_key", "left_anti").select("id")
