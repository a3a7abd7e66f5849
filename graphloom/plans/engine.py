"""From a repository's files to an analysed graph, and the tools that answer from it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphloom.bundle import GraphBundle
from graphloom.checkpoints import cut
from graphloom.operators import algorithms, doc_writes, documents, leiden, passes, rolling, search_index, summaries, tools, upsert
from graphloom.plans import enrichment, runs
from graphloom.plans.indexing import follow, forget, identified, index  # noqa: F401  part of the engine
from graphloom.plans.runner import Pass, Record, as_table, run


def _due(graph: GraphBundle) -> DataFrame:
    """Repositories whose number of calls has changed by a share, with that number."""
    counts = graph["calls"].groupBy("repo").agg(F.count("*").alias("n"))
    counts = graph["symbols"].select("repo").distinct().join(counts, "repo", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    counts = counts.join(graph["metrics_meta"], "repo", "left").withColumn("due", algorithms.edge_delta(F.col("n"), F.col("lastEdgeCount")))
    return cut(counts.where("due").select("repo", "n"))


def _due_graph(graph: GraphBundle, due: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes and calls of those repositories."""
    chosen = identified(graph["symbols"]).join(due.select("repo"), "repo", "left_semi")
    nodes = cut(chosen.select(F.col("id").alias("node"), "isExported", "repo"))
    return nodes, cut(graph["calls"].join(due.select("repo"), "repo", "left_semi").select("src", "dst"))


def _put(graph: GraphBundle, found: DataFrame) -> None:
    """Sets the symbols' columns in ``found`` (node and columns)."""
    graph["symbols"] = cut(upsert.merge_columns(identified(graph["symbols"]), found.withColumnRenamed("node", "id"), ["id"]).drop("id"))


def _metrics(graph: GraphBundle) -> dict:
    """Structural metrics of repositories that are due, each written as soon as it is known."""
    due = _due(graph)
    if due.isEmpty():
        return {"repos": 0}
    nodes, edges = _due_graph(graph, due)
    node = nodes.select("node")
    _put(graph, algorithms.degree(node, edges).join(algorithms.reachability(nodes, edges), "node"))
    _put(graph, algorithms.pagerank(node, edges))
    _put(graph, algorithms.betweenness(node, edges))
    return {"repos": due.count(), "symbols": nodes.count()}


def _communities(graph: GraphBundle) -> dict:
    """Communities and roles of repositories that are due, which are up to date then."""
    due = _due(graph)
    if due.isEmpty():
        return {"repos": 0}
    nodes, edges = _due_graph(graph, due)
    groups = leiden.leiden(nodes, edges).join(nodes.select("node", "repo"), "node")
    # a community is called by the place of its first symbol among the repository's
    number = nodes.select(F.col("node").alias("community"), F.dense_rank().over(Window.partitionBy("repo").orderBy("node")).alias("communityId"))
    groups = groups.join(number, "community").select("node", "repo", "communityId")
    roles = cut(algorithms.roles(groups, edges))
    graph["communities"] = cut(upsert.replace_children(graph["communities"], algorithms.community_nodes(roles, edges).withColumn("coveragePct", F.lit(None).cast("double")).select(*graph["communities"].columns), ["repo"], due))
    _put(graph, roles.select("node", "communityId", F.col("role").alias("communityRole")))
    graph.upsert("metrics_meta", due.select("repo", F.col("n").alias("lastEdgeCount"), F.current_timestamp().alias("updatedAt")))
    graph["metrics_meta"] = cut(graph["metrics_meta"])
    return {"repos": due.count(), "communities": graph["communities"].count()}


def _classes(graph: GraphBundle) -> dict:
    rows = graph["symbols"].drop("isPublicApi")
    rows = passes.public_api(rows, graph["modules"]).drop("barrel")
    graph["symbols"] = cut(rows.withColumn("architecturalLayer", passes.architectural_layer(F.col("filePath"))))
    return {"public": graph["symbols"].where("isPublicApi").count()}


def _errors(graph: GraphBundle) -> dict:
    throws = graph["throws"].select(F.col("symbol").alias("sym_key"), "errorType")
    catches = graph["catches"].select(F.col("symbol").alias("sym_key"), "errorType")
    new = passes.throws_propagation(graph["calls"].select("src", "dst"), throws, catches)
    graph.upsert("throws", cut(new.select(F.col("sym_key").alias("symbol"), "errorType", F.lit(True).alias("propagated"), F.lit("inferred").alias("confidence"))))
    return {"throws": graph["throws"].count()}


def _tests(graph: GraphBundle) -> dict:
    found = passes.test_asserts(_keyed(graph), graph["calls"].select("src", "dst"))
    graph["test_asserts"] = cut(found.select(F.col("test_key").alias("test"), F.col("prod_key").alias("symbol"), "testFile", "coverageKind"))
    return {"edges": graph["test_asserts"].count()}


def _governs(graph: GraphBundle) -> dict:
    declared = documents.declared_symbols(graph["documents"])
    symbols = _keyed(graph).select("sym_key", "repo", "filePath", "name")
    found = passes.governs(declared, graph["documents"].select("path"), symbols)
    graph["governs"] = cut(found.select("doc_path", F.col("sym_key").alias("symbol")))
    return {"edges": graph["governs"].count()}


def _stale(graph: GraphBundle) -> dict:
    """Summaries made from another content than their symbol's are marked."""
    now = identified(graph["symbols"]).select(F.col("id").alias("symbolFqn"), "hash")
    rows = graph["symbol_summaries"].join(now, "symbolFqn", "left")
    graph["symbol_summaries"] = cut(rows.withColumn("stale", ~F.col("hash").eqNullSafe(F.col("contentHash"))).drop("hash"))
    return {"stale": graph["symbol_summaries"].where("stale").count()}


PASSES = [
    Pass("structural-metrics", _metrics),
    Pass("communities", _communities),
    Pass("classification", _classes),
    Pass("behavioral-edges", _errors),
    Pass("test-asserts", _tests),
    Pass("governs", _governs),
    Pass("stale-summaries", _stale),
]


def sourced(commits: DataFrame, patterns: DataFrame, today: Column | None = None) -> list[Pass]:
    """Passes over what lies outside the graph, for ``extra``: volatility from ``commits`` (repo, filePath, ts, email)
    and contexts by ``patterns`` (repo, contextId, pattern, declarationOrder). A symbol without either has nulls."""

    def put(g: GraphBundle, rows: DataFrame, columns: list[str]) -> None:
        old = g["symbols"]
        g["symbols"] = cut(upsert.merge_columns(old.drop(*columns), rows, ["repo", "filePath"]).select(*old.columns))

    def volatility(g: GraphBundle) -> dict:
        columns = ["changeFrequency", "authorCount", "lastModified", "gitAge"]
        rows = cut(rolling.volatility(rolling.daily(commits), F.current_date() if today is None else today))
        put(g, rows.select("repo", "filePath", *columns), columns)
        return {"files": rows.count()}

    def contexts(g: GraphBundle) -> dict:
        known = g["symbols"].select("repo", "filePath").distinct().withColumn("path", F.concat_ws("/", "repo", "filePath"))
        found = cut(passes.bounded_context(known, patterns.select("contextId", "declarationOrder", F.concat_ws("/", "repo", "pattern").alias("pattern"))))
        put(g, found.select("repo", "filePath", F.col("contextId").alias("boundedContextId")), ["boundedContextId"])
        return {"assigned": found.where("contextId IS NOT NULL").count(), "ambiguous": found.where("ambiguous").count()}

    return [Pass("git-volatility", volatility), Pass("bounded-context", contexts)]


def analyse(graph: GraphBundle, extra: list[Pass] | None = None, timeout: float = 300.0) -> list[Record]:
    return run(graph, [*PASSES, *(extra or [])], timeout)


def _keyed(graph: GraphBundle) -> DataFrame:
    return identified(graph["symbols"]).withColumn("sym_key", F.col("id"))


def _one(df: DataFrame, key: str) -> DataFrame:
    return df.where((F.col("id") == key) | (F.col("name") == key)).limit(1)


def _details(g: GraphBundle, key: str) -> DataFrame:
    modules = g["modules"].select("repo", F.col("path").alias("filePath"), F.col("path").alias("module"), "moduleSystem", "isBarrel")
    summary = g["symbol_summaries"].select(F.col("symbolFqn").alias("id"), "purpose", "tier", "stale")
    return _one(_keyed(g), key).join(modules, ["repo", "filePath"], "left").join(summary, "id", "left")


def _context(g: GraphBundle, key: str) -> DataFrame:
    chosen = _one(_keyed(g), key)
    docs = g["documented_by"].unionByName(g["governs"]).select("doc_path", F.col("symbol").alias("sym_key"))
    own = chosen.select("sym_key")
    near = g["calls"].select("src", "dst").join(own, (F.col("src") == F.col("sym_key")) | (F.col("dst") == F.col("sym_key")), "left_semi")
    ends = near.select(F.explode(F.array("src", "dst")).alias("sym_key")).unionByName(own).distinct()
    around = _keyed(g).join(ends, "sym_key", "left_semi")
    found = tools.symbol_context(around, near, g["symbol_summaries"], docs, F.col("architecturalLayer"))
    return found.join(own, "sym_key", "left_semi")


def _community(g: GraphBundle, community: int | None = None, repo: str | None = None, name: str | None = None, vector: list[float] | None = None) -> DataFrame:
    """A community by its id, else the nearest summary's, else one whose name holds ``name``: its first ten members."""
    chosen = g["community_summaries"].select("repo", "communityId", "name", "embedding")
    if community is not None:
        chosen = g["symbols"].where(F.col("communityId") == community).select("repo", "communityId").distinct()
        chosen = chosen if repo is None else chosen.where(F.col("repo") == repo)
    elif vector is not None:
        chosen = tools.vector_top_k(vector, chosen, 1, tie="communityId").select("repo", "communityId")
    else:
        chosen = chosen.where(F.contains("name", F.lit(name or ""))).orderBy("repo", "communityId").limit(1).select("repo", "communityId")
    members = summaries.community(_keyed(g), g["symbol_summaries"]).join(chosen, ["repo", "communityId"], "left_semi")
    purposes = g["symbol_summaries"].select(F.col("symbolFqn").alias("id"), "purpose")
    return members.where("at <= 10").join(purposes, "id", "left").select("repo", "communityId", "at", "id", "name", "pageRank", "hasSummary", "tier", "purpose")


def ready(g: GraphBundle, table: str, dimension: int | None = None) -> bool:
    """Whether a table has vectors, all of the dimension if one is given."""
    sizes = [r[0] for r in g[table].where("embedding IS NOT NULL").select(F.size("embedding").alias("n")).distinct().limit(2).collect()]
    return bool(sizes) and (dimension is None or sizes == [dimension])


def _semantic(g: GraphBundle, vector: list[float] | None, kind: str = "symbol", k: int = 5) -> DataFrame:
    """The nearest summaries of symbols or communities; none without a vector or an index of its dimension."""
    table, tie = {"symbol": ("symbol_summaries", "symbolFqn"), "community": ("community_summaries", "communityId")}[kind]
    rows = g[table].where("embedding IS NOT NULL")
    if not vector or not ready(g, table, len(vector)):
        return rows.withColumn("score", F.lit(0.0)).limit(0)
    return tools.vector_top_k(vector, rows, k, tie=tie)


def _in_doc(g: GraphBundle, path: str) -> DataFrame:
    """Symbols that a document governs or documents."""
    links = [g[t].where(F.col("doc_path") == path).select("symbol", F.lit(t).alias("link")) for t in ("governs", "documented_by")]
    return links[0].unionByName(links[1]).join(_keyed(g).withColumnRenamed("id", "symbol"), "symbol").select("symbol", "name", "link").distinct()


def _related_docs(g: GraphBundle, key: str) -> DataFrame:
    """Documents that govern or document a symbol."""
    chosen = _one(_keyed(g), key).select(F.col("id").alias("symbol"))
    links = g["governs"].unionByName(g["documented_by"]).join(chosen, "symbol", "left_semi")
    return tools.related_docs(links, g["documents"], ["symbol"])


def _topology(g: GraphBundle, repo: str | None = None) -> DataFrame:
    pick = lambda df: df if repo is None else df.where(F.col("repo") == repo)
    calling = g["calls_service"].select(F.substring_index("symbol", ":", 1).alias("repo"), F.regexp_extract("symbol", "^[^:]*:(.*)#", 1).alias("module"), "service")
    return tools.service_topology(pick(g["external_services"]), pick(g["imports_service"]).select("repo", "module", "service"), pick(calling))


def _search_docs(g: GraphBundle, query: str, limit: int = 10, min_score: float = 0.0, filters: dict[str, str] | None = None) -> DataFrame:
    """Documents by BM25 over the kept index, which is brought up to date first; no concepts and no scratchpad."""
    rows = doc_writes.index_rows(g["documents"]).where(~doc_writes.hidden(F.col("path")))
    postings, lengths = search_index.refreshed(g["doc_postings"], g["doc_lengths"], rows)
    g["doc_postings"], g["doc_lengths"] = cut(postings), cut(lengths)
    asked = g.spark.createDataFrame([(0, query)], "query int, text string")
    best = search_index.search(g["doc_postings"], g["doc_lengths"], asked, k=max(tools.clamp(limit, 100), 1) if not filters else 2**31 - 1)
    found = doc_writes.filtered(rows.join(best.drop("query"), "path"), filters, min_score)
    return found.orderBy(F.desc("score"), "path").limit(tools.clamp(limit, 100)).drop("text")


def _reconcile(g: GraphBundle, prefix: str = "", run_id: str | None = None) -> DataFrame:
    """Resolves the references of documents that changed, writes the edges, and counts how they resolved.

    What a run leaves unresolved is kept under its id.
    """
    docs = cut(documents.to_scan(g["documents"], prefix))
    found = cut(documents.resolve(documents.references(docs), _keyed(g).select("id", "repo", "filePath", "name"), g["modules"].select("path")))
    documented, refs = documents.reference_edges(found, ["channel", "name", "how"])
    for name, rows in (("documented_by", documented), ("doc_references", refs)):
        g[name] = cut(g[name].join(docs.select(F.col("path").alias("doc_path")), "doc_path", "left_anti"))
        g.upsert(name, rows)
    g["documents"] = cut(upsert.merge_columns(g["documents"], docs.select("path", F.col("hash").alias("lastEnrichedHash")), ["path"]))
    if run_id is not None:
        g["unresolved_refs"] = cut(g["unresolved_refs"].unionByName(found.where("how = 'unresolved'").select(F.lit(run_id).alias("runId"), "path", "channel", "name")))
    return found.groupBy("how", "channel").agg(F.count("*").alias("n"))


def _doc_graph(g: GraphBundle, prefix: str = "", wait: bool = True) -> DataFrame:
    """A reconciliation: how its references resolved, or without waiting the row of the run that goes on."""
    out: dict[str, DataFrame] = {}

    def job(run_id: str) -> dict:
        out["counts"] = cut(_reconcile(g, prefix, run_id))
        return {f"{r['channel']}.{r['how']}": r["n"] for r in out["counts"].collect()}  # as many rows as channels and ways

    run_id = runs.of(g).start("doc-graph", job, wait)
    if not wait:
        return runs.of(g).status(run_id)
    if "counts" not in out:
        raise RuntimeError(runs.of(g).status(run_id).first()["error"])
    return out["counts"]


def _enrichment(g: GraphBundle, complete: Callable[[str], str], embed: Callable[[str], list[float]], prefix: str = "") -> DataFrame:
    return runs.of(g).status(runs.of(g).start("enrichment", lambda _: enrichment.enrich(g, complete, embed, prefix)))


def _summarize(g: GraphBundle, repo: str, complete: Callable[[str, str], str], mode: str = "incremental") -> DataFrame:
    """Starts summaries of a repository's communities: of symbols without a fresh one, or in mode ``full`` of all."""
    if not repo:
        raise ValueError("a repository is needed")

    def job(_: str) -> dict:
        known = g["symbol_summaries"].select(F.col("symbolFqn").alias("id"), "tier", F.coalesce("stale", F.lit(False)).alias("stale"))
        rows = _keyed(g).where((F.col("repo") == repo) & F.col("communityId").isNotNull()).join(known, "id", "left")
        rows = rows if mode == "full" else rows.where("tier IS NULL OR stale")
        prompt = F.to_json(F.struct("name", "kind", "signature", "docstring", "throwTypes", "effectKinds"))
        members = rows.select("id", "sym_key", "repo", "communityId", "pageRank", "isPublicApi", F.col("communityRole").alias("role"), F.when(~F.col("stale"), F.col("tier")).alias("tier"), prompt.alias("prompt"))
        new = cut(summaries.run(members, complete))
        hashes = _keyed(g).select(F.col("id").alias("symbolFqn"), F.col("hash").alias("contentHash"))
        fresh = new.drop("contentHash").join(hashes, "symbolFqn").withColumns({"generatedAt": F.current_timestamp(), "stale": F.lit(False)})
        columns = [c for c in g["symbol_summaries"].columns if c in fresh.columns]
        g.upsert("symbol_summaries", fresh.select(*columns))
        g["symbol_summaries"] = cut(g["symbol_summaries"])
        return {"mode": "full" if mode == "full" else "incremental", "repo": repo, "summaries": new.count()}

    return runs.of(g).status(runs.of(g).start("summarization", job))


def _write(g: GraphBundle, change: Callable[..., DataFrame], *rows: DataFrame) -> DataFrame:
    g["documents"] = cut(change(g["documents"], *rows))
    return g["documents"]


def _doc(g: GraphBundle, path: str, body: str) -> DataFrame:
    return g.spark.createDataFrame([(path, body)], "path string, body string")


def _found(df: DataFrame, what: str) -> DataFrame:
    if df.isEmpty():
        raise KeyError(f"not found: {what}")
    return df


def _recompute(g: GraphBundle) -> DataFrame:
    g["metrics_meta"] = g["metrics_meta"].where("false")
    return as_table(g.spark, run(g, PASSES[:2]), "all")


def _mentions(g: GraphBundle) -> DataFrame:
    return g["mentioned_in"].groupBy(F.col("concept").alias("id")).agg(F.count("*").alias("mentionCount"))


#: Tools by name: a function of the graph and its parameters.
TOOLS: dict[str, Callable[..., DataFrame]] = {
    "graph.findSymbol": lambda g, **p: tools.find_symbol(_keyed(g), **p),
    "graph.symbolDetails": _details,
    "graph.callers": lambda g, key, depth=3: tools.related(_keyed(g), g["calls"], key, depth),
    "graph.callees": lambda g, key, depth=3: tools.related(_keyed(g), g["calls"], key, depth, callers=False),
    "graph.impactOf": lambda g, key, depth=3: tools.impact_of(_keyed(g), g["calls"], g["throws"].withColumnRenamed("symbol", "sym_key"), key, depth),
    "graph.moduleGraph": lambda g, repo, prefix=None, limit=50: tools.module_graph(g["modules"], g["imports"], repo, prefix, limit),
    "graph.listServices": lambda g, repo=None: g["external_services"].where(F.lit(repo is None) | (F.col("repo") == repo)).orderBy("repo", "name"),
    "graph.serviceTopology": _topology,
    "graph.symbolContext": _context,
    "graph.communityContext": _community,
    "graph.semanticSearch": _semantic,
    "graph.symbolsInDoc": _in_doc,
    "graph.relatedDocs": _related_docs,
    "graph.query": lambda g, text: _open(g, text),
    "docs.list": lambda g, prefix="": g["documents"].where(F.col("path").startswith(prefix) & (F.lit(prefix.startswith("concepts/")) | ~F.col("path").startswith("concepts/"))),
    "docs.read": lambda g, path: _found(g["documents"].where(F.col("path") == path), path),
    "docs.create": lambda g, path, body: _write(g, doc_writes.created, _doc(g, path, body)),
    "docs.update": lambda g, path, body: _write(g, doc_writes.updated, _doc(g, path, body)),
    "docs.delete": lambda g, path: _write(g, doc_writes.deleted, _doc(g, path, "")),
    "docs.propose": lambda g, name, body: _write(g, doc_writes.proposed, _doc(g, name, body).withColumnRenamed("path", "name")),
    "docs.search": _search_docs,
    "docs.listTemplates": lambda g: g["templates"].select("name").orderBy("name"),
    "docs.applyTemplate": lambda g, template, path, **values: _write(g, lambda docs, wanted: doc_writes.from_template(docs, g["templates"], wanted, list(values)), g.spark.createDataFrame([(path, template, *map(str, values.values()))], ["path", "template", *values])),
    "concepts.list": lambda g: g["concepts"].join(_mentions(g), "id", "left").select("id", "name", F.coalesce("mentionCount", F.lit(0)).alias("mentionCount"), "updatedAt"),
    "concepts.read": lambda g, id: _found(g["concepts"].where(F.col("id") == id).drop("embedding"), id),
    "admin.docGraphRun": _doc_graph,
    "admin.docGraphStatus": lambda g, runId: runs.of(g).status(runId, "doc-graph"),
    "admin.docGraphUnresolved": lambda g: runs.latest(g["runs"], g["unresolved_refs"], "doc-graph"),
    "admin.enrichmentRun": _enrichment,
    "admin.enrichmentStatus": lambda g, runId: runs.of(g).status(runId, "enrichment"),
    "admin.triggerSummarization": _summarize,
    "admin.summarizationStatus": lambda g, runId: runs.of(g).status(runId, "summarization"),
    "admin.passRunHistory": lambda g, repo, limit=50: g["pass_runs"].where(F.col("repo") == repo).orderBy(F.desc("startedAt"), "pass").limit(tools.clamp(limit, 200)),
    "admin.diagnostics": lambda g: tools.diagnostics({n: g[n] for n in ("symbols", "modules", "documents")}),
    "admin.recomputeMetrics": _recompute,
    "admin.summarizationCoverage": lambda g, repo: tools.coverage(_keyed(g).where(F.col("repo") == repo).join(g["symbol_summaries"].select(F.col("symbolFqn").alias("id"), "tier", "stale"), "id", "left"), ["repo"]),
    "summaries.getCommunity": lambda g, repo, community: summaries.community(_keyed(g), g["symbol_summaries"]).where((F.col("repo") == repo) & (F.col("communityId") == community)).orderBy("at"),
    "summaries.getNode": lambda g, key: summaries.node_details(_one(_keyed(g), key), g["throws"], g["calls_service"], g["reads_config"], g["test_asserts"]),
    "summaries.getExisting": lambda g, key: summaries.existing(g["symbol_summaries"], key),
}


def _open(graph: GraphBundle, text: str) -> DataFrame:
    for name in graph.tables:
        graph[name].createOrReplaceTempView(name)
    return tools.open_query(graph.spark, text)


def call(graph: GraphBundle, tool: str, **parameters) -> DataFrame:
    if tool not in TOOLS:
        raise KeyError(f"unknown tool: {tool}")
    return TOOLS[tool](graph, **parameters)
