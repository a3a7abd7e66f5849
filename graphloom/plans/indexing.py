"""Source files to the graph: what changed is extracted and replaces what was known of these files."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.bundle import GraphBundle
from graphloom.checkpoints import cut
from graphloom.operators import extraction, parsing, upsert
from graphloom.operators.lexing import FILE
from graphloom.plans.isolation import isolated, judged
from graphloom.sources.feed import changes

#: Tables whose rows belong to the file in ``filePath``, and to the symbol in the named columns.
OF_FILES = ["symbols", "call_sites", "comments", "scopes", "code_references", "parent_scope", "annotated_by", "resolves_to", "index_errors"]
OF_SYMBOLS = {"calls": ["src", "dst"], "throws": ["symbol"], "catches": ["symbol"], "reads_config": ["symbol"], "reads_flag": ["symbol"], "calls_service": ["symbol"], "test_asserts": ["test", "symbol"], "governs": ["symbol"], "documented_by": ["symbol"], "symbol_summaries": ["symbolFqn"]}

Plugin = Callable[[DataFrame], DataFrame]


def identified(symbols: DataFrame) -> DataFrame:
    return symbols.withColumn("id", F.concat("repo", F.lit(":"), "filePath", F.lit("#"), "name"))


def _renew(graph: GraphBundle, name: str, rows: DataFrame, owner: str, changed: DataFrame) -> None:
    """Puts ``rows`` in place of those whose owner, a symbol's id, is in a changed file."""
    graph[name] = cut(_without(graph[name], owner, changed))
    graph.upsert(name, rows)


def _without(rows: DataFrame, owner: str, files: DataFrame) -> DataFrame:
    """``rows`` whose owner, a symbol's id, is in none of the files."""
    names = files.select(F.concat("repo", F.lit(":"), "filePath").alias("file")).distinct()
    return rows.withColumn("file", F.substring_index(owner, "#", 1)).join(names, "file", "left_anti").drop("file")


def index(graph: GraphBundle, files: DataFrame, before: list[Plugin] | None = None) -> dict:
    """Extracts what changed of ``files`` (repo, filePath, hash, text), updates the graph and counts files.

    ``before``: plugins that change the text of files that changed, before they are read. A file that can't be read, or that a plugin
    or a pattern fails on, is told in ``index_errors`` and leaves the graph as it was; all others are indexed.
    """
    read, faulty = judged(files)
    known = graph["modules"].select("repo", F.col("path").alias("filePath"), "hash")
    read, faulty = cut(read.join(known, ["repo", "filePath", "hash"], "left_anti")), cut(faulty)
    if before:  # by itself, as plugins fail more often than patterns and are tried again faster
        got, failed = isolated(read, lambda part: {"files": cut(reduce(lambda df, plugin: plugin(df), before, part))})
        read, faulty = cut(got["files"]), cut(faulty.unionByName(failed))
    found, failed = isolated(read, _extracted)
    faulty = cut(faulty.unionByName(failed))
    _write(graph, found)
    tried = found["changed"].select(*FILE).unionByName(faulty.select(*FILE))
    graph["index_errors"] = cut(upsert.replace_children(graph["index_errors"], faulty.select(*graph["index_errors"].columns), FILE, tried))
    return {"indexed": found["changed"].count(), "errors": faulty.count()}


def _extracted(changed: DataFrame) -> dict[str, DataFrame]:
    """All that is read from the text of files; computed, so that what fails fails here."""
    comments, sites = cut(parsing.comment_places(changed)), cut(extraction.call_sites(changed))
    symbols = cut(_symbols(changed, comments))
    # the hash is that of the file, which a plugin's text may not have
    docs = changed.select("repo", F.col("filePath").alias("path"), "hash", parsing.module_docstring(F.col("text")).alias("docstring"))
    rest = {
        "modules": extraction.modules(changed).drop("hash").join(docs, ["repo", "path"]), "imports": extraction.imports(changed), "references": parsing.references(changed),
        "scopes": parsing.scopes(changed), "exports": parsing.exports(changed), "facts": _facts(changed, symbols, sites),
    }
    return {"changed": changed, "comments": comments, "sites": sites} | {name: cut(rows) for name, rows in rest.items()}


def _facts(changed: DataFrame, symbols: DataFrame, sites: DataFrame) -> DataFrame:
    """Symbols with their body and what it does."""
    lines = symbols.join(changed.select("repo", "filePath", "text"), ["repo", "filePath"])
    body = F.array_join(F.slice(F.split("text", "\n"), F.col("lineStart"), F.col("lineEnd") - F.col("lineStart") + 1), "\n")
    facts = lines.withColumn("body", body).select(*symbols.columns, "body", F.sha2("body", 256).alias("hash"), extraction.config_keys(F.col("body")).alias("configKeysRead"), extraction.thrown(F.col("body")).alias("throwTypes"), F.col("body").rlike(r"\bthis\.[\w$]+\s*([-+*/%&|^]?=[^=]|\+\+|--)").alias("hasMutation"), parsing.caught(F.col("body")).alias("caught"))
    inside = sites.join(symbols.select("repo", "filePath", "name", "lineStart", "lineEnd"), ["repo", "filePath"]).where("line BETWEEN lineStart AND lineEnd")
    effects = inside.groupBy("repo", "filePath", "name").agg(F.collect_set(extraction.effect(F.col("callee"))).alias("effectKinds"))
    facts = facts.join(effects, ["repo", "filePath", "name"], "left").withColumn("effectKinds", F.coalesce("effectKinds", F.array().cast("array<string>")))
    return facts.withColumn("hasIO", extraction.has_io(F.col("effectKinds"))).withColumn("isPure", ~F.col("hasIO") & ~F.col("hasMutation"))


def _write(graph: GraphBundle, found: dict[str, DataFrame]) -> None:
    """Puts what was found of the changed files in place of what the graph knew of them."""
    changed, imports, facts, sites, references, comments = (found[n] for n in ("changed", "imports", "facts", "sites", "references", "comments"))
    own = changed.select("repo", "filePath")
    graph.upsert("modules", found["modules"])
    graph.upsert("modules", upsert.stubs(graph["modules"].select("repo", "path"), imports.where("target IS NOT NULL").select("repo", "target")))
    graph["symbols"] = cut(graph["symbols"].join(own, ["repo", "filePath"], "left_anti"))
    graph.upsert("symbols", facts.drop("body", "caught"), order="lineStart")
    graph["call_sites"] = upsert.replace_children(graph["call_sites"], sites.select("repo", "filePath", F.col("callee").alias("calleeExpression"), "argumentCount", F.col("isNew").alias("isNewExpression"), "line", F.lit("heuristic").alias("resolutionStatus")), ["repo", "filePath"], own)
    graph["comments"] = upsert.replace_children(graph["comments"], comments, ["repo", "filePath"], own)
    graph["scopes"] = upsert.replace_children(graph["scopes"], found["scopes"], ["repo", "filePath"], own)
    graph["code_references"] = upsert.replace_children(graph["code_references"], references.withColumn("confidence", F.lit(1.0)).select(*graph["code_references"].columns), ["repo", "filePath"], own)
    graph.upsert("external_packages", imports.where("package IS NOT NULL").select(F.col("package").alias("name")))
    graph["imports"] = cut(graph["imports"].join(own.withColumnRenamed("filePath", "source"), ["repo", "source"], "left_anti"))
    graph.upsert("imports", imports.where("target IS NOT NULL").select("repo", "source", "target", "kind"))
    names = F.explode(F.split(F.regexp_replace("what", r"[{}\s]", ""), ","))
    bound = imports.where("target IS NOT NULL AND what <> ''").select("repo", F.col("source").alias("filePath"), "target", names.alias("name"))
    calls = extraction.resolve_calls(sites, identified(graph["symbols"]), bound)
    _renew(graph, "calls", cut(calls.withColumn("repo", F.substring_index("src", ":", 1))), "src", changed)
    _links(graph, found)
    _behaviour(graph, identified(facts), imports, references, changed)


def _links(graph: GraphBundle, found: dict[str, DataFrame]) -> None:
    """Edges within a file: what it exports, scopes around scopes, comments at symbols, names of symbols."""
    own = found["changed"].select(*FILE)
    symbols = cut(identified(found["facts"]).groupBy(*FILE, "name").agg(F.max(F.struct("lineStart", "id")).alias("s")).select(*FILE, "name", "s.lineStart", F.col("s.id").alias("symbol")))
    exported = found["exports"].join(symbols.select(*FILE, "name", "symbol"), [*FILE, "name"]).select("repo", F.col("filePath").alias("module"), "exportName", "exportKind", "symbol")
    graph["exports"] = cut(graph["exports"].join(own.withColumnRenamed("filePath", "module"), ["repo", "module"], "left_anti"))
    graph.upsert("exports", exported)
    told = found["comments"].where("kind IN ('jsdoc', 'block')").select(*FILE, "kind", F.col("lineStart").alias("commentLine"), "lineEnd")
    new = {
        "parent_scope": parsing.scope_edges(found["scopes"]),
        "annotated_by": parsing.annotated(symbols.select(*FILE, "symbol", "lineStart"), told),
        "resolves_to": parsing.resolved_names(found["references"].select(*FILE, "name", "line", "column"), symbols.select(*FILE, "name", "symbol")),
    }
    for name, rows in new.items():
        graph[name] = cut(upsert.replace_children(graph[name], rows.select(*graph[name].columns), FILE, own))


def _symbols(changed: DataFrame, comments: DataFrame) -> DataFrame:
    """Symbols with what lists and defaults export, and the words of the doc comment above."""
    rows = extraction.symbols(changed)
    exported = parsing.exports(changed).groupBy("repo", "filePath", "name").agg(F.min("exportKind").alias("kindOfExport"))
    rows = rows.join(exported, ["repo", "filePath", "name"], "left")
    rows = rows.withColumns({"isExported": F.col("isExported") | F.col("kindOfExport").isNotNull(), "exportKind": F.coalesce("exportKind", "kindOfExport")}).drop("kindOfExport")
    above = comments.where("kind = 'jsdoc'").groupBy("repo", "filePath", (F.col("lineEnd") + 1).alias("lineStart")).agg(F.max(extraction.docstring(F.col("text"))).alias("docstring"))
    return rows.join(above, ["repo", "filePath", "lineStart"], "left")


def _as_key(pattern: str) -> Callable[[Column], Column]:
    return lambda key: F.struct(key.alias("key"), F.lit(pattern).alias("accessPattern"))


def _behaviour(graph: GraphBundle, facts: DataFrame, imports: DataFrame, references: DataFrame, changed: DataFrame) -> None:
    """Errors, configuration, flags and services of the changed files' symbols."""
    # what callers were found to pass on may come from these files: the pass finds it anew
    passed = graph["throws"].withColumn("r", F.when(F.coalesce("propagated", F.lit(False)), F.substring_index("symbol", ":", 1)))
    graph["throws"] = passed.join(changed.select(F.col("repo").alias("r")).distinct(), "r", "left_anti").drop("r")
    thrown = facts.select(F.col("id").alias("symbol"), F.explode("throwTypes").alias("errorType"))
    _renew(graph, "throws", thrown.withColumns({"propagated": F.lit(False), "confidence": F.lit("exact")}), "symbol", changed)
    graph.upsert("error_flows", graph["throws"].select(F.substring_index("symbol", ":", 1).alias("repo"), "errorType").distinct())
    caught = facts.select(F.col("id").alias("symbol"), F.explode("caught").alias("c")).select("symbol", "c.errorType", "c.catchBlock")
    _renew(graph, "catches", caught, "symbol", changed)
    keys = F.concat(*[F.transform(f(F.col("body")), _as_key(p)) for f, p in ((extraction.env_keys, "process.env"), (extraction.config_keys, "config.get"))])
    read = facts.select("repo", F.col("id").alias("symbol"), F.inline(keys))
    graph.upsert("config_items", read.select("repo", "key").distinct())
    _renew(graph, "reads_config", read.drop("repo"), "symbol", changed)
    checks = facts.select("repo", F.col("id").alias("symbol"), F.inline(extraction.flag_checks(F.col("body"))))
    graph.upsert("flags", checks.select("repo", F.col("flag").alias("name"), extraction.flag_provider(F.col("method")).alias("providerHint")))
    _renew(graph, "reads_flag", checks.select("symbol", "flag", extraction.flag_kind(F.col("method")).alias("checkKind")), "symbol", changed)
    bound = cut(parsing.service_imports(imports, parsing.service_table(graph.spark)))
    graph.upsert("external_services", bound.select("repo", F.col("service").alias("name"), "protocol", F.lit("sdk-import").alias("detectionMethod")))
    graph["imports_service"] = cut(graph["imports_service"].join(changed.select("repo", F.col("filePath").alias("module")), ["repo", "module"], "left_anti"))
    graph.upsert("imports_service", bound.select("repo", F.col("filePath").alias("module"), "service"))
    spans = facts.select("repo", "filePath", F.col("id").alias("symbol"), "lineStart", "lineEnd")
    used = references.join(spans, ["repo", "filePath"]).where("line BETWEEN lineStart AND lineEnd").select("repo", "filePath", "symbol", "name").distinct()
    calling = parsing.service_calls(used, bound).withColumn("confidence", F.lit("inferred"))
    _renew(graph, "calls_service", calling, "symbol", changed)


def forget(graph: GraphBundle, files: DataFrame) -> None:
    """Removes files (repo, filePath) with their symbols and all edges from and to these.

    Packages, services, keys and error types stay: others may share them.
    """
    gone = cut(files.select(*FILE).distinct())
    as_ = lambda name: gone.withColumnRenamed("filePath", name)
    for name in OF_FILES:
        graph[name] = cut(graph[name].join(gone, FILE, "left_anti").select(*graph[name].columns))
    for name, owners in OF_SYMBOLS.items():
        rows = graph[name]
        for owner in owners:
            rows = _without(rows, owner, gone)
        graph[name] = cut(rows.select(*graph[name].columns))
    for name, columns in {"modules": ["path"], "imports": ["source", "target"], "imports_service": ["module"], "exports": ["module"]}.items():
        rows = graph[name]
        for column in columns:
            rows = rows.join(as_(column), ["repo", column], "left_anti")
        graph[name] = cut(rows.select(*graph[name].columns))


def follow(graph: GraphBundle, files: DataFrame, repos: DataFrame | None = None, before: list[Plugin] | None = None) -> dict:
    """Makes the graph what ``files`` are now: new and changed ones are indexed, missing ones forgotten.

    ``files`` are all files of the repositories in ``repos`` (repo), by default of those that have any. Modules
    that are only known as the target of an import have no hash and stay.
    """
    repos = cut((files if repos is None else repos).select("repo").distinct())
    known = graph["modules"].where("hash IS NOT NULL").join(repos, "repo", "left_semi").select("repo", F.col("path").alias("filePath"), "hash")
    gone = cut(changes(known, files.select("repo", "filePath", "hash"), FILE, "hash").where("event = 'deleted'").select(*FILE))
    forget(graph, gone)
    return index(graph, files, before) | {"deleted": gone.count()}
