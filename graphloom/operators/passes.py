"""Analysis passes over symbols, calls and commits."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphloom.functions.text import line_range
from graphloom.operators import rules
from graphloom.operators.traverse import neighbours, reversed_edges


def matches_any(path: Column, patterns: list[str]) -> Column:
    return reduce(lambda c, p: c | path.rlike(p), patterns[1:], path.rlike(patterns[0]))


def architectural_layer(path: Column, custom: list[tuple[str, str, int]] | None = None) -> Column:
    """Layer of a path; custom rules come first among those of the same priority."""
    path = F.replace(path, F.lit("\\"), F.lit("/"))
    ordered = sorted([*(custom or []), *rules.LAYERS], key=lambda r: -r[2])
    out = F.lit("unknown")
    for pattern, layer, _ in reversed(ordered):
        out = F.when(path.rlike(pattern), layer).otherwise(out)
    return out


def coverage_kind(path: Column) -> Column:
    return F.when(matches_any(path, rules.E2E), "e2e").when(matches_any(path, rules.INTEGRATION), "integration").otherwise("unit")


def public_api(symbols: DataFrame, modules: DataFrame) -> DataFrame:
    """``isPublicApi``: exported, not from a barrel, no ``_`` in front, not marked ``@internal``."""
    barrels = modules.where("isBarrel").select("repo", F.col("path").alias("filePath"), F.lit(True).alias("barrel")).distinct()
    rows = symbols.join(barrels, ["repo", "filePath"], "left")
    public = F.coalesce("isExported", F.lit(False)) & F.col("barrel").isNull() & ~F.col("name").startswith("_") & ~F.contains(F.coalesce("docstring", F.lit("")), F.lit("@internal"))
    return rows.withColumn("isPublicApi", public)


def content_hash(files: DataFrame, text: str = "text", start: str = "lineStart", end: str = "lineEnd") -> Column:
    return F.sha2(line_range(F.col(text), F.col(start), F.col(end)), 256)


def changed_files(files: DataFrame, stored: DataFrame) -> DataFrame:
    """Files whose repository, path and hash aren't stored."""
    return files.join(stored, ["repo", "path", "hash"], "left_anti")


def git_volatility(commits: DataFrame, now: Column, days: int = 90, author_days: int | None = None) -> DataFrame:
    """Of each file: commits per 30 days in the window, authors, and the age of its log.

    Authors are those of the last year, or of ``author_days``. Window bounds are inclusive.
    """
    in_window = F.col("ts") >= now - F.expr(f"INTERVAL {days} DAYS")
    recent = F.col("ts") >= (F.add_months(now, -12) if author_days is None else now - F.expr(f"INTERVAL {author_days} DAYS"))
    out = commits.groupBy("repo", "filePath").agg(
        F.round(F.count_if(in_window) / days * 30 + 1e-9, 3).alias("changeFrequency"),
        F.count_distinct(F.when(recent, F.lower("email"))).alias("authorCount"),
        F.max("ts").alias("lastModified"),
        F.min("ts").alias("oldest"),
    )
    seconds = F.unix_timestamp(now.cast("timestamp")) - F.unix_timestamp(F.col("oldest").cast("timestamp"))
    return out.withColumn("gitAge", F.greatest(F.lit(0), F.floor(seconds / 86400)).cast("int")).drop("oldest")


def throws_propagation(calls: DataFrame, throws: DataFrame, catches: DataFrame, depth: int = 5) -> DataFrame:
    """New edges ``sym_key``, ``errorType``: callers within ``depth`` of a thrower that don't catch.

    Only the caller's own catch counts, not one on the way. Errors go up the call graph instead
    of all pairs being expanded: a frontier holds each caller and error once.
    """
    from graphloom.checkpoints import cut

    up = cut(reversed_edges(calls).distinct())
    front = cut(throws.select(F.col("sym_key").alias("node"), "errorType").distinct())
    seen = None
    for _ in range(depth):
        front = front.join(up, F.col("node") == F.col("src")).select(F.col("dst").alias("node"), "errorType").distinct()
        front = cut(front if seen is None else front.join(seen, ["node", "errorType"], "left_anti"))
        if front.isEmpty():
            break
        seen = front if seen is None else seen.unionByName(front)
    found = (front if seen is None else seen).select(F.col("node").alias("sym_key"), "errorType")
    return found.join(catches, ["sym_key", "errorType"], "left_anti").join(throws, ["sym_key", "errorType"], "left_anti")


def test_asserts(symbols: DataFrame, calls: DataFrame, hops: int = 2, most: int = 10) -> DataFrame:
    """Test symbols with the production symbols they reach, at most so many by file and name."""
    is_test = matches_any(F.col("filePath"), rules.TESTS)
    tests = symbols.where(is_test).select(F.col("sym_key").alias("origin"), F.col("filePath").alias("testFile"))
    found = neighbours(calls, tests.select("origin"), hops).select("origin", "node").distinct()
    production = symbols.where(~is_test).select(F.col("sym_key").alias("node"), F.col("filePath").alias("prodFile"), F.col("name").alias("prodName"))
    rows = found.join(production, "node").join(tests, "origin")
    first = Window.partitionBy("origin").orderBy("prodFile", "prodName", "node")
    rows = rows.withColumn("k", F.row_number().over(first)).where(F.col("k") <= most)
    return rows.select(F.col("origin").alias("test_key"), F.col("node").alias("prod_key"), "testFile", coverage_kind(F.col("testFile")).alias("coverageKind"))


def bounded_context(paths: DataFrame, contexts: DataFrame) -> DataFrame:
    """First declared context of each path (``contextId``, null if none fits), and whether several fit.

    ``contexts`` has ``contextId``, ``pattern``, ``declarationOrder``, as many as there are. A
    pattern that ends in ``/`` is a prefix; another is a path or a folder. Each distinct path is
    taken apart into the paths and folders it lies in, which are joined with patterns by equality.
    """
    above = F.transform(F.sequence(F.lit(1), F.size("pieces") - 1), lambda i: F.array_join(F.slice("pieces", 1, i), "/"))
    keys = F.when(F.size("pieces") > 1, F.concat("above", F.transform("above", lambda p: F.concat(p, F.lit("/"))))).otherwise(F.array().cast("array<string>"))
    own = paths.select("path").where("path IS NOT NULL").distinct().withColumn("pieces", F.split("path", "/"))
    own = own.withColumn("above", F.when(F.size("pieces") > 1, above)).select("path", F.explode(F.array_distinct(F.concat(keys, F.array("path")))).alias("pattern"))
    hits = own.join(contexts, "pattern").groupBy("path").agg(F.min(F.struct("declarationOrder", "contextId"))["contextId"].alias("contextId"), (F.count_distinct("contextId") > 1).alias("ambiguous"))
    return paths.join(hits, "path", "left").select(*paths.columns, "contextId", F.coalesce("ambiguous", F.lit(False)).alias("ambiguous"))


def governs(declared: DataFrame, documents: DataFrame, symbols: DataFrame) -> DataFrame:
    """Edges from declarations (``doc_path``, ``repo`` or null, ``filePath``, ``name``) that resolve."""
    rows = declared.join(documents.select(F.col("path").alias("doc_path")).distinct(), "doc_path", "left_semi")
    keys = symbols.select("sym_key", F.col("repo").alias("r"), "filePath", "name")
    return rows.join(keys, ["filePath", "name"]).where(F.col("repo").isNull() | (F.col("repo") == F.col("r"))).select("doc_path", "sym_key").distinct()


def stale(symbols: DataFrame, summaries: DataFrame) -> DataFrame:
    """Summaries made from another content than their symbol's."""
    rows = summaries.join(symbols.select(F.col("id").alias("symbolFqn"), "hash").hint("merge"), "symbolFqn")
    return rows.where(F.col("hash").isNotNull() & (F.col("contentHash") != F.col("hash")))
