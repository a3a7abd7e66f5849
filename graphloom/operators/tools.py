"""The query tools as functions from tables to a DataFrame.

Tables are keyed as in the graph: symbols have ``sym_key`` and ``id``, edges ``src`` and ``dst``.
Branches of a result are aggregated before they are joined, so that none multiplies another.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphloom.functions.text import cosine
from graphloom.operators.traverse import neighbours, reversed_edges


def clamp(limit: int, most: int) -> int:
    return max(0, min(limit, most))


def find_symbol(symbols: DataFrame, name: str, kind: str | None = None, repo: str | None = None, file_path: str | None = None, limit: int = 20) -> DataFrame:
    """Symbols whose name holds ``name``, in its case; other filters as given."""
    conditions = [F.contains("name", F.lit(name))]
    conditions += [F.col(c) == v for c, v in (("kind", kind), ("repo", repo)) if v is not None]
    conditions += [F.contains("filePath", F.lit(file_path))] if file_path is not None else []
    return symbols.where(reduce(Column.__and__, conditions)).orderBy("name", "id").limit(clamp(limit, 100))


def named(symbols: DataFrame, key: str) -> DataFrame:
    """The symbols with an id or a name."""
    return symbols.where((F.col("id") == key) | (F.col("name") == key))


def related(symbols: DataFrame, calls: DataFrame, key: str, depth: int = 3, callers: bool = True) -> DataFrame:
    """Symbols that reach the named ones within 1 to 5 calls, or that these reach; without them."""
    targets = named(symbols, key).select(F.col("sym_key").alias("origin"))
    found = neighbours(reversed_edges(calls) if callers else calls, targets, max(1, min(depth, 5)))
    found = found.groupBy(F.col("node").alias("sym_key")).agg(F.min("depth").alias("depth"))
    found = found.join(targets.select(F.col("origin").alias("sym_key")), "sym_key", "left_anti")
    return symbols.join(found, "sym_key").select("id", "name", "filePath", "depth")


def impact_of(symbols: DataFrame, calls: DataFrame, throws: DataFrame, key: str, depth: int = 3) -> DataFrame:
    """The origin, how many callers it has within ``depth``, and the errors it throws itself."""
    origin = named(symbols, key).select("sym_key", "id")
    found = neighbours(reversed_edges(calls), origin.select(F.col("sym_key").alias("origin")), max(1, min(depth, 5)))
    callers = found.where("node <> origin").groupBy(F.col("origin").alias("sym_key")).agg(F.count_distinct("node").alias("callers"))
    errors = throws.groupBy("sym_key").agg(F.array_join(F.array_sort(F.collect_set("errorType")), ",").alias("thrown"))
    rows = origin.join(callers, "sym_key", "left").join(errors, "sym_key", "left")
    return rows.select("id", F.coalesce("callers", F.lit(0)).cast("long").alias("callers"), F.coalesce("thrown", F.lit("")).alias("thrown"))


def module_graph(modules: DataFrame, imports: DataFrame, repo: str, prefix: str | None = None, limit: int = 50) -> DataFrame:
    """The first modules of a repository by path, each with the modules that it imports."""
    rows = modules.where(F.col("repo") == repo)
    rows = rows if prefix is None else rows.where(F.col("path").startswith(prefix))
    first = rows.select("path").orderBy("path").limit(clamp(limit, 200))
    edges = imports.where(F.col("repo") == repo).select(F.col("source").alias("path"), "target")
    return first.join(edges, "path", "left")


def service_topology(services: DataFrame, importing: DataFrame, calling: DataFrame) -> DataFrame:
    """Each service name's protocol and callers (``repo/module``), over all repositories.

    ``importing`` has ``repo``, ``module``, ``service``; ``calling`` likewise, of modules that
    hold a symbol which calls the service.
    """
    callers = importing.unionByName(calling).select(F.col("service").alias("name"), F.concat_ws("/", "repo", "module").alias("caller")).distinct()
    lists = callers.groupBy("name").agg(F.array_join(F.array_sort(F.collect_list("caller")), ",").alias("callers"), F.count("*").alias("n_callers"))
    kinds = services.groupBy("name").agg(F.min_by("protocol", "repo").alias("protocol"))
    return kinds.join(lists, "name", "left").select("name", "protocol", F.coalesce("callers", F.lit("")).alias("callers"), F.coalesce("n_callers", F.lit(0)).cast("long").alias("n_callers"))


def symbol_context(symbols: DataFrame, calls: DataFrame, summaries: DataFrame, documents: DataFrame, layer: Column, most: int = 5) -> DataFrame:
    """Of each symbol its layer, community, first callers and callees by name, and documents."""
    names = symbols.select("sym_key", "name")

    def first(edges: DataFrame, alias: str) -> DataFrame:
        rows = edges.join(names, F.col("dst") == F.col("sym_key")).select(F.col("src").alias("key"), "name").distinct()
        rows = rows.withColumn("at", F.row_number().over(Window.partitionBy("key").orderBy("name"))).where(F.col("at") <= most)
        return rows.groupBy("key").agg(F.array_join(F.array_sort(F.collect_list("name")), ",").alias(alias))

    docs = documents.groupBy(F.col("sym_key").alias("key")).agg(F.array_join(F.array_sort(F.collect_set("doc_path")), ",").alias("docs"))
    out = symbols.withColumn("layer", layer)
    for branch in (first(reversed_edges(calls), "callers"), first(calls, "callees"), docs):
        out = out.join(branch, F.col("sym_key") == F.col("key"), "left").drop("key")
    has = summaries.select(F.col("symbolFqn").alias("id"), F.lit(True).alias("has")).distinct()
    return out.join(has, "id", "left").withColumn("summaryAvailable", F.coalesce("has", F.lit(False))).drop("has")


def top_symbols(symbols: DataFrame, by: str, group: str, most: int = 10) -> DataFrame:
    """The first symbols of each group by a metric, ties by key."""
    order = Window.partitionBy(group).orderBy(F.desc(by), "sym_key")
    return symbols.withColumn("at", F.row_number().over(order)).where(F.col("at") <= most)


def related_docs(links: DataFrame, documents: DataFrame, keys: list[str]) -> DataFrame:
    """Per key the distinct documents, each as its path; ``links`` has ``doc_path``."""
    rows = links.join(documents.select(F.col("path").alias("doc_path")), "doc_path", "left_semi")
    return rows.groupBy(*keys).agg(F.array_join(F.array_sort(F.collect_set("doc_path")), ",").alias("docs"))


def vector_top_k(query: list[float], vectors: DataFrame, k: int = 5, vector: str = "embedding", tie: str = "vec_id") -> DataFrame:
    """The nearest to one query vector by cosine, as ``(1 + cos) / 2``; k from 1 to 20, else 5."""
    k = 5 if k <= 0 else min(k, 20)
    score = (1 + cosine(F.col(vector), F.array(*[F.lit(float(x)) for x in query]))) / 2
    return vectors.withColumn("score", score).orderBy(F.desc("score"), tie).limit(k)


def diagnostics(tables: dict[str, DataFrame]) -> DataFrame:
    """How many rows each table has."""
    return reduce(DataFrame.unionByName, [t.agg(F.count("*").alias("n")).select(F.lit(name).alias("label"), "n") for name, t in tables.items()])


def coverage(symbols: DataFrame, by: list[str]) -> DataFrame:
    """Summary coverage from one row a symbol (``tier`` or null, ``stale``).

    Cost estimates take fixed values a symbol: 0.003 for one without a summary, 0.0025 for a
    provisional one.
    """
    total, have = F.count("*"), F.count("tier")
    rows = symbols.groupBy(*by) if by else symbols.groupBy()
    provisional = F.count_if(F.col("tier") == "provisional")
    return rows.agg(
        total.alias("total"),
        F.count_if(F.col("tier") == "canonical").alias("canonical"),
        provisional.alias("provisional"),
        F.count_if("stale").alias("stale"),
        F.greatest(F.lit(0), total - have).alias("unsummarised"),
        F.round(F.coalesce(100.0 * have / F.when(total > 0, total), F.lit(0.0)) + 1e-9, 1).alias("pct"),
        F.round((total - have) * 0.003 + provisional * 0.0025 + 1e-9, 4).alias("cost"),
    )


#: Nodes of a parsed plan that only read.
READING = {
    "Project", "Filter", "Aggregate", "Sort", "Distinct", "Deduplicate", "Join", "LateralJoin", "AsOfJoin", "Union", "Intersect", "Except",
    "GlobalLimit", "LocalLimit", "Offset", "Tail", "Sample", "SubqueryAlias", "OneRowRelation", "LocalRelation", "Range", "Generate", "Expand",
    "Window", "WithWindowDefinition", "With", "UnresolvedWith", "CTERelationDef", "CTERelationRef", "Pivot", "Unpivot", "UnresolvedHint", "ResolvedHint",
    "UnresolvedRelation", "UnresolvedInlineTable", "UnresolvedTableValuedFunction", "UnresolvedTVFAliases", "UnresolvedSubqueryColumnAliases",
    "UnresolvedHaving", "Repartition", "RepartitionByExpression", "View", "UnionLoop", "UnionLoopRef",
}


def _reads(name: str, simple: str) -> bool:
    return simple in READING and name.startswith("org.apache.spark.sql.catalyst.")


def _items(seq) -> list:
    out, items = [], seq.iterator()
    while items.hasNext():
        out.append(items.next())
    return out


def _nodes(plan) -> list:
    """All nodes of a parsed plan, those of its subqueries and named parts with them."""
    found, todo = [], [plan]
    while todo:
        node = todo.pop()
        found.append(node)
        todo += [*_items(node.children()), *_items(node.innerChildren()), *_items(node.subqueries())]
    return found


def _functions(plan) -> set[str]:
    """Names of the functions that a node calls."""
    found, todo = set(), _items(plan.expressions())
    while todo:
        e = todo.pop()
        todo += _items(e.children())
        if e.getClass().getSimpleName() == "UnresolvedFunction":
            found.add(_items(e.nameParts())[-1].lower())
    return found


#: Functions that run any Java method.
CALLING = {"java_method", "reflect", "try_reflect"}


def open_query(spark, text: str, limit: int = 1000) -> DataFrame:
    """Rows of a read-only query, at most ``limit`` and one more to show that there are others.

    Spark parses the text; what isn't a query (it has a command or writes) is rejected.
    """
    plan = spark._jsparkSession.sessionState().sqlParser().parsePlan(text)
    nodes = _nodes(plan)
    kinds = [n.getClass() for n in nodes]
    wrong = sorted({k.getSimpleName() for k in kinds if not _reads(k.getName(), k.getSimpleName())} | {f for n in nodes for f in _functions(n) & CALLING})
    if wrong:
        raise ValueError(f"only queries are allowed, not {', '.join(wrong)}")
    return spark.sql(text).limit(limit + 1)
