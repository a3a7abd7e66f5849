"""References from markdown to code, and how they resolve."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphloom.checkpoints import cut
from graphloom.functions import frontmatter
from graphloom.operators import rules
from graphloom.operators.near_names import nearest


REFERENCE = "struct<channel:string,repo:string,filePath:string,name:string>"


def _all(text: Column, pattern: str, group: int = 1) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(group))


def inline_code(body: Column) -> Column:
    """Identifiers in inline code with a capital, once each."""
    found = _all(body, r"`([A-Za-z_$][A-Za-z0-9_$]{2,})`")
    return F.array_distinct(F.filter(found, lambda x: x.rlike("[A-Z]") & ~F.lower(x).isin(rules.NO_IDENTIFIERS)))


def fenced_imports(body: Column) -> Column:
    """Relative paths that fenced code imports or requires, once each."""
    fences = _all(body, r"(?s)```[^\n]*\n(.*?)```")
    each = F.flatten(F.transform(fences, lambda f: F.concat(_all(f, r"require\(\s*['\"]([^'\"]+)['\"]"), _all(f, r"import\s[^;'\"]*['\"]([^'\"]+)['\"]"))))
    return F.array_distinct(F.filter(each, lambda p: p.startswith(".")))


def graph_links(body: Column) -> Column:
    """``repo``, ``filePath`` and ``name`` of each link to a symbol; repeats stay."""
    pattern = r"graph://symbol/([^/\s)#]+)/([^\s)#]+)#([A-Za-z0-9_$]+)"
    return F.arrays_zip(_all(body, pattern, 1).alias("repo"), _all(body, pattern, 2).alias("filePath"), _all(body, pattern, 3).alias("name"))


def to_scan(docs: DataFrame, prefix: str = "") -> DataFrame:
    """Markdown documents (path, body, lastEnrichedHash) that changed since they were last read; with ``hash``."""
    rows = docs.where(F.col("path").endswith(".md") & F.col("path").startswith(prefix) & ~F.col("path").startswith("concepts/") & ~F.col("path").startswith("doc-graph-runs/"))
    rows = rows.withColumn("hash", F.sha2("body", 256))
    return rows.where(~F.col("hash").eqNullSafe(F.col("lastEnrichedHash")))


def declared(docs: DataFrame, keys: tuple[str, ...] = ("symbols",)) -> DataFrame:
    """Symbols that frontmatter lists under ``keys``: doc_path, repo or null, filePath or null, name.

    An item is ``repo:path#name``, ``path#name`` or a name.
    """
    item = declared_part(F.col("item"))
    rows = docs.select(F.col("path").alias("doc_path"), F.explode(declared_items(F.col("body"), keys)).alias("item"))
    return rows.select("doc_path", item(1).alias("repo"), item(2).alias("filePath"), item(3).alias("name")).where("name IS NOT NULL")


def declared_items(body: Column, keys: tuple[str, ...]) -> Column:
    """What frontmatter lists under ``keys``, without quotes."""
    block = F.concat(F.regexp_replace(F.regexp_extract(body, r"(?s)^---\r?\n(.*?)\r?\n---", 1), "\r", ""), F.lit("\n"))
    return F.concat(*[F.transform(frontmatter.list_field(block, k), lambda x: F.regexp_replace(x, "^[\"']|[\"']$", "")) for k in keys])


def declared_part(item: Column):
    """Repository (1), path (2) or name (3) of an item; null if it has none."""

    def part(i: int) -> Column:
        found = F.regexp_extract(item, r"^(?:([^:#]+):)?(?:([^#]+)#)?([^#]+)$", i)
        return F.when(found != "", found)

    return part


def declared_symbols(docs: DataFrame) -> DataFrame:
    """What ``governs`` and ``symbols`` list by path and name."""
    return declared(docs, ("governs", "symbols")).where("filePath IS NOT NULL")


def references(docs: DataFrame) -> DataFrame:
    """A row for each reference of ``docs`` (path, service, body): channel, repo, filePath, name. Texts are read once."""
    none = F.lit(None).cast("string")
    ref = lambda channel, repo, path, name: F.struct(F.lit(channel).alias("channel"), repo.alias("repo"), path.alias("filePath"), name.alias("name"))
    body, stem = F.col("body"), lambda p: F.regexp_replace(F.element_at(F.split(p, "/"), -1), r"\.[^.]*$", "")
    found = [
        F.transform(inline_code(body), lambda n: ref("inline", none, none, n)),
        F.transform(fenced_imports(body), lambda p: ref("fenced", none, p, stem(p))),
        F.transform(graph_links(body), lambda x: ref("link", x["repo"], x["filePath"], x["name"])),
        F.filter(F.transform(declared_items(body, ("symbols",)), lambda x: ref("frontmatter", *map(declared_part(x), (1, 2, 3)))), lambda r: r["name"].isNotNull()),
    ]
    every = F.concat(*[F.coalesce(f, F.array().cast(f"array<{REFERENCE}>")) for f in found])
    return docs.select("path", "service", F.inline(every))


#: Score from which on a name resolves to one like it; 1 and more turn this off.
FUZZY = 0.6


def resolve(refs: DataFrame, symbols: DataFrame, modules: DataFrame, threshold: float = FUZZY) -> DataFrame:
    """References with ``target`` (a symbol's id or a module's path) and ``how``.

    In order: repository, file and name; a fenced path's module by its last segment (nothing
    else follows for those); service and name; the most alike name, of the service's if there is
    one. Of several the least key is taken. Symbols and names grow with the graph and are shuffled, never sent to the driver.
    """
    exact = symbols.groupBy("repo", "filePath", "name").agg(F.min("id").alias("exact"))
    by_service = symbols.groupBy(F.col("repo").alias("service"), "name").agg(F.min("id").alias("by_service"))
    segment = lambda c: F.regexp_replace(F.element_at(F.split(c, "/"), -1), r"\.(js|ts)$", "")
    by_segment = modules.groupBy(segment(F.col("path")).alias("segment")).agg(F.min("path").alias("module"))
    rows = refs.join(exact.hint("merge"), ["repo", "filePath", "name"], "left").join(by_service.hint("merge"), ["service", "name"], "left")
    rows = rows.withColumn("segment", F.when(F.col("channel") == "fenced", segment(F.col("filePath")))).join(by_segment, "segment", "left")
    fenced = F.col("channel") == "fenced"
    rows = rows.withColumn("found", F.when(fenced, F.col("module")).otherwise(F.coalesce("exact", "by_service")))
    how = F.when(F.col("found").isNull(), "unresolved").when(fenced, "module").when(F.col("exact").isNotNull(), "exact").otherwise("service")
    rows = rows.select("path", "service", "channel", "name", "found", how.alias("how"))
    if threshold >= 1:
        return rows.select("path", "channel", "name", F.col("found").alias("target"), "how")
    rows = cut(rows)  # for two uses, so that documents are read once
    lost = (F.col("how") == "unresolved") & ~fenced
    like = fuzzy(rows.where(lost).select("service", "name").distinct(), symbols, threshold)
    like = like.select(F.col("service").alias("s"), F.col("name").alias("n"), F.col("id").alias("like"))
    rows = rows.join(like.hint("merge"), F.col("service").eqNullSafe(F.col("s")) & (F.col("name") == F.col("n")) & lost, "left")
    return rows.select("path", "channel", "name", F.coalesce("found", "like").alias("target"), F.when(F.col("like").isNotNull(), "fuzzy").otherwise(F.col("how")).alias("how"))


def bigrams(name: Column) -> Column:
    """Distinct pairs of neighbouring letters, in any case; a name of one letter is its own pair."""
    low = F.lower(name)
    return F.when(F.length(low) > 1, F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(low) - 1), lambda i: F.substring(low, i, F.lit(2))))).otherwise(F.array(low))


def _marked(names: DataFrame, column: str) -> DataFrame:
    """Each distinct name ``w`` once: its bigrams ``g``, their number ``n``, and 128 bits that they set."""
    bits = lambda k: F.expr(f"aggregate(g, 0L, (a, x) -> a | IF(pmod(xxhash64(x), 128) DIV 64 = {k}, shiftleft(1L, CAST(pmod(xxhash64(x), 64) AS INT)), 0L))")
    rows = names.select(F.col(column).alias("w")).where(F.length("w") > 0).distinct().withColumn("g", bigrams(F.col("w")))
    return rows.select("w", "g", F.size("g").alias("n"), bits(0).alias("low"), bits(1).alias("high"))


def similar_names(asked: DataFrame, known: DataFrame, threshold: float) -> DataFrame:
    """``name``, ``symbol``, ``score``: pairs of names whose bigrams have Dice's coefficient of at least ``threshold``.

    ``asked`` and ``known`` have a column ``name``. A set similarity join: pairs meet at one of their rarest
    bigrams, as many as the threshold asks for, so none is missed. Of those that meet, only pairs
    go on that may still have enough in common: by their numbers of bigrams, by how many follow the
    one they met at, and by bits that one sets and the other doesn't. What is left is compared.
    """
    left, right = cut(_marked(asked, "name")), cut(_marked(known, "name"))
    df = right.select(F.explode("g").alias("b")).groupBy("b").agg(F.count("*").alias("df"))
    rarest = Window.partitionBy("w").orderBy(F.coalesce("df", F.lit(0)), "b")
    least = F.ceil(F.col("n") * threshold / (2 - threshold) - 1e-9)

    def first(words: DataFrame, p: str) -> DataFrame:
        rows = words.select("w", "n", "low", "high", F.explode("g").alias("b")).join(df, "b", "left").withColumn("at", F.row_number().over(rarest))
        return rows.where(F.col("at") <= F.col("n") - least + 1).select("b", *[F.col(c).alias(p + c) for c in ("w", "n", "at", "low", "high")])

    total = F.col("l_n") + F.col("r_n")
    common = F.ceil(total * threshold / 2 - 1e-9)
    follow = 1 + F.least(F.col("l_n") - F.col("l_at"), F.col("r_n") - F.col("r_at"))
    apart = F.bit_count(F.col("l_low").bitwiseXOR(F.col("r_low"))) + F.bit_count(F.col("l_high").bitwiseXOR(F.col("r_high")))
    x, y = first(left, "l_"), first(right, "r_").withColumnRenamed("b", "c")
    pairs = x.join(y.hint("merge"), (F.col("b") == F.col("c")) & (F.least("l_n", "r_n") >= common) & (follow >= common) & (apart <= total - 2 * common)).select("l_w", "r_w").distinct()
    pairs = pairs.join(left.select(F.col("w").alias("l_w"), "g").hint("merge"), "l_w").join(right.select(F.col("w").alias("r_w"), F.col("g").alias("h")).hint("merge"), "r_w")
    score = 2.0 * F.size(F.array_intersect("g", "h")) / (F.size("g") + F.size("h"))
    return pairs.select(F.col("l_w").alias("name"), F.col("r_w").alias("symbol"), score.alias("score")).where(F.col("score") >= threshold - 1e-9)


def fuzzy(refs: DataFrame, symbols: DataFrame, threshold: float = FUZZY) -> DataFrame:
    """The most alike symbol of each (service, name), its bigrams' coefficient at least ``threshold``.

    A service takes symbols of its repository only. Who has a near one isn't compared with all that are farther (``near_names``).
    """
    return nearest(refs, symbols, threshold)


def reference_edges(resolved: DataFrame, order: list[str]) -> tuple[DataFrame, DataFrame]:
    """Edges of resolved references: those documented by, from frontmatter, and references with
    confidence and channel; of a document and target the last in ``order``."""
    hit = resolved.where(F.col("target").isNotNull())
    documented = hit.where("channel = 'frontmatter'").select(F.col("path").alias("doc_path"), F.col("target").alias("symbol")).distinct()
    confidence = F.when(F.col("how") == "fuzzy", "inferred").otherwise("exact")
    last = hit.withColumn("confidence", confidence).groupBy(F.col("path").alias("doc_path"), "target").agg(F.max_by(F.struct("confidence", "channel"), F.struct(*order)).alias("e"))
    return documented, last.select("doc_path", "target", "e.confidence", "e.channel")


def with_section(body: Column, section: Column) -> Column:
    """``body`` with the section between its marks; at the end if it has no marks, as it is if one."""
    begin, end = F.lit(rules.RELATED_BEGIN), F.lit(rules.RELATED_END)
    at, to = F.instr(body, begin), F.instr(body, end)
    block = F.concat(begin, F.lit("\n"), section, F.lit("\n"), end)
    inside = F.concat(F.substring(body, F.lit(1), at - 1), block, F.substring(body, to + len(rules.RELATED_END), F.length(body)))
    return F.when((at > 0) & (to > at), inside).when((at == 0) & (to == 0), F.concat(F.rtrim(body), F.lit("\n\n"), block, F.lit("\n"))).otherwise(body)


def fill_template(template: Column, values: dict[str, Column]) -> Column:
    """``{{key}}`` replaced as it stands; keys without a value stay."""
    out = template
    for key, value in values.items():
        out = F.replace(out, F.lit("{{" + key + "}}"), value)
    return out


def chunks(docs: DataFrame) -> DataFrame:
    """``docs`` cut before each first or second level heading: ``path``, ``chunk``, ``text``."""
    parts = F.filter(F.split("body", r"(?m)(?=^#{1,2}\s)"), lambda c: F.trim(c) != "")
    return docs.select("path", F.posexplode(parts).alias("chunk", "text"))


def n_words(text: Column) -> Column:
    return F.size(F.filter(F.split(F.trim(text), r"\s+"), lambda w: w != ""))


def mention_merge(mentions: DataFrame) -> DataFrame:
    """Of each concept and document the greatest confidence and the latest evidence."""
    return mentions.groupBy("concept", "doc").agg(F.max("confidence").alias("confidence"), F.max_by("evidence", F.struct("at", "evidence")).alias("evidence"))
