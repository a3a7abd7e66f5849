"""Code facts from source text, as jobs over lines and calls.

Source text is cut into lines and calls by patterns in Spark's own functions; there is no parser
of the language. So declarations and calls are found at statement level, which is what the
graph needs, and not inside strings that span lines or generated code.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphloom.functions.text import joined_path, package_name
from graphloom.operators import rules


def _all(text: Column, pattern: str, group: int = 1) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(group))


def lines(files: DataFrame) -> DataFrame:
    """A row for each line of ``files`` (repo, filePath, text)."""
    return files.select("repo", "filePath", F.posexplode(F.split("text", "\n")).alias("at", "line")).withColumn("lineNo", F.col("at") + 1).drop("at")


def modules(files: DataFrame) -> DataFrame:
    """A row for each file: loc, module system, barrel, side effects of a plain kind."""
    text = F.col("text")
    esm = text.rlike(r"(?m)^\s*(import\s|export\s*(\{|\*|default\b))")
    cjs = F.contains(text, F.lit("require(")) | F.contains(text, F.lit("module.exports"))
    system = F.when(esm & cjs, "mixed").when(esm, "esm").when(cjs, "cjs").otherwise("none")
    declares = text.rlike(r"(?m)^(export\s+)?(default\s+)?(async\s+)?(function|class|const|let|var)\b")
    barrel = text.rlike(r"(?m)^export\s+(\*|\{[^}]*\})\s+from\s") & ~declares
    return files.select("repo", F.col("filePath").alias("path"), F.when(F.col("filePath").rlike(r"\.[mc]?tsx?$"), "typescript").otherwise("javascript").alias("language"), F.when(F.col("filePath").rlike(r"\.[jt]sx$"), "jsx").alias("dialect"), F.size(F.split(text, "\n")).alias("loc"), F.sha2(text, 256).alias("hash"), system.alias("moduleSystem"), barrel.alias("isBarrel"), text.rlike(r"(?m)^[A-Za-z_$][\w$.]*\(").alias("hasSideEffects"))


DECLARATION = r"^(export\s+)?(default\s+)?(async\s+)?(function\*?|class|const|let|var)\s+([A-Za-z_$][\w$]*)(.*)$"


def outside_comments(files: DataFrame) -> DataFrame:
    """The lines that don't begin inside a block comment."""
    n = lambda p: F.size(F.split("line", p)) - 1
    before = Window.partitionBy("repo", "filePath").orderBy("lineNo").rowsBetween(Window.unboundedPreceding, -1)
    rows = lines(files).withColumn("open", F.coalesce(F.sum(n(r"/\*") - n(r"\*/")).over(before), F.lit(0)))
    return rows.where("open <= 0").drop("open")


def symbols(files: DataFrame) -> DataFrame:
    """Top-level functions, classes and variables.

    A symbol whose line leaves something open ends at the next line that begins with a closing
    bracket, before the next symbol; any other ends on its line.
    """
    part = lambda i: F.regexp_extract("line", DECLARATION, i)
    starts, closes = F.col("line").rlike(DECLARATION), F.col("line").rlike(r"^[}\])]")
    rows = outside_comments(files).where(starts | closes)
    later = Window.partitionBy("repo", "filePath").orderBy(F.desc("lineNo")).rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumns({"closed": F.last(F.when(closes, F.col("lineNo")), ignorenulls=True).over(later), "next": F.last(F.when(starts, F.col("lineNo")), ignorenulls=True).over(later)})
    rows = rows.where(starts).select("repo", "filePath", "line", "closed", "next", F.col("lineNo").alias("lineStart"), F.trim(part(1)).alias("e"), F.trim(part(2)).alias("d"), F.trim(part(3)).alias("a"), part(4).alias("k"), part(5).alias("name"), part(6).alias("rest"))
    variable = F.col("k").isin("const", "let", "var")
    arrow = F.col("rest").rlike(r"^\s*=\s*(async\s+)?(function\b|\([^)]*\)\s*=>|[A-Za-z_$][\w$]*\s*=>)")
    kind = F.when(F.col("k") == "class", "class").when(variable & ~arrow, "variable").otherwise("function")
    generator = (F.col("k") == "function*") | F.col("rest").rlike(r"^\s*=\s*(async\s+)?function\s*\*")
    is_async = ((F.col("a") == "async") | F.col("rest").rlike(r"^\s*=\s*async\b")) & ~generator
    n = lambda p: F.size(F.split("line", p)) - 1
    unfinished = F.col("line").rlike(r"(=>|[=,(\[{])\s*$") | (n(r"[\[({]") > n(r"[\])}]"))
    end = F.when(unfinished & (F.col("closed") < F.coalesce("next", F.lit(2**31 - 1))), F.col("closed")).when(unfinished, F.col("next") - 1)
    signature = F.when(kind != "variable", F.trim(F.regexp_replace("line", r"\s*(\{.*|=>.*)?$", "")))
    return rows.select("repo", "filePath", "name", kind.alias("kind"), F.when(F.col("k") == "var", "function").otherwise("block").alias("scopeKind"), (F.col("e") != "").alias("isExported"), F.when(F.col("d") != "", "default").when(F.col("e") != "", "named").alias("exportKind"), is_async.alias("isAsync"), generator.alias("isGenerator"), "lineStart", F.coalesce(end, F.col("lineStart")).cast("int").alias("lineEnd"), signature.alias("signature"))


def imports(files: DataFrame) -> DataFrame:
    """``source``, ``spec``, kind and either a local ``target`` or an external ``package``."""
    pattern = r"(?m)^\s*import\s+(type\s+)?(?:([^'\";]*?)\s+from\s+)?['\"]([^'\"]+)['\"]"
    zipped = F.arrays_zip(_all(F.col("text"), pattern, 1).alias("t"), _all(F.col("text"), pattern, 2).alias("what"), _all(F.col("text"), pattern, 3).alias("spec"))
    rows = files.select("repo", F.col("filePath").alias("source"), F.inline(zipped))
    local = F.col("spec").startswith(".")
    kind = F.when(F.col("t") != "", "type").when(F.col("what").rlike(r"\*\s+as\s"), "namespace").otherwise("value")
    rows = rows.select("repo", "source", "spec", "what", kind.alias("kind"), F.when(~local, package_name(F.col("spec"))).alias("package"), local.alias("local"))
    return rows.withColumn("target", F.when(F.col("local"), joined_path(F.col("source"), F.col("spec"))))


CALL = r"(?<![\w$.])((?:new\s+)?[A-Za-z_$][\w$]*+(?:\.[A-Za-z_$][\w$]*+)*+)\s*\((?=(?:([^()]*)(\)))?)"
#: Words before a parenthesis that are no callee.
NO_CALLEES = ["if", "for", "while", "switch", "catch", "function", "return", "typeof", "super", "await", "async", "do", "else", "with"]


def call_sites(files: DataFrame) -> DataFrame:
    """Calls by line: callee of at most 200 characters, its arguments, and whether it makes an object.

    Arguments are counted where they stand on the line and hold no calls; else their number is null.
    """
    code = F.regexp_replace("line", r"//.*$|'[^'\n]*'|\"[^\"\n]*\"", "''")
    found = F.arrays_zip(*[_all(code, CALL, i).alias(n) for i, n in ((1, "c"), (2, "args"), (3, "end"))])
    rows = outside_comments(files).where(~F.col("line").rlike(r"^\s*//")).select("repo", "filePath", F.col("lineNo").alias("line"), F.inline(found))
    callee = F.regexp_replace("c", r"^new\s+", "")
    count = F.when(F.col("end") != "", F.when(F.trim("args") == "", 0).otherwise(F.size(F.split("args", ","))))
    rows = rows.select("repo", "filePath", "line", F.substring(callee, 1, 200).alias("callee"), F.col("c").rlike(r"^new\s").alias("isNew"), count.cast("int").alias("argumentCount"))
    declared = F.regexp_extract("callee", r"^(\w+)", 1)
    return rows.where(~declared.isin(NO_CALLEES))


def effect(callee: Column) -> Column:
    """Effect of a call by its callee; the first rule that matches, else null."""
    out = F.lit(None).cast("string")
    for pattern, kind in reversed(rules.EFFECTS):
        out = F.when(callee.rlike(pattern), kind).otherwise(out)
    return out


def has_io(kinds: Column) -> Column:
    return F.arrays_overlap(kinds, F.array(*[F.lit(k) for k in rules.IO_EFFECTS]))


def env_keys(body: Column) -> Column:
    """Names read from the process environment, once each, in order."""
    return F.array_distinct(_all(body, r"process\.env(?:\.|\[['\"])([A-Za-z_]\w*)"))


def config_keys(body: Column) -> Column:
    return F.array_distinct(_all(body, r"\b(?:config|Config|configuration|settings|cfg)\.get\(\s*['\"]([^'\"]+)['\"]"))


def flag_checks(body: Column) -> Column:
    """``method`` and ``flag`` of each check with a literal name."""
    names = "|".join(m for m, _, _ in rules.FLAGS)
    pattern = rf"\b({names})\(\s*['\"]([^'\"]+)['\"]"
    return F.arrays_zip(_all(body, pattern, 1).alias("method"), _all(body, pattern, 2).alias("flag"))


def flag_provider(method: Column) -> Column:
    return reduce(lambda c, r: F.when(method == r[0], r[1]).otherwise(c), rules.FLAGS, F.lit("custom"))


def flag_kind(method: Column) -> Column:
    """How a check reads its flag: a variant, or whether it is on."""
    return reduce(lambda c, r: F.when(method == r[0], r[2]).otherwise(c), rules.FLAGS, F.lit("is-enabled"))


def thrown(body: Column) -> Column:
    """Types of thrown errors, once each: the last name of the expression, else ``Error``."""
    found = _all(body, r"\bthrow\s+(?:new\s+)?([A-Za-z_$][\w$.]*)?")
    return F.array_distinct(F.transform(found, lambda x: F.when(x == "", "Error").otherwise(F.element_at(F.split(x, r"\."), -1))))


def docstring(text: Column) -> Column:
    """Words of the last doc comment, without tags; null if there is none."""
    blocks = _all(text, r"(?s)/\*\*(.*?)\*/")
    kept = F.filter(F.transform(F.split(F.element_at(blocks, -1), "\n"), lambda s: F.trim(F.regexp_replace(s, r"^\s*\*?\s?", ""))), lambda s: (s != "") & ~s.startswith("@"))
    out = F.array_join(kept, "\n")
    return F.when((F.size(blocks) > 0) & (out != ""), out)


def comments(files: DataFrame) -> DataFrame:
    """Comments with kind, text of at most 2000 characters and whether they hold tags."""
    pattern = r"(?s)(/\*.*?\*/|//[^\n]*)"
    rows = files.select("repo", "filePath", F.explode(_all(F.col("text"), pattern)).alias("c"))
    kind = F.when(F.col("c").startswith("//"), "line").when(F.col("c").startswith("/**"), "jsdoc").when(F.col("c").rlike("(?i)copyright|license|spdx"), "license").otherwise("block")
    return rows.select("repo", "filePath", kind.alias("kind"), F.substring("c", 1, 2000).alias("text"), F.col("c").rlike(r"@\w+").alias("hasDocTags"))


def innermost(sites: DataFrame, symbols: DataFrame) -> DataFrame:
    """``src``, the id of the innermost symbol around each line (repo, filePath, line); of equal spans the least.

    A span meets lines in cells of its file that are longer than itself, so that it is in two at most. A
    line is in one cell of each such length. Files of many symbols aren't compared line by span.
    """
    spans = symbols.where("lineEnd >= lineStart").groupBy("repo", "filePath", "lineStart", "lineEnd").agg(F.min("id").alias("src"))
    spans = spans.withColumn("bits", F.length(F.bin((F.col("lineEnd") - F.col("lineStart")).cast("long"))))
    most = spans.agg(F.max("bits")).first()[0] or 1
    spans = spans.withColumn("cell", F.explode(F.array_distinct(F.array(F.expr("shiftright(lineStart, bits)"), F.expr("shiftright(lineEnd, bits)")))))
    lines_ = sites.select("repo", "filePath", F.col("line").cast("int").alias("line")).distinct().withColumn("bits", F.explode(F.sequence(F.lit(1), F.lit(most)))).withColumn("cell", F.expr("shiftright(line, bits)"))
    found = lines_.join(spans, ["repo", "filePath", "bits", "cell"]).where("line BETWEEN lineStart AND lineEnd")
    return found.groupBy("repo", "filePath", "line").agg(F.min(F.struct(F.col("lineEnd") - F.col("lineStart"), -F.col("lineStart"), "src")).alias("best")).select("repo", "filePath", "line", "best.src")


def resolve_calls(sites: DataFrame, symbols: DataFrame, imported: DataFrame) -> DataFrame:
    """Edges ``src``, ``dst``, ``confidence`` between symbols' ids.

    The caller is the innermost symbol of the file whose lines hold the call. The callee is a
    symbol of that name in the same file, else one that the file imports by that name
    (``imported``: repo, filePath, name, target); else the call stays unresolved.
    """
    name = F.regexp_extract("callee", r"^([\w$]+)", 1)
    inside = sites.select("repo", "filePath", "line", name.alias("name")).distinct().join(innermost(sites, symbols), ["repo", "filePath", "line"]).select("repo", "filePath", "src", "name")
    own = symbols.groupBy("repo", "filePath", "name").agg(F.min("id").alias("own"))
    far = imported.join(symbols.select("repo", F.col("filePath").alias("target"), "name", "id"), ["repo", "target", "name"]).groupBy("repo", "filePath", "name").agg(F.min("id").alias("far"))
    rows = inside.join(own, ["repo", "filePath", "name"], "left").join(far, ["repo", "filePath", "name"], "left")
    rows = rows.select("src", F.coalesce("own", "far").alias("dst"), F.when(F.col("own").isNotNull(), "exact").when(F.col("far").isNotNull(), "inferred").alias("confidence"))
    return rows.where(F.col("dst").isNotNull() & (F.col("src") != F.col("dst"))).groupBy("src", "dst").agg(F.min("confidence").alias("confidence"))
