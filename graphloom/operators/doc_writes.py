"""Writing documents: created, updated, deleted, proposed, from templates; and the search index."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.functions import frontmatter
from graphloom.functions.text import strip_markdown
from graphloom.operators.documents import fill_template

FIELDS = ["title", "type", "status", "author"]
#: Fixed value: where proposals go.
PROPOSALS = ".claude/proposals/"


def rows_of(new: DataFrame) -> DataFrame:
    """Rows of ``documents`` from ``path`` and ``body``: what frontmatter tells, and no failure without it."""
    parsed = frontmatter.parse(new.select("path", "body"))
    more = {k: frontmatter.field(F.col("block"), k) for k in ("domain", "service")}
    return parsed.select("path", *FIELDS, *[c.alias(k) for k, c in more.items()], F.col("updated").try_cast("timestamp").alias("updatedAt"), "body")


def warnings(new: DataFrame) -> DataFrame:
    """What is wrong with the frontmatter of each new document: ``path``, ``errors``."""
    return frontmatter.parse(new.select("path", "body")).where(~F.col("valid")).select("path", "errors")


def existing(documents: DataFrame, new: DataFrame) -> DataFrame:
    """The paths of ``new`` that are documents already."""
    return new.select("path").distinct().join(documents.select("path").distinct(), "path", "left_semi")


def created(documents: DataFrame, new: DataFrame) -> DataFrame:
    """``documents`` with those of ``new``; fails if one is there already."""
    if taken := [r["path"] for r in existing(documents, new).limit(5).collect()]:
        raise ValueError(f"documents exist already: {taken}")
    return updated(documents, new)


def _last(new: DataFrame) -> DataFrame:
    """The row of each path that counts."""
    body = F.max_by("body", F.struct("at", "body")) if "at" in new.columns else F.max("body")
    return new.groupBy("path").agg(body.alias("body"))


def updated(documents: DataFrame, new: DataFrame) -> DataFrame:
    """``documents`` with those of ``new`` in place of the ones with their paths.

    Of a path that repeats the last row by ``at`` counts, if ``new`` has that column, else the greatest text.
    """
    last = _last(new)
    kept = documents.join(last.select("path"), "path", "left_anti")
    return kept.unionByName(rows_of(last), allowMissingColumns=True).select(*documents.columns)


def deleted(documents: DataFrame, paths: DataFrame) -> DataFrame:
    """``documents`` without those of ``paths``; paths of no document change nothing."""
    return documents.join(paths.select("path").distinct(), "path", "left_anti")


def proposal_path(name: Column) -> Column:
    """Where a proposal of a name is kept."""
    return F.concat(F.lit(PROPOSALS), name, F.when(name.endswith(".md"), "").otherwise(".md"))


def proposed(documents: DataFrame, new: DataFrame) -> DataFrame:
    """``documents`` with proposals (``name``, ``body``), whose own status is always ``proposed`` if they have a name.

    Their status is set without a join, so that no text is carried along where only paths are asked for.
    """
    rows = new.select(proposal_path(F.col("name")).alias("path"), "body")
    kept = documents.join(rows.select("path"), "path", "left_anti")
    named = rows_of(_last(rows.where("path IS NOT NULL"))).withColumn("status", F.lit("proposed"))
    added = named.unionByName(rows_of(_last(rows.where("path IS NULL"))))
    return kept.unionByName(added, allowMissingColumns=True).select(*documents.columns)


def from_template(documents: DataFrame, templates: DataFrame, wanted: DataFrame, keys: list[str]) -> DataFrame:
    """``documents`` with one for each row of ``wanted`` (path, template, and values by ``keys``)."""
    rows = wanted.join(templates.select(F.col("name").alias("template"), F.col("body").alias("pattern")), "template")
    body = fill_template(F.col("pattern"), {k: F.coalesce(F.col(k).cast("string"), F.lit("")) for k in keys})
    return created(documents, rows.select("path", body.alias("body")))


def index_rows(documents: DataFrame) -> DataFrame:
    """What is searched: ``path``, ``text`` without markdown and frontmatter; no concepts, no empty texts."""
    content = F.regexp_replace("body", r"(?s)^---\r?\n.*?\r?\n---\r?\n?", "")
    rows = documents.where(~F.col("path").startswith("concepts/")).select("path", strip_markdown(content).alias("text"), *[c for c in ("type", "service", "domain") if c in documents.columns])
    return rows.where("text <> ''")


def filtered(found: DataFrame, filters: dict[str, str] | None = None, min_score: float = 0.0) -> DataFrame:
    """Search results that have all of the values, and the score; 0 asks for no score."""
    for name, value in (filters or {}).items():
        found = found.where(F.col(name) == value)
    return found.where(F.col("score") >= min_score) if min_score > 0 else found


def hidden(path: Column) -> Column:
    """Whether a search leaves a document out."""
    return path.startswith("concepts/") | path.startswith("scratchpad/")
