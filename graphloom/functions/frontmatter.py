"""Frontmatter of markdown documents, read with column functions.

The block between two ``---`` lines holds ``key: value`` lines. Nothing fails: what is missing
or not allowed is listed in ``errors``, and the fields that are there are kept.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

REQUIRED = ["title", "type", "status", "author", "created", "updated"]
#: Allowed types and states of a document.
TYPES = ["adr", "runbook", "guide", "overview", "reference", "changelog", "incident", "postmortem", "api", "schema", "pattern", "glossary", "service-map"]
STATES = ["current", "draft", "deprecated", "proposed"]


def field(block: Column, key: str) -> Column:
    """Value of a key, without quotes; null if it isn't there or is empty."""
    value = F.regexp_extract(block, rf"(?m)^{key}:[ \t]*(.*?)[ \t]*$", 1)
    value = F.regexp_replace(value, "^([\"'])(.*)\\1$", "$2")
    return F.when(value != "", value)


def parse(docs: DataFrame, body_col: str = "body") -> DataFrame:
    """``docs`` with ``block``, ``content``, the required fields, ``errors`` and ``valid``."""
    block = F.regexp_extract(F.col(body_col), r"(?s)^---\r?\n(.*?)\r?\n---", 1)
    content = F.regexp_replace(F.col(body_col), r"(?s)^---\r?\n.*?\r?\n---\r?\n?", "")
    rows = docs.withColumns({"block": block, "content": content})
    rows = rows.withColumns({k: field(F.col("block"), k) for k in REQUIRED})
    errors = [F.when(F.col(k).isNull(), F.lit(f"missing {k}")) for k in REQUIRED]
    errors.append(F.when(~F.col("type").isin(TYPES), F.concat(F.lit("bad type "), "type")))
    errors.append(F.when(~F.col("status").isin(STATES), F.concat(F.lit("bad status "), "status")))
    errors += [F.when(F.col(k).isNotNull() & F.col(k).try_cast("date").isNull(), F.lit(f"bad date {k}")) for k in ("created", "updated")]
    rows = rows.withColumn("errors", F.filter(F.array(*errors), lambda e: e.isNotNull()))
    return rows.withColumn("valid", F.size("errors") == 0)


def list_field(block: Column, key: str) -> Column:
    """Items of a ``key:`` that is followed by ``- item`` lines."""
    items = F.regexp_extract(block, rf"(?m)^{key}:[ \t]*\n((?:[ \t]*-[ \t]+.*\n?)++)", 1)
    each = F.transform(F.split(items, r"\n?[ \t]*-[ \t]+"), lambda x: F.trim(x, F.lit(" \t\r\n")))
    return F.filter(each, lambda x: x != "")
