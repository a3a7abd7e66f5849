"""Keyed upserts of node and edge tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def upsert(old: DataFrame, new: DataFrame, keys: list[str], order: str | None = None) -> DataFrame:
    """``old`` with the rows of ``new`` in place of those with the same key.

    If a key repeats in ``new`` the row greatest in ``order`` stays, then the greatest in all. A null
    in a key is like any other value.
    """
    rest = [c for c in new.columns if c not in keys]
    by = F.struct(*([F.col(order).alias("__order")] if order else []), *rest)
    last = new.groupBy(*keys).agg(F.max(by).alias("r")).select(*keys, *[F.col("r")[c].alias(c) for c in rest])
    fresh = last.select(*[F.col(k).alias(f"new {k}") for k in keys])
    same = reduce(Column.__and__, [F.col(k).eqNullSafe(F.col(f"new {k}")) for k in keys])
    return old.join(fresh, same, "left_anti").unionByName(last.select(*old.columns))


def merge_columns(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """``old`` with the columns of ``new`` where its key has values there, else its own."""
    fresh = [c for c in new.columns if c not in keys]
    renamed = new.select(*keys, *[F.col(c).alias(f"__{c}") for c in fresh]).dropDuplicates(keys)
    out = old.join(renamed, keys, "left")
    return out.withColumns({c: F.coalesce(f"__{c}", c) if c in old.columns else F.col(f"__{c}") for c in fresh}).drop(*[f"__{c}" for c in fresh])


def replace_children(old: DataFrame, new: DataFrame, parent: list[str], parents: DataFrame) -> DataFrame:
    """``old`` without the children of the given parents, and ``new``."""
    return old.join(parents.select(*parent).distinct(), parent, "left_anti").unionByName(new)


def stubs(modules: DataFrame, imports: DataFrame) -> DataFrame:
    """Keys of import targets (``repo``, ``target``) that are no modules yet."""
    targets = imports.select("repo", F.col("target").alias("path")).distinct()
    return targets.join(modules, ["repo", "path"], "left_anti")


def edges_once(edges: DataFrame, keys: list[str]) -> DataFrame:
    """One edge for each key, with the greatest of the other columns."""
    rest = [c for c in edges.columns if c not in keys]
    return edges.groupBy(*keys).agg(F.max(F.struct(*rest)).alias("r")).select(*keys, *[F.col("r")[c].alias(c) for c in rest]) if rest else edges.distinct()
