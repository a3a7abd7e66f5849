"""Concepts from documents into the graph: extracted, told apart, kept with where they are mentioned."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.bundle import GraphBundle
from graphloom.checkpoints import cut
from graphloom.functions.text import slugify
from graphloom.operators import concepts

Embed = Callable[[str], list[float]]


def embedded(rows: DataFrame, embed: Embed) -> DataFrame:
    """``rows`` with ``embedding`` of their ``text``, or ``error``; a text that fails stops no other."""

    def ask(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            vectors, errors = [], []
            for text in batch["text"]:
                try:
                    vectors.append([float(x) for x in embed(text)])
                    errors.append(None)
                except Exception as e:  # noqa: BLE001  told in the row
                    vectors.append(None)
                    errors.append(str(e))
            yield pd.DataFrame({"slug": batch["slug"], "embedding": pd.Series(vectors, dtype=object), "error": pd.Series(errors, dtype=object)})

    return rows.select("slug", "text").mapInPandas(ask, "slug string, embedding array<float>, error string")


def enrich(graph: GraphBundle, complete: Callable[[str], str], embed: Embed, prefix: str = "", threshold: float = concepts.MERGE) -> dict:
    """Writes ``concepts`` and ``mentioned_in`` from the documents whose path begins with ``prefix``, and counts.

    The models run in tasks. A chunk without an answer and a candidate without a vector are counted as errors and
    leave nothing. Of a concept and document the greatest confidence counts; a mention that is no better
    than before changes nothing. A name without a slug names no concept.
    """
    docs = concepts.worth_reading(graph["documents"].where(F.col("path").startswith(prefix)).select("path", "body"))
    found = cut(concepts.extracted(docs, complete).withColumn("slug", slugify(F.col("name"))))
    rows = found.where("error IS NULL AND slug <> ''").withColumn("at", F.struct("path", "chunk", "name", "description"))
    rows = cut(rows.groupBy("at", "path", "name", "description", "slug").agg(F.max("confidence").alias("confidence")))
    known = graph["concepts"].select("id", "embedding")
    text = F.when(F.col("description") != "", F.concat("name", F.lit(". "), "description")).otherwise(F.col("name"))
    first = rows.join(known.select(F.col("id").alias("slug")), "slug", "left_anti").groupBy("slug").agg(F.min_by(text, "at").alias("text"))
    vectors = cut(embedded(first, embed))
    failed = vectors.where("error IS NOT NULL").select("slug")
    told = rows.join(failed, "slug", "left_anti").join(vectors.select("slug", "embedding"), "slug", "left").drop("slug")
    named = cut(concepts.deduplicated(told, known, threshold))
    new = named.where("slug = concept").join(known.select(F.col("id").alias("concept")), "concept", "left_anti")
    new = new.groupBy(F.col("concept").alias("id")).agg(F.min_by(F.struct("name", "description", "embedding"), "at").alias("c"))
    new = cut(new.select("id", "c.*", F.current_timestamp().alias("createdAt"), F.current_timestamp().alias("updatedAt")))
    best = named.groupBy("concept", F.col("path").alias("doc")).agg(F.max("confidence").alias("confidence"))
    before = graph["mentioned_in"].select("concept", "doc", F.col("confidence").alias("was"))
    better = cut(best.join(before, ["concept", "doc"], "left").where("was IS NULL OR confidence > was").select("concept", "doc", "confidence", F.current_timestamp().alias("extractedAt")))
    touched = cut(better.select(F.col("concept").alias("id")).distinct().join(new.select("id"), "id", "left_anti"))
    old = graph["concepts"].join(touched.withColumn("hit", F.lit(True)), "id", "left")
    graph["concepts"] = cut(old.withColumn("updatedAt", F.when(F.col("hit"), F.current_timestamp()).otherwise(F.col("updatedAt"))).drop("hit"))
    graph.upsert("concepts", new)
    graph.upsert("mentioned_in", better)
    graph["concepts"], graph["mentioned_in"] = cut(graph["concepts"]), cut(graph["mentioned_in"])
    return {"docsScanned": docs.count(), "candidatesExtracted": rows.count(), "conceptsCreated": new.count(), "conceptsUpdated": touched.count(), "errors": found.where("error IS NOT NULL").count() + failed.count()}
