"""A kept inverted index of documents, brought up to date by what changed, and ranked search in it.

Two tables: ``postings`` (term, path, tf) and ``lengths`` (path, length, hash). A refresh compares hashes
and touches the postings of new, changed and deleted documents only. A search reads the
postings of its words; the rest of the index isn't joined.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: BM25's saturation of repeated words, and how much a document's length counts.
K1, B = 1.2, 0.75
#: Documents whose words and scores one task holds.
DEALT = 1_000
#: Words of all queries, with repeats, that are sent to all tasks; more are shuffled.
SENT = 1_000_000


def dealt(rows: DataFrame, column: str, n: int) -> DataFrame:
    """``rows`` by a document's key, in more parts the more documents (``n``) there are, so that a part stays as large."""
    return rows.repartition(max(rows.sparkSession.sparkContext.defaultParallelism, math.ceil(n / DEALT)), column)


def sent(asked: DataFrame) -> DataFrame:
    """The words of queries for a join with dealt documents: these stay where they are, unless the words are very many."""
    return F.broadcast(asked) if asked.count() <= SENT else asked


def terms(text: Column) -> Column:
    """Words of letters and digits in any script, in lower case."""
    return F.array_remove(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), "")


def indexed(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``postings`` and ``lengths`` of documents (path, text); null texts are empty."""
    rows = dealt(docs.select("path", F.coalesce("text", F.lit("")).alias("text")), "path", docs.count())
    lengths = rows.select("path", F.size(terms(F.col("text"))).cast("long").alias("length"), F.sha2("text", 256).alias("hash"))
    each = rows.select("path", F.explode(terms(F.col("text"))).alias("term"))
    return each.groupBy("term", "path").agg(F.count("*").alias("tf")), lengths


def refreshed(postings: DataFrame, lengths: DataFrame, docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The index after documents (path, text) have become what they are now."""
    now = docs.select("path", F.coalesce("text", F.lit("")).alias("text"))
    known = lengths.select("path", F.col("hash").alias("was"))
    changed = now.join(known, "path", "left").where(~F.sha2("text", 256).eqNullSafe(F.col("was"))).select("path", "text")
    gone = lengths.select("path").join(now.select("path"), "path", "left_anti")
    stale = changed.select("path").unionByName(gone)
    new_postings, new_lengths = indexed(changed)
    kept = lambda df: df.join(stale, "path", "left_anti").select(*df.columns)
    return kept(postings).unionByName(new_postings), kept(lengths).unionByName(new_lengths)


def search(postings: DataFrame, lengths: DataFrame, queries: DataFrame, k: int = 10) -> DataFrame:
    """``query``, ``path``, ``score``: the ``k`` best documents of each query (query, text) by BM25, ties by path.

    Each distinct word of a query counts once. Postings of a frequent word are many rows of one
    key, so postings are dealt by document and the words of queries are sent to them: a task scores its own
    documents for all queries and passes on only the best of each.
    """
    asked = queries.select("query", F.explode(F.array_distinct(terms(F.col("text")))).alias("term"))
    whole = lengths.agg(F.count("*").alias("n"), F.avg("length").alias("mean")).first()
    n, mean = whole["n"], whole["mean"] or 1.0
    hits = dealt(postings.join(asked.select("term").distinct(), "term", "left_semi").select("term", "path", "tf"), "path", n)
    idf = hits.groupBy("term").agg(F.log(1 + (n - F.count("*") + 0.5) / (F.count("*") + 0.5)).alias("idf"))
    weight = F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("length") / mean))
    sized = hits.join(dealt(lengths.select("path", "length"), "path", n).hint("merge"), "path")
    scores = sized.join(sent(asked.join(idf, "term")), "term").select("query", "path", (F.col("idf") * weight).alias("part")).groupBy("query", "path").agg(F.round(F.sum("part") + 1e-9, 4).alias("score"))
    order = Window.partitionBy("query").orderBy(F.desc("score"), "path")
    return scores.withColumn("at", F.row_number().over(order)).where(F.col("at") <= k).drop("at")
