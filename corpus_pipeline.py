"""Documents to training sequences: language, near-duplicates, secrets, packing.

Each stage takes all documents that its predecessor kept. It runs as ``run(spark, sf_dir)``, or
stage by stage with each result written as Parquet and read again.

Cases, in every stage: a row without an id is judged by its text like any other. Null, empty and
letterless texts go in the first stage, whose languages are learned from the labelled rows it is given;
a null language or source changes nothing. Rows that repeat an id and text stay once after the second
stage, and of equal texts that with the smallest id. Very long texts are read whole. An empty table gives
an empty result with the same columns. Columns beyond those of documents stay, whatever their names, up to
the last stage, which returns pieces.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from graphloom.llm import language_id, near_dup, packing, secrets
from graphloom.llm.common import checkpointed, free_prefix, read


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is sure; those without a letter go."""
    p = free_prefix(docs)
    found = language_id.identify(docs, language_id.fit(docs), lang_out=p + "lang", score_out=p + "score")
    return found.where(language_id.accepted(p + "lang", p + "score")).select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates, that with the smallest id."""
    return near_dup.representatives(docs)


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with their secrets replaced and ``n_chars`` set anew."""
    return secrets.redacted(docs)


def best_fit(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents, each with its sequence and place."""
    return packing.pack(docs, packing.Params(public_tokenizers.path("word_bpe_49k.json")))


STAGES = [
    ("language_id", language),
    ("minhash_near_dedup", near_duplicates),
    ("secret_scan", secret_scan),
    ("best_fit_packing", best_fit),
]

#: A trained classifier and a tokenizer aren't SQL; the tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = checkpointed(docs)
    return docs
