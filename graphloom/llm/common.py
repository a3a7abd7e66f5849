"""Helpers that several training-data operators share."""

from __future__ import annotations

import tempfile

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = "abcdefghijklmnopqrstuvwxyz"


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def checkpointed(df: DataFrame) -> DataFrame:
    """``df`` written to the cluster's shared checkpoint folder and read back.

    The folder is the one that ``spark.checkpoint.dir`` names. Where that is unset, a
    temporary folder serves, but only in local mode, where driver and executors are one process.
    """
    sc = df.sparkSession.sparkContext
    if not sc.getConf().get("spark.checkpoint.dir") and not sc._jsc.sc().getCheckpointDir().isDefined():
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="checkpoints-"))
    return df.checkpoint()


def remainder(doc_id: str, divisor: int) -> Column:
    """crc32 of the id as text, modulo ``divisor``; null for a null id."""
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % divisor


def is_remainder(doc_id: str, divisor: int, value: int) -> Column:
    """Whether that remainder is ``value``; false for a null id."""
    return F.coalesce(remainder(doc_id, divisor) == value, F.lit(False))


def lower_ascii(c: Column) -> Column:
    """A-Z in lower case, all other characters as they are."""
    return F.translate(c, UPPER, LOWER)


def free_prefix(docs: DataFrame) -> str:
    """A prefix with which no column of ``docs`` begins."""
    taken = [c.lower() for c in docs.columns]
    return next(p for i in range(len(taken) + 1) if not any(c.startswith(p := f"part{i}_") for c in taken))
