"""Volatility of files from daily counts that merge, so that a new day reads no old commits.

A row for each file and day holds its commits and a sketch of their authors. Days are merged over any
window; batches and streams keep the same table. Commits are counted exactly. Authors are estimated with
2^12 registers: exact while there are few (the sketch lists them, up to some hundred), then within about 1.6 %.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from graphloom.streaming.jobs import current

KEY = ["repo", "filePath", "day"]
REGISTERS = 12


def daily(commits: DataFrame) -> DataFrame:
    """A row for each file and day of ``commits`` (repo, filePath, ts, email); a null e-mail is no author, rows without a time don't count."""
    day = commits.where("ts IS NOT NULL").groupBy("repo", "filePath", F.to_date("ts").alias("day"))
    return day.agg(F.count("*").alias("n"), F.hll_sketch_agg(F.lower("email"), F.lit(REGISTERS)).alias("authors"), F.min("ts").alias("oldest"), F.max("ts").alias("newest"))


def merged(*tables: DataFrame) -> DataFrame:
    """Several such tables as one."""
    return reduce(DataFrame.unionByName, tables).groupBy(*KEY).agg(F.sum("n").alias("n"), F.hll_union_agg("authors").alias("authors"), F.min("oldest").alias("oldest"), F.max("newest").alias("newest"))


def volatility(days: DataFrame, today: Column, window: int = 90, author_days: int | None = None) -> DataFrame:
    """Of each file: commits per 30 days in the window of whole days up to ``today``, authors of a year or of ``author_days``, and age."""
    recent = F.col("day") >= (F.add_months(today, -12) if author_days is None else F.date_sub(today, author_days))
    out = days.groupBy("repo", "filePath").agg(
        F.round(F.coalesce(F.sum(F.when(F.col("day") >= F.date_sub(today, window), F.col("n"))), F.lit(0)) / window * 30 + 1e-9, 3).alias("changeFrequency"),
        F.coalesce(F.hll_sketch_estimate(F.hll_union_agg(F.when(recent, F.col("authors")))), F.lit(0)).cast("long").alias("authorCount"),
        F.max("newest").alias("lastModified"),
        F.min("oldest").alias("oldest"),
    )
    seconds = F.unix_timestamp(today.cast("timestamp")) - F.unix_timestamp(F.col("oldest").cast("timestamp"))
    return out.withColumn("gitAge", F.greatest(F.lit(0), F.floor(seconds / 86400)).cast("int")).drop("oldest")


def keep(commits: DataFrame, table: str, checkpoint: str, interval: str | None = None) -> StreamingQuery:
    """Keeps the table of days from a stream of commits: each batch is merged into a new version.

    A batch that is repeated after a failure is merged with the version before it again, and counts once.
    """

    def add(batch: DataFrame, number: int) -> None:
        old, new = current(batch.sparkSession, table, before=number), daily(batch)
        (new if old is None else merged(old, new)).write.mode("overwrite").parquet(f"{table}/version={number}")

    writer = commits.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint)
    return (writer.trigger(processingTime=interval) if interval else writer.trigger(availableNow=True)).start()
