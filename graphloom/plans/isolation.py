"""A job over many files that goes on where some of them make it fail."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.functions.text import clipped

#: Results of a job by name, each computed already.
Results = dict[str, DataFrame]


def judged(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Files (repo, filePath, hash, text) that can be read, each once, and those that can't, with the ``reason``.

    A file without repository, path or text can't, nor can one that comes with several hashes.
    """
    key = ["repo", "filePath"]
    reason = F.when(F.col("repo").isNull() | F.col("filePath").isNull(), "no path").when(F.col("text").isNull(), "no text")
    told = files.withColumn("reason", reason)
    several = told.where("reason IS NULL").groupBy(*key).agg((F.count_distinct(F.coalesce("hash", F.lit(""))) > 1).alias("many")).where("many").select(*key)
    read = told.where("reason IS NULL").drop("reason").join(several, key, "left_anti").dropDuplicates(key)
    return read, told.where("reason IS NOT NULL").select(*key, "reason").unionByName(several.withColumn("reason", F.lit("several contents"))).distinct()


def isolated(files: DataFrame, job: Callable[[DataFrame], Results]) -> tuple[Results, DataFrame]:
    """What ``job`` gives for all files but those it fails on, and these: repo, filePath, ``reason``.

    If it fails, the files are halved by a hash of their key, and each half is tried by itself, down to
    single files; so one that fails among ``n`` costs about twice ``log2(n)`` runs more, and files
    themselves stay in Spark. A job that fails without any file is at fault itself: its error is raised.
    """
    spark, place = files.sparkSession, F.xxhash64("repo", "filePath")
    done: list[Results] = []
    faulty: list[DataFrame] = []

    def attempt(bits: int, code: int) -> None:
        part = files if not bits else files.where(F.pmod(place, F.lit(1 << bits)) == code)
        try:
            done.append(job(part))
            return
        except Exception as e:  # noqa: BLE001  a file may make the job fail in any way
            if not bits:
                done.append(job(files.limit(0)))
            why = _reason(e)
        if bits == 62 or part.select("repo").limit(2).count() < 2:
            faulty.append(part.select("repo", "filePath", clipped(F.lit(why), 500).alias("reason")))
            return
        for half in (code, code + (1 << bits)):
            attempt(bits + 1, half)

    attempt(0, 0)
    found = {name: reduce(DataFrame.unionByName, [d[name] for d in done]) for name in done[0]}
    none = spark.createDataFrame([], "repo string, filePath string, reason string")
    return found, reduce(DataFrame.unionByName, faulty, none)


def _reason(e: Exception) -> str:
    """The last line of an error that names it; Python's own errors end with it, Java's begin so."""
    lines = [s.strip() for s in str(e).splitlines() if s.strip()]
    python = [s for s in lines if s.split(":")[0].endswith(("Error", "Exception")) and not s.startswith(("File", "org.", "at "))]
    return (python or lines or [type(e).__name__])[-1 if python else 0]
