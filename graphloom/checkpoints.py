"""Cutting the lineage of iterative jobs."""

from __future__ import annotations

import math
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def _local(spark: SparkSession) -> bool:
    master = spark.sparkContext.master
    return master.startswith("local") and not master.startswith("local-cluster")


def checkpoint_folder(spark: SparkSession, name: str) -> str:
    """A folder of that name in the shared one; only in local mode, with none set, a temporary one."""
    shared = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if shared:
        return f"{shared.rstrip('/')}/{name}"
    if not _local(spark):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    return tempfile.mkdtemp(prefix=f"{name}-")


def cut(df: DataFrame) -> DataFrame:
    """``df`` from the shared folder in ``spark.checkpoint.dir``; survives lost executors.

    Only in local mode, with the setting unset, a temporary folder serves.
    """
    sc = df.sparkSession.sparkContext
    if not sc._jsc.sc().getCheckpointDir().isDefined():
        sc.setCheckpointDir(checkpoint_folder(df.sparkSession, "checkpoints"))
    return df.checkpoint()


def dealt(df: DataFrame, rows: int = 20_000) -> DataFrame:
    """``df`` in parts of about ``rows`` rows, one for each core at least: for steps that make much of small rows."""
    return df.repartition(max(df.sparkSession.sparkContext.defaultParallelism, math.ceil(df.count() / rows)))


class Rounds:
    """Tables of an iterative job in the shared folder, of which the last ``keep`` stay (None: all, until cleared)."""

    def __init__(self, spark: SparkSession, name: str, keep: int | None = 1):
        self.spark, self.folder, self.k, self.keep = spark, checkpoint_folder(spark, f"{name}-{uuid.uuid4().hex}"), 0, keep

    def _path(self, k: int) -> str:
        return f"{self.folder}/round-{k}"

    def written(self, df: DataFrame) -> DataFrame:
        """``df`` written and read back; ``df`` may read the tables that stay."""
        self.k += 1
        df.write.mode("overwrite").parquet(self._path(self.k))
        if self.keep:
            self.drop(self.k - self.keep)
        return self.spark.read.schema(df.schema).parquet(self._path(self.k))

    def clear(self) -> None:
        """Removes all tables."""
        for k in range(1, self.k + 1):
            self.drop(k)

    def drop(self, k: int) -> None:
        """Removes the table of round ``k``, whatever file system it is on."""
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self._path(k))
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)
