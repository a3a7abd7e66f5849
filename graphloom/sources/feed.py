"""What has become of files or documents between two looks at them: created, updated, deleted.

A look is a table of keys and versions (a hash, or size and time). Looks are compared by a join, so deletions
are found too, which a stream over a folder's new files can't tell.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.streaming.jobs import current


def changes(before: DataFrame, now: DataFrame, keys: list[str], version: str) -> DataFrame:
    """``keys``, ``event``, ``version`` (null if deleted) of each key that isn't as it was.

    Rows with a null key tell nothing and are left out. If a key repeats, its greatest version counts;
    a null version is a version like any other.
    """
    one = lambda df, name: df.dropna(subset=keys).groupBy(*keys).agg(F.max(version).alias(name), F.lit(True).alias(f"in {name}"))
    both = one(before, "was").join(one(now, "is"), keys, "full")
    event = F.when(F.col("in was").isNull(), "created").when(F.col("in is").isNull(), "deleted").when(~F.col("was").eqNullSafe(F.col("is")), "updated")
    return both.select(*keys, event.alias("event"), F.col("is").alias(version)).where("event IS NOT NULL")


class Feed:
    """A kept feed in a shared folder: each look adds the events since the last one.

    Events of look ``n`` are written before the look itself, so that a crash between the two repeats
    them under the same number: each is told at least once. ``events/`` can be watched as a stream.
    """

    def __init__(self, spark: SparkSession, folder: str, keys: list[str], version: str, keep: int = 2):
        self.spark, self.folder, self.keys, self.version, self.keep = spark, folder.rstrip("/"), keys, version, keep

    def poll(self, now: DataFrame) -> DataFrame:
        """Events since the last look, each with the number of this ``look``."""
        looks = f"{self.folder}/looks"
        before, n = current(self.spark, looks), self._last(looks) + 1
        seen = now.select(*self.keys, self.version)
        found = changes(seen.limit(0) if before is None else before, seen, self.keys, self.version)
        path = f"{self.folder}/events/look={n}"
        found.write.mode("overwrite").parquet(path)
        seen.write.mode("overwrite").parquet(f"{looks}/version={n}")
        for old in range(max(1, n - self.keep), n - self.keep + 1):
            self._fs(looks).delete(self._path(f"{looks}/version={old}"), True)
        return self.spark.read.schema(found.schema).parquet(path).withColumn("look", F.lit(n))

    def events(self) -> DataFrame:
        """All events so far."""
        return self.spark.read.parquet(f"{self.folder}/events")

    def _path(self, path: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(path)

    def _fs(self, path: str):
        return self._path(path).getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _last(self, looks: str) -> int:
        """The number of the last look that was written whole."""
        fs = self._fs(looks)
        if not fs.exists(self._path(looks)):
            return 0
        names = [s.getPath().getName() for s in fs.listStatus(self._path(looks))]
        whole = [int(n.partition("=")[2]) for n in names if n.startswith("version=") and fs.exists(self._path(f"{looks}/{n}/_SUCCESS"))]
        return max(whole, default=0)
