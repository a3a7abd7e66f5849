"""The graph as a set of DataFrames: kept as Parquet, changed by keyed upserts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.operators.upsert import upsert
from graphloom.schema import TABLES


class GraphBundle:
    """Tables by name; one that was never set is empty, with its columns."""

    def __init__(self, spark: SparkSession, tables: dict[str, DataFrame] | None = None):
        self.spark, self.tables = spark, dict(tables or {})

    def __getitem__(self, name: str) -> DataFrame:
        return self.tables[name] if name in self.tables else self.spark.createDataFrame([], TABLES[name][1])

    def __setitem__(self, name: str, df: DataFrame) -> None:
        self.tables[name] = df

    def upsert(self, name: str, rows: DataFrame, order: str | None = None) -> None:
        """Rows in place of those with their keys; tables without keys are appended to."""
        keys, old = TABLES[name][0], self[name]
        missing = [c for c in old.columns if c not in rows.columns]
        rows = rows.withColumns({c: F.lit(None).cast(old.schema[c].dataType) for c in missing}).select(*old.columns)
        self.tables[name] = upsert(old, rows, keys, order) if keys else old.unionByName(rows)

    def write(self, path: str) -> None:
        """Each table to a folder of its own, by repository where it has one."""
        for name, df in self.tables.items():
            writer = df.write.mode("overwrite")
            (writer.partitionBy("repo") if "repo" in df.columns and len(df.columns) > 1 else writer).parquet(f"{path}/{name}")

    @classmethod
    def read(cls, spark: SparkSession, path: str, names: list[str]) -> GraphBundle:
        return cls(spark, {n: spark.read.parquet(f"{path}/{n}") for n in names})
