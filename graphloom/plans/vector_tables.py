"""Tables of vectors by the model that made them, with a switch from one model to another.

A meta table of one row tells model and dimensions. Vectors lie in a folder by the number of that row's
version, so that the one write of a new meta row makes all tables of the old model count as empty; until
it is whole, the old ones count. Old folders are removed only after the switch.
"""

from __future__ import annotations

from dataclasses import dataclass
from typing import Literal

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.operators import tools
from graphloom.operators.upsert import upsert

META = "model string, dimensions int, updatedAt timestamp"


@dataclass(frozen=True)
class Model:
    name: str
    dimensions: int


@dataclass(frozen=True)
class Change:
    """What :meth:`VectorTables.use` did."""

    action: Literal["installed", "unchanged", "rotated"]
    previous: Model | None
    current: Model


class VectorTables:
    """Tables (a key column, ``embedding``) in a shared folder."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")

    def use(self, name: str, dimensions: int) -> Change:
        """Makes a model the one whose vectors count. Those of another model, or of another size, are dropped."""
        if not isinstance(name, str) or not name:
            raise ValueError("a model needs a name")
        if isinstance(dimensions, bool) or not isinstance(dimensions, int) or dimensions <= 0:
            raise ValueError(f"dimensions must be a positive whole number, not {dimensions!r}")
        version, previous, wanted = *self._meta(), Model(name, dimensions)
        if previous == wanted:
            return Change("unchanged", previous, previous)
        row = self.spark.createDataFrame([(name, dimensions)], "model string, dimensions int").withColumn("updatedAt", F.current_timestamp())
        row.coalesce(1).write.mode("overwrite").parquet(f"{self.folder}/meta/version={version + 1}")
        if version:
            self._fs().delete(self._path(f"vectors/{version}"), True)
        return Change("installed" if previous is None else "rotated", previous, wanted)

    def model(self) -> Model | None:
        return self._meta()[1]

    def put(self, table: str, rows: DataFrame, key: str) -> None:
        """Adds ``rows`` (key, embedding) in place of those with their keys; a null or another length is an error."""
        version, model = self._meta()
        if model is None:
            raise ValueError("no model is in use")
        if wrong := rows.where(F.coalesce(F.size("embedding"), F.lit(-1)) != model.dimensions).limit(1).count():
            raise ValueError(f"{wrong} or more vectors aren't of {model.dimensions} components")
        new = rows.select(key, F.col("embedding").cast("array<float>").alias("embedding"))
        at, old = self._last(f"vectors/{version}/{table}"), self.rows(table)
        out = new.dropDuplicates([key]) if old is None else upsert(old, new, [key])
        out.write.mode("overwrite").parquet(f"{self.folder}/vectors/{version}/{table}/version={at + 1}")
        self._fs().delete(self._path(f"vectors/{version}/{table}/version={at - 1}"), True)  # the last one may still be read

    def rows(self, table: str) -> DataFrame | None:
        """The vectors of the model in use; None if there are none."""
        folder = f"vectors/{self._meta()[0]}/{table}"
        at = self._last(folder)
        return self.spark.read.parquet(f"{self.folder}/{folder}/version={at}") if at else None

    def nearest(self, table: str, vector: list[float], key: str, k: int = 5) -> DataFrame:
        """The nearest rows; a vector of another dimension, or a table that isn't there, finds none."""
        rows, model = self.rows(table), self.model()
        if rows is None or model is None or len(vector) != model.dimensions:
            kind = "string" if rows is None else rows.schema[key].dataType.simpleString()
            return self.spark.createDataFrame([], f"`{key}` {kind}, embedding array<float>, score double")
        return tools.vector_top_k(vector, rows, k, tie=key)

    def states(self, tables: list[str]) -> DataFrame:
        """``name``, ``state`` (ONLINE or MISSING), ``type``, ``dimensions``, ``n`` of each table asked for."""
        model, found = self.model(), []
        for name in tables:
            rows = self.rows(name)
            found.append((name, "MISSING" if rows is None else "ONLINE", "VECTOR", model.dimensions if model else None, 0 if rows is None else rows.count()))
        return self.spark.createDataFrame(found, "name string, state string, type string, dimensions int, n long")

    def _meta(self) -> tuple[int, Model | None]:
        """Number and content of the newest meta row; a row that tells no model counts as none."""
        version = self._last("meta")
        if not version:
            return 0, None
        row = self.spark.read.schema(META).parquet(f"{self.folder}/meta/version={version}").first()
        return version, Model(row["model"], row["dimensions"]) if row and row["model"] and row["dimensions"] else None

    def _path(self, path: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{path}")

    def _fs(self):
        return self._path("meta").getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _last(self, folder: str) -> int:
        """The newest whole version in a folder, 0 if there is none."""
        fs = self._fs()
        if not fs.exists(self._path(folder)):
            return 0
        names = [s.getPath().getName() for s in fs.listStatus(self._path(folder))]
        return max((int(n.partition("=")[2]) for n in names if n.startswith("version=") and fs.exists(self._path(f"{folder}/{n}/_SUCCESS"))), default=0)
