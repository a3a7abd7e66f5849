"""Files, documents, logs and records as tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: File endings that are code, and the largest size taken.
EXTENSIONS = [".js", ".jsx", ".mjs", ".cjs"]
MAX_BYTES = 500_000
#: Folders that hold no code of the repository.
IGNORED = ["node_modules", "dist", "build", "coverage", ".git"]


def relative(path: Column, root: str) -> Column:
    """The part of a file's URI below ``root``."""
    return F.regexp_replace(F.regexp_replace(path, "^[a-z0-9]+:/*(?=/)", ""), "^" + root.rstrip("/").replace(".", r"\.") + "/", "")


def _text(content: Column) -> Column:
    """Bytes as text; what is no UTF-8 becomes replacement characters, and fails nothing."""
    return F.make_valid_utf8(content.cast("string"))


def _binary(spark: SparkSession, root: str) -> DataFrame:
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)


def source_files(spark: SparkSession, root: str, repo: str, ignored: list[str] = IGNORED, max_bytes: int = MAX_BYTES) -> DataFrame:
    """``repo``, ``filePath``, ``hash``, ``text`` of code files. Sizes are filtered by the scan."""
    path = relative(F.col("path"), root)
    ending = F.regexp_extract(path, r"(\.[^./]+)$", 1)
    rows = _binary(spark, root).where(F.col("length") <= max_bytes).select(path.alias("filePath"), "content", ending.alias("ending"))
    rows = rows.where(F.col("ending").isin(EXTENSIONS) & ~F.arrays_overlap(F.split("filePath", "/"), F.array(*[F.lit(x) for x in ignored])))
    return rows.select(F.lit(repo).alias("repo"), "filePath", F.sha2("content", 256).alias("hash"), _text(F.col("content")).alias("text"))


def document_store(spark: SparkSession, root: str, prefix: str = "") -> DataFrame:
    """``path``, ``content``, ``contentType``, ``custom`` of a document folder with sidecars.

    A sidecar ``<path>.meta.json`` holds the content type and further metadata of its document.
    """
    rows = _binary(spark, root).select(relative(F.col("path"), root).alias("path"), "content", F.col("modificationTime").alias("updatedAt"))
    meta = rows.where(F.col("path").endswith(".meta.json")).select(F.regexp_replace("path", r"\.meta\.json$", "").alias("path"), F.from_json(_text(F.col("content")), "contentType string, custom map<string,string>").alias("m"))
    docs = rows.where(~F.col("path").endswith(".meta.json") & F.col("path").startswith(prefix))
    return docs.join(meta, "path", "left").select("path", "content", "updatedAt", F.coalesce("m.contentType", F.lit("text/markdown")).alias("contentType"), F.col("m.custom").alias("custom"))


def git_log(spark: SparkSession, path: str, repo: str) -> DataFrame:
    """``repo``, ``filePath``, ``ts``, ``email`` from lines of file, time and mail, by tabs."""
    rows = spark.read.csv(path, sep="\t", schema="filePath string, ts timestamp, email string", mode="DROPMALFORMED")
    return rows.where("ts IS NOT NULL AND trim(email) <> ''").select(F.lit(repo).alias("repo"), F.trim("filePath").alias("filePath"), "ts", F.trim("email").alias("email"))


def json_records(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Records of JSON files, one a file; what doesn't parse is left out."""
    rows = spark.read.option("multiLine", "true").option("recursiveFileLookup", "true").option("mode", "PERMISSIVE").schema(f"{schema}, _corrupt_record string").json(path)
    return rows.where("_corrupt_record IS NULL").drop("_corrupt_record")


def concepts(spark: SparkSession, root: str) -> DataFrame:
    """Concepts of ``concepts/``, without the records of runs."""
    schema = "id string, name string, description string, embedding string, mentions array<struct<path:string,confidence:double,evidence:string,extractedAt:string>>, createdAt string, updatedAt string"
    rows = spark.read.option("multiLine", "true").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.json").schema(f"{schema}, _corrupt_record string").json(f"{root}/concepts")
    return rows.where(~F.contains(F.input_file_name(), F.lit("/concepts/_runs/"))).where("_corrupt_record IS NULL AND id IS NOT NULL").drop("_corrupt_record")


def write_documents(docs: DataFrame, root: str) -> None:
    """Documents (``path``, ``content`` as text) as Parquet, by the first folder of their path."""
    docs.withColumn("folder", F.split("path", "/")[0]).write.mode("overwrite").partitionBy("folder").parquet(root)
