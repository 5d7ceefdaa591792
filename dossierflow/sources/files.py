"""Scanning document folders and landing documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from dossierflow.operators.ingest import is_supported, latest_content

BINARY_SCHEMA = "path string, modificationTime timestamp, length bigint, content binary"


def _named(files: DataFrame) -> DataFrame:
    name = F.element_at(F.split("path", "/"), -1)
    # paths are URIs: a blank in a name arrives as %20
    return files.withColumn("filename", F.try_url_decode(F.replace(name, F.lit("+"), F.lit("%2B"))))


def read_files(spark: SparkSession, path: str, glob: str | None = None, recursive: bool = False) -> DataFrame:
    """path, modificationTime, length, content, filename and file_id of every file. Files
    are only opened if ``content`` is used."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower())
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    return _named(reader.load(path)).withColumn("file_id", F.sha2("path", 256))


def supported_only(files: DataFrame, max_bytes: int, size: str = "length") -> DataFrame:
    """Only files within the declared type and size limits. The size is a condition of its
    own, so the scan applies it before a file is opened."""
    return files.filter(F.col(size) <= max_bytes).filter(is_supported(F.col("filename"), F.col(size), max_bytes))


def refused(files: DataFrame, max_bytes: int, size: str = "length") -> DataFrame:
    """The other files, as failed rows without contents."""
    allowed = is_supported(F.col("filename"), F.col(size), max_bytes)
    too_large = F.coalesce(F.col(size) > max_bytes, F.lit(False))
    return files.filter(~allowed).select(
        "file_id", "filename", F.col(size).alias("size_bytes"), F.lit("failed").alias("status"),
        F.when(too_large, F.lit("file is too large")).otherwise(F.lit("file type is not supported")).alias("error"),
    )


def land(uploads: DataFrame, folder: str) -> None:
    """Add uploads (volume_path, an order column, content, ...) to the landed table. Earlier
    landings stay; which upload of a path counts is decided when the table is read."""
    uploads.write.mode("append").parquet(folder)


def landed(spark: SparkSession, folder: str, order: str) -> DataFrame:
    """The newest upload of every path over all landings."""
    return latest_content(spark.read.parquet(folder), order)
