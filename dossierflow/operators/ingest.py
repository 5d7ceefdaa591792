"""Stage 1: fingerprint, safe name, target path; landing with overwrite."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from dossierflow.functions.paths import file_extension, safe_filename, volume_file_path
from dossierflow.schemas import SUPPORTED_EXTENSIONS


def fingerprint(content: Column) -> Column:
    return F.sha2(content, 256)


def ingest_error(filename: Column, content: Column) -> Column:
    return (
        F.when(F.coalesce(filename, F.lit("")) == "", F.lit("file name is empty"))
        .when(content.isNull(), F.lit("file has no content"))
    )


def ingest_struct(filename: Column, content: Column, catalog: Column, schema: Column, volume: Column) -> Column:
    """Result of stage 1, with ``status`` failed where name or content is missing."""
    bad = ingest_error(filename, content).isNotNull()
    safe = safe_filename(filename)
    return F.struct(
        F.when(bad, F.lit("failed")).otherwise(F.lit("success")).alias("status"),
        filename.alias("original_filename"),
        F.when(~bad, safe).alias("safe_filename"),
        F.when(~bad, volume_file_path(catalog, schema, volume, safe)).alias("volume_path"),
        F.octet_length(content).cast("long").alias("size_bytes"),
        fingerprint(content).alias("file_hash_sha256"),
        catalog.alias("catalog"),
        schema.alias("schema"),
        volume.alias("volume"),
    )


def is_supported(filename: Column, length: Column, max_bytes: int) -> Column:
    """Whether type and size are within the declared limits (an opt-in check)."""
    return F.coalesce(
        file_extension(filename).isin(SUPPORTED_EXTENSIONS) & (length <= F.lit(max_bytes)), F.lit(False)
    )


def manifest(uploads: DataFrame, order: str) -> DataFrame:
    """One row per volume path, the upload with the highest ``order`` winning.

    ``uploads`` has volume_path, the order column and the columns to keep. The winner
    is an aggregate over narrow rows, combined before the shuffle, so a path that a
    third of all uploads share costs one row per input partition.
    """
    kept = [c for c in uploads.columns if c not in ("volume_path", order)]
    best = F.max_by(F.struct(*kept), F.col(order)).alias("best")
    return (
        uploads.groupBy("volume_path")
        .agg(F.max(order).alias(order), best, F.count("*").alias("uploads"))
        .select("volume_path", order, "best.*", "uploads")
    )


def new_only(uploads: DataFrame, existing: DataFrame, order: str) -> DataFrame:
    """Landing without overwrite: the first upload of each path that is not yet in
    ``existing`` is taken, every other upload is refused."""
    kept = [c for c in uploads.columns if c not in ("volume_path", order)]
    first = F.min_by(F.struct(*kept), F.col(order)).alias("first")
    return (
        uploads.groupBy("volume_path")
        .agg(F.min(order).alias(order), first, (F.count("*") - 1).alias("refused"))
        .join(existing.select("volume_path"), "volume_path", "left_anti")
        .select("volume_path", order, "first.*", "refused")
    )


def latest_content(uploads: DataFrame, order: str) -> DataFrame:
    """Whole winning upload per path, content included; ``order`` tells uploads of a path
    apart. Winners are decided on narrow rows, combined before their shuffle; contents are
    looked up by hash, so no task sorts them."""
    winners = uploads.groupBy("volume_path").agg(F.max(order).alias(order))
    return uploads.join(winners.hint("shuffle_hash"), ["volume_path", order], "left_semi").select(*uploads.columns)


def first_per_path(rows: DataFrame, path: str, order: str) -> DataFrame:
    """Row 0 of each path."""
    oldest = Window.partitionBy(path).orderBy(F.col(order))
    return rows.withColumn("_rank", F.row_number().over(oldest)).filter("_rank = 1").drop("_rank")
