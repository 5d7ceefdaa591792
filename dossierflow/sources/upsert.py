"""Results kept in hash buckets, of which an upsert rewrites only those it touches.

The table is partitioned by a hash of the file_id. An upsert reads the buckets of its files,
folds old and new rows into one row a file, and replaces exactly these partitions by a dynamic
partition overwrite; all other files of the table stay as they are. The number of buckets is
fixed when the table is made, so a bucket grows with the table and not with an upsert. Running
an upsert again gives the same table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from dossierflow.plans.results import COLUMNS, fold
from dossierflow.schemas import RESULTS_SCHEMA, RESUMABLE_STAGES
from dossierflow.sources.tables import columns_ddl

BUCKETS = 256


def bucket_of(file_id: Column, buckets: int = BUCKETS) -> Column:
    return F.pmod(F.xxhash64(file_id), F.lit(buckets)).cast("int")


def _stored(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.schema(f"{columns_ddl(RESULTS_SCHEMA)}, bucket int").parquet(folder)


def stage_rows(updates: DataFrame) -> DataFrame:
    """Rows of the results table from single stage results (file_id, stage_name, result_json,
    updated_at); unknown stage names are left out."""
    made = {f"{s}_result": F.when(F.col("stage_name") == s, F.col("result_json")) for s in RESUMABLE_STAGES}
    made |= {"file_id": F.col("file_id"), "updated_at": F.col("updated_at")}
    known = updates.filter(F.col("stage_name").isin(RESUMABLE_STAGES))
    return known.select(*[
        made.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in RESULTS_SCHEMA.fields
    ])


def create(rows: DataFrame, folder: str, buckets: int = BUCKETS) -> None:
    """A new table of results rows."""
    _write(rows, folder, buckets, "errorifexists")


def _write(rows: DataFrame, folder: str, buckets: int, mode: str) -> None:
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # one shuffle: rows of a bucket are in one task, which also holds all rows of a file
    placed = rows.withColumn("bucket", bucket_of(F.col("file_id"), buckets)).repartition(min(parts, buckets), "bucket")
    folded = fold(placed, "bucket")
    folded.write.mode(mode).option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(folder)


def upsert(updates: DataFrame, folder: str, buckets: int = BUCKETS) -> list[int]:
    """Merge results rows (or ``stage_rows``) into the table; gives the buckets that were rewritten."""
    spark = updates.sparkSession
    placed = updates.select(bucket_of(F.col("file_id"), buckets).alias("bucket")).distinct()
    # at most ``buckets`` numbers; as literals they prune the scan to their partitions
    touched = sorted(r.bucket for r in placed.collect())
    if touched:
        old = _stored(spark, folder).where(F.col("bucket").isin(touched)).select(*COLUMNS)
        _write(old.unionByName(updates.select(*COLUMNS)), folder, buckets, "overwrite")
    return touched


def read(spark: SparkSession, folder: str) -> DataFrame:
    """One row for each file."""
    return _stored(spark, folder).select(*COLUMNS)


def lookup(spark: SparkSession, folder: str, file_id: str, buckets: int = BUCKETS) -> DataFrame:
    """One file's row, read from its bucket alone."""
    found = _stored(spark, folder).where(F.col("bucket") == bucket_of(F.lit(file_id), buckets))
    return found.where(F.col("file_id") == file_id).select(*COLUMNS)
