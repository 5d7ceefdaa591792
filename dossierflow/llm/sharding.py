"""Contiguous shards of equal byte size from global prefix sums, in DataFrame functions only.

Rows are laid out in the order of doc_id (null first, then text digest and a row number)
by a range partitioning of narrow rows. Totals per partition, summed over the partitions
before, give every partition its place; sums inside a partition give every row its place.
The line of all bytes is cut at equal targets: a row belongs to the shard in which its
middle byte falls, so a shard differs from the target by at most one row's size.

A row's size is the UTF-8 length of its text plus 8; a null text has length 0 and the
checksum of an empty one. Repeated rows are separate rows. An empty table gives no rows.
Other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from dossierflow.llm.store import keep

#: bytes that a row costs besides its text
OVERHEAD = 8


def sizes(docs: DataFrame) -> DataFrame:
    text = F.coalesce(F.col("text"), F.lit(""))
    return docs.select(
        "doc_id",
        (F.octet_length(text) + F.lit(OVERHEAD)).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        F.monotonically_increasing_id().alias("row_id"),
    )


def shard(docs: DataFrame, shards: int = 24) -> DataFrame:
    """doc_id, size, text_crc32, law ('bytes'), shard, slot, grown_shard (null) of every row."""
    spark = docs.sparkSession
    order = ["doc_id", "text_crc32", "row_id"]
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    laid = keep(
        sizes(docs).repartitionByRange(parts, *order).withColumn("part", F.spark_partition_id()), "laid"
    )
    # one row for each partition, however many rows there are
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    totals = (
        laid.groupBy("part")
        .agg(F.sum("size").alias("part_bytes"), F.count(F.lit(1)).alias("part_rows"))
        .select(
            "part",
            F.coalesce(F.sum("part_bytes").over(before), F.lit(0)).alias("bytes_before"),
            F.coalesce(F.sum("part_rows").over(before), F.lit(0)).alias("rows_before"),
            F.sum("part_bytes").over(Window.partitionBy()).alias("all_bytes"),
        )
    )
    within = Window.partitionBy("part").orderBy(*order)
    placed = (
        laid.join(F.broadcast(totals), "part")
        .withColumn("start", F.col("bytes_before") + F.sum("size").over(within) - F.col("size"))
        .withColumn("place", F.col("rows_before") + F.row_number().over(within) - 1)
        .withColumn(
            "shard",
            F.expr(f"cast((2 * start + size) * {shards} div (2 * all_bytes) as int)"),
        )
        .select("doc_id", "size", "text_crc32", "shard", "place")
    )
    placed = keep(placed, "placed")
    first = placed.groupBy("shard").agg(F.min("place").alias("first_place"))
    return placed.join(F.broadcast(first), "shard").select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("bytes").alias("law"),
        "shard",
        (F.col("place") - F.col("first_place")).cast("long").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
    )
