"""Exact dedup with a heavy-hitter split, in DataFrame functions only.

Digests that occur very often would meet in one task when copies are grouped. A
Misra-Gries type sketch (Spark's frequent-items aggregate) finds every such digest, each
is then counted exactly, and the verified winners - at most ``BUCKETS * PER_BUCKET`` rows,
whatever the input - are broadcast, so that their copies are settled where they are read.
All other digests are grouped by an ordinary shuffle of narrow rows.

Texts are equal when they are identical after all of space, tab, line feed, vertical tab,
form feed and carriage return is deleted. A null text counts as empty; empty texts are
copies of each other. Of equal texts the one with most code points in the original text
stays, then the smallest doc_id (null last); of rows that tie in both, one stays. An empty
table gives no rows. Other columns are ignored by ``decide`` and kept by ``dedup``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dossierflow.llm.store import keep

#: digests are sketched in this many slices of the digest space, so that no task merges all sketches
BUCKETS = 64
#: frequent digests asked of each slice
PER_BUCKET = 16
#: counters of each sketch; a digest with over 3.5 / TRACKED of the rows of its slice is always among them
TRACKED = 1024

_WHITE = "[ \\t\\n\\x0B\\f\\r]+"


def normalised(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), _WHITE, "")


def _best() -> Column:
    """Order of preference within a group as a struct whose minimum stays."""
    return F.struct(-F.col("n_cp"), F.col("doc_id").isNull(), F.col("doc_id"), F.col("row_id"))


def _grouped(rows: DataFrame) -> DataFrame:
    return rows.groupBy("digest").agg(F.count(F.lit(1)).alias("group_size"), F.min(_best()).alias("best"))


def frequent(rows: DataFrame) -> DataFrame:
    """digest, group_size, best of the digests that the sketches report, counted exactly."""
    top = (
        rows.groupBy((F.crc32("digest") % BUCKETS).alias("slice"))
        .agg(F.expr(f"approx_top_k(digest, {PER_BUCKET}, {TRACKED})").alias("top"))
        .select(F.explode("top.item").alias("digest"))
        .where(F.col("digest").isNotNull())
    )
    return _grouped(rows.join(F.broadcast(top), "digest", "left_semi")).where("group_size > 1")


def digests(docs: DataFrame) -> DataFrame:
    """row_id, doc_id, n_cp, digest (hex) of every row, written once."""
    return keep(
        docs.select(
            F.monotonically_increasing_id().alias("row_id"),
            F.col("doc_id"),
            F.length(F.coalesce("text", F.lit(""))).cast("long").alias("n_cp"),
            F.sha2(normalised(F.col("text")).cast("binary"), 256).alias("digest"),
        ),
        "digests",
    )


def _settled(rows: DataFrame) -> DataFrame:
    """rows with group_size and best."""
    winners = keep(frequent(rows), "frequent")
    hot = rows.join(F.broadcast(winners), "digest")
    rest = rows.join(F.broadcast(winners.select("digest")), "digest", "left_anti")
    return hot.unionByName(rest.join(_grouped(rest), "digest"))


def decide(docs: DataFrame) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256 for every row of ``docs``."""
    return _settled(digests(docs)).select(
        "doc_id",
        F.col("best.doc_id").alias("keep_id"),
        "group_size",
        (F.col("row_id") == F.col("best.row_id")).alias("kept"),
        F.col("digest").alias("text_sha256"),
    )


def dedup(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that stay, all columns; extra columns may have any names."""
    columns = docs.columns
    tagged = keep(docs.select(F.struct(*[docs[c] for c in columns]).alias("doc"),
                              F.monotonically_increasing_id().alias("row_id")), "rows")
    rows = keep(
        tagged.select(
            "row_id",
            F.col("doc.doc_id").alias("doc_id"),
            F.length(F.coalesce("doc.text", F.lit(""))).cast("long").alias("n_cp"),
            F.sha2(normalised(F.col("doc.text")).cast("binary"), 256).alias("digest"),
        ),
        "digests",
    )
    gone = _settled(rows).where(F.col("row_id") != F.col("best.row_id")).select("row_id")
    # what goes can be a large part of all rows: one plan at every size, and no sort of texts
    return tagged.join(gone.hint("shuffle_hash"), "row_id", "left_anti").select(*[F.col("doc").getField(c).alias(c) for c in columns])
