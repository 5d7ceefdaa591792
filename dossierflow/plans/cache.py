"""Results kept by what a file holds, so that equal bytes are worked on once.

The key of a result is a digest of the file's bytes, its type (the parser goes by it) and all
settings that stages depend on. Files whose key is in the cache run no stage, whatever their name;
of the others one file for each key runs, and all with that key share its result. Only keys move:
contents are read for the files that run.

The cache can be far larger than a batch. Before it is shuffled it is thinned by a bitmap of the
batch's keys, which has a fixed size; a bit that several keys share lets a row pass that the
join then drops.
"""

from __future__ import annotations

import dataclasses
import hashlib

from pyspark.sql import Column, DataFrame, functions as F

from dossierflow.functions.paths import file_extension
from dossierflow.plans.runs import run_stages
from dossierflow.settings import Settings

#: log2 of the bits of the bitmap: 131,072 rows of 64 bits at most, which are broadcast
BITS = 23
#: settings that say where things are, not what comes out
_PLACES = {"catalog", "schema", "volume", "logs_path", "table_rows"}
RESULTS = [
    "status", "failed_stage", "error", "document_text", "categorization", "extraction", "deidentification",
    "primary_category", "entities_count", "pii_items_masked",
]


def settings_digest(settings: Settings, version: str = "") -> str:
    """Digest of everything that results depend on. A lexicon that is a table, and models, are
    known by name only: ``version`` tells one content of theirs from another."""
    parts = [version]
    for f in dataclasses.fields(settings):
        value = getattr(settings, f.name)
        if f.name == "scorers":
            value = {k: f"{s.__module__}.{s.__qualname__}" for k, s in sorted(value.items())}
        elif isinstance(value, DataFrame):
            value = "a table"
        if f.name not in _PLACES:
            parts.append(f"{f.name}={value!r}")
    return hashlib.sha256("\n".join(parts).encode()).hexdigest()


def key_of(filename: Column, content: Column, digest: str) -> Column:
    """NULL for files without a name or content, which no result stands for."""
    named = F.nullif(filename, F.lit("")).isNotNull()
    kind = F.coalesce(file_extension(filename), F.lit(""))
    return F.when(named & content.isNotNull(), F.sha2(F.concat_ws("|", F.sha2(content, 256), kind, F.lit(digest)), 256))


def thinned(cache: DataFrame, keys: DataFrame, bits: int = BITS) -> DataFrame:
    """Rows of the cache whose key may be among ``keys``."""
    place = F.pmod(F.xxhash64("key"), F.lit(1 << bits))
    word, bit = F.shiftright(place, 6).alias("_word"), F.expr(f"shiftleft(1L, cast(pmod(xxhash64(key), {1 << bits}L) & 63 as int))")
    # at most 2^bits / 64 rows
    words = keys.where("key IS NOT NULL").groupBy(word).agg(F.bit_or(bit).alias("_bits"))
    met = cache.withColumn("_word", word).join(F.broadcast(words), "_word")
    return met.where(F.col("_bits").bitwiseAND(bit) != 0).drop("_word", "_bits")


def run_cached(docs: DataFrame, settings: Settings, cache: DataFrame | None = None, version: str = "") -> DataFrame:
    """file_id, filename, key, ``cached`` (its key was in the cache), ``ran`` (its stages ran) and the
    results of every document (file_id, filename, content)."""
    digest = settings_digest(settings, version)
    keyed = docs.withColumn("key", key_of(F.col("filename"), F.col("content"), digest))
    narrow = keyed.select("file_id", "filename", "key")
    if cache is None:
        cache = run_stages(docs.limit(0), settings).withColumns(
            {"key": F.lit(None).cast("string"), "document_text": F.col("parse.document_text")}).select("key", *RESULTS)
    known = thinned(cache, narrow).select("key", *RESULTS)
    # files without a key stand for themselves
    own = narrow.withColumn("group", F.coalesce("key", F.concat(F.lit("\u0001"), "file_id")))
    found = known.select("key", F.lit(True).alias("cached"))
    own = own.join(found, "key", "left").withColumn("cached", F.coalesce("cached", F.lit(False)))
    first = own.where("NOT cached").groupBy("group").agg(F.min("file_id").alias("file_id"))
    fresh = run_stages(docs.join(first, "file_id", "left_semi"), settings).join(first, "file_id").select(
        "group", F.col("parse.document_text").alias("document_text"), *[c for c in RESULTS if c != "document_text"])
    results = fresh.select("group", *RESULTS).unionByName(known.withColumnRenamed("key", "group"))
    ran = own.join(first.withColumn("ran", F.lit(True)), ["group", "file_id"], "left")
    return ran.join(results, "group").select(
        "file_id", "filename", "key", "cached", F.coalesce("ran", F.lit(False)).alias("ran"), *RESULTS)


def new_entries(done: DataFrame) -> DataFrame:
    """Rows to add to the cache after a run: completed results that it did not hold."""
    return done.where("ran AND key IS NOT NULL AND status = 'completed'").select("key", *RESULTS)
