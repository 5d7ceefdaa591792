"""Scans, ingest scalars, landing."""

from pyspark.sql import functions as F

from catalog import fixtures as fx
from catalog.registry import query, table
from dossierflow.functions.paths import file_extension, image_output_path, is_volume_path, safe_filename, volume_parts
from dossierflow.functions.text import decode_utf8
from dossierflow.operators import ingest
from dossierflow.sources.files import land, landed, read_files
from dossierflow.sources.folders import work_folder


@query(
    "read_files",
    """SELECT lang, CAST(sum(strlen(text) + 1) AS bigint) AS total_bytes, count(*) AS documents FROM documents
    WHERE text IS NOT NULL GROUP BY lang""",
)
def read_files_query(spark, sf):
    """Files below one folder per language, found recursively and read with their contents: what
    the listing says of their sizes must agree with the bytes read."""
    folder = work_folder(spark, "read-files")
    docs = table(spark, sf, "documents").select("lang", F.replace("text", F.lit("\n"), F.lit(" ")).alias("text"))
    docs.filter("text IS NOT NULL").write.option("maxRecordsPerFile", 1000).partitionBy("lang").text(folder)
    files = read_files(spark, folder, "*.txt", recursive=True).filter(F.octet_length("content") == F.col("length"))
    text = decode_utf8(F.col("content"))
    lines = F.length(text) - F.length(F.replace(text, F.lit("\n"), F.lit("")))
    return files.groupBy(F.regexp_extract("path", "/lang=([^/]*)/", 1).alias("lang")).agg(
        F.sum("length").cast("long").alias("total_bytes"), F.sum(lines).cast("long").alias("documents"))


@query(
    "landed_files",
    """SELECT '.txt' AS extension, CAST(sum(strlen(text) + 1) AS bigint) AS total_bytes,
    CAST(sum(length(text) - length(replace(text, chr(10), '')) + 1) AS bigint) AS lines FROM documents""",
)
def landed_files(spark, sf):
    """All documents written as files of bounded size and read back with their contents."""
    folder = work_folder(spark, "landed-files")
    table(spark, sf, "documents").select("text").write.option("maxRecordsPerFile", 1000).text(folder)
    files = read_files(spark, folder, "*.txt").withColumn("text", decode_utf8(F.col("content")))
    newlines = F.length("text") - F.length(F.replace("text", F.lit("\n"), F.lit("")))
    return files.groupBy(file_extension(F.col("filename")).alias("extension")).agg(
        F.sum(F.octet_length("content")).cast("long").alias("total_bytes"), F.sum(newlines).cast("long").alias("lines")
    )


@query("file_fingerprint", "SELECT doc_id, sha256(text) AS file_hash_sha256, CAST(strlen(text) AS bigint) AS size_bytes FROM documents")
def file_fingerprint(spark, sf):
    docs = table(spark, sf, "documents")
    content = F.col("text").cast("binary")
    return docs.select(
        "doc_id", ingest.fingerprint(content).alias("file_hash_sha256"),
        F.octet_length(content).cast("long").alias("size_bytes"),
    )


@query("safe_filename", "SELECT doc_id, filename, safe_filename FROM uploads", ("uploads",))
def safe_filename_query(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", F.expr(fx.UPLOAD_NAME).alias("filename"))
    return docs.withColumn("safe_filename", safe_filename(F.col("filename")))


@query(
    "volume_path_parts",
    """SELECT doc_id, split_part(volume_path, '/', 3) AS catalog, split_part(volume_path, '/', 4) AS schema_name,
    split_part(volume_path, '/', 5) AS volume_name, '/Volumes/main/' || lang || '/' || source || '/parsed_images/' AS image_output_path
    FROM uploads WHERE starts_with(volume_path, '/Volumes/')""",
    ("uploads",),
)
def volume_path_parts(spark, sf):
    up = fx.uploads(spark, sf).withColumn("parts", volume_parts(F.col("volume_path")))
    return up.filter("parts IS NOT NULL").select(
        "doc_id", "parts.catalog", F.col("parts.schema").alias("schema_name"), "parts.volume_name",
        image_output_path(F.col("volume_path")).alias("image_output_path"),
    )


@query(
    "volume_path_invalid",
    "SELECT doc_id, 'Invalid volume path format: ' || volume_path AS error FROM uploads WHERE doc_id % 17 = 0",
    ("uploads",),
)
def volume_path_invalid(spark, sf):
    up = fx.uploads(spark, sf)
    return up.filter(~is_volume_path(F.col("volume_path"))).select(
        "doc_id", F.concat(F.lit("Invalid volume path format: "), "volume_path").alias("error")
    )


@query(
    "supported_files",
    """SELECT doc_id, filename FROM uploads WHERE doc_id % 6 <> 4 AND strlen(text) <= 4000""",
    ("uploads",),
)
def supported_files(spark, sf):
    up = fx.uploads(spark, sf).withColumn("length", F.octet_length("text"))
    return up.filter(ingest.is_supported(F.col("filename"), F.col("length"), 4000)).select("doc_id", "filename")


@query(
    "ingest_manifest",
    """SELECT volume_path, max(doc_id) AS doc_id, arg_max(sha256(text), doc_id) AS file_hash_sha256,
    arg_max(filename, doc_id) AS filename, count(*) AS uploads FROM uploads GROUP BY volume_path""",
    ("uploads",),
)
def ingest_manifest(spark, sf):
    up = fx.uploads(spark, sf).select(
        "volume_path", "doc_id", "filename", ingest.fingerprint(F.col("text").cast("binary")).alias("file_hash_sha256")
    )
    return ingest.manifest(up, "doc_id")


@query(
    "ingest_new_only",
    """SELECT volume_path, min(doc_id) AS doc_id, arg_min(filename, doc_id) AS filename, count(*) - 1 AS refused
    FROM uploads WHERE doc_id NOT IN (SELECT doc_id FROM labels)
    AND volume_path NOT IN (SELECT volume_path FROM uploads JOIN labels USING (doc_id)) GROUP BY volume_path""",
    ("uploads",),
)
def ingest_new_only(spark, sf):
    """Labelled documents have landed before; the others are uploaded without overwrite."""
    up = fx.uploads(spark, sf).select("volume_path", "doc_id", "filename")
    labels = table(spark, sf, "labels").select("doc_id")
    existing = ingest.manifest(up.join(labels, "doc_id", "left_semi"), "doc_id")
    return ingest.new_only(up.join(labels, "doc_id", "left_anti"), existing, "doc_id")


@query(
    "land_twice",
    """SELECT volume_path, max(doc_id) AS doc_id, md5(arg_max(text, doc_id)) AS content_md5 FROM uploads GROUP BY volume_path""",
    ("uploads",),
)
def land_twice(spark, sf):
    """Two landings, the later documents first: nothing is lost and the newest upload of a path counts."""
    folder = work_folder(spark, "land-twice")
    uploads = fx.uploads(spark, sf).select("volume_path", "doc_id", "text")
    for part in ("doc_id % 3 = 0", "doc_id % 3 <> 0"):
        land(uploads.filter(part), folder)
    return landed(spark, folder, "doc_id").select("volume_path", "doc_id", F.md5("text").alias("content_md5"))


@query(
    "landed_content",
    """SELECT volume_path, max(doc_id) AS doc_id, md5(arg_max(text, doc_id)) AS content_md5 FROM uploads GROUP BY volume_path""",
    ("uploads",),
)
def landed_content(spark, sf):
    winners = ingest.latest_content(fx.uploads(spark, sf).select("volume_path", "doc_id", "text"), "doc_id")
    return winners.select("volume_path", "doc_id", F.md5("text").alias("content_md5"))
