"""Dashboard views."""

from pyspark.sql import functions as F

from catalog import fixtures as fx
from catalog.registry import query, table
from dossierflow.functions import replies as rp
from dossierflow.functions.paths import percent_encode
from dossierflow.plans import views

HOST, WORKSPACE, LOGS = "https://work.example.com", "42", "/Volumes/main/docs/logs/app"
_TOP = "(SELECT * FROM status ORDER BY created_at DESC NULLS FIRST, file_id LIMIT 20)"


@query(
    "status_table_view",
    f"""SELECT file_id, coalesce(primary_category, '-') AS category, entities_count AS entities,
    CASE status WHEN 'completed' THEN 'Pass' WHEN 'failed' THEN 'Fail (' || current_stage || ')'
        WHEN 'processing' THEN 'Processing (' || current_stage || ')' ELSE coalesce(status, '-') END AS status,
    strftime(created_at, '%Y-%m-%d %H:%M:%S') AS created, strftime(updated_at, '%Y-%m-%d %H:%M:%S') AS updated,
    CASE WHEN status = 'completed' THEN 'View' WHEN status = 'failed' AND volume_path IS NOT NULL THEN 'Resume|Reprocess|Delete'
        WHEN status = 'failed' THEN 'Delete' ELSE '-' END AS actions,
    CASE WHEN trace_id LIKE '%,%' THEN 'Latest: tr2' || file_id || '|Prev: tr' || file_id ELSE trace_id END AS traces,
    CASE WHEN status = 'completed' THEN '?view_results=' || file_id || '&filename=file%20' || file_id || '.txt'
        WHEN status = 'failed' AND volume_path IS NOT NULL THEN
        '?resume=' || file_id || '&filename=file%20' || file_id || '.txt&volume_path=' || volume_path || '&failed_stage=' || current_stage
        || '|?reprocess=' || file_id || '&filename=file%20' || file_id || '.txt&volume_path=' || volume_path || '|?delete=' || file_id
        WHEN status = 'failed' THEN '?delete=' || file_id ELSE '-' END AS action_links
    FROM {_TOP}""",
    ("status",),
)
def status_table_view(spark, sf):
    shown = views.status_table(fx.status(spark, sf), 20, HOST, WORKSPACE, LOGS)
    return shown.select(
        "file_id", "category", "entities", "status", "created", "updated",
        *[F.array_join(c, "|").alias(c) for c in ("actions", "traces", "action_links")])


@query(
    "trace_list",
    """SELECT file_id, CASE WHEN trace_id LIKE '%,%' THEN 'tr2' || file_id || ',tr' || file_id ELSE trace_id END AS traces,
    CASE WHEN trace_id LIKE '%,%' THEN 2 ELSE 1 END AS n FROM status""",
    ("status",),
)
def trace_list(spark, sf):
    ids = fx.status(spark, sf).withColumn("ids", views.trace_list(F.col("trace_id")))
    return ids.select("file_id", F.array_join("ids", ",").alias("traces"), F.size("ids").alias("n"))


@query(
    "links",
    f"""SELECT file_id,
    CASE WHEN volume_path IS NOT NULL THEN '{HOST}/files/main/docs/inbox/' || file_id || '.txt?workspace={WORKSPACE}' END AS file_url,
    '{HOST}/files/main/docs/logs/app/' || strftime(created_at, '%Y-%m-%d') || '/' || file_id || '.log?workspace={WORKSPACE}' AS log_url
    FROM status""",
    ("status",),
)
def links(spark, sf):
    return views.with_links(fx.status(spark, sf), HOST, WORKSPACE, LOGS).select("file_id", "file_url", "log_url")


@query("percent_encode",
       """SELECT doc_id, replace(replace(replace(filename, ' ', '%20'), '(', '%28'), ')', '%29') AS encoded FROM uploads""",
       ("uploads",))
def percent_encode_query(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", F.expr(fx.UPLOAD_NAME).alias("filename"))
    return docs.select("doc_id", percent_encode(F.col("filename")).alias("encoded"))


# stored deidentify results in every condition the reader knows
_ITEM = """{"type": "email", "value": "v' || CAST(doc_id AS string) || '", "strategy": "REDACT"}"""
_CONTROL_ITEM = """{"type": "email", "value": "a' || chr(7) || 'v' || CAST(doc_id AS string) || '", "strategy": "REDACT"}"""
STORED = (
    "CASE doc_id % 6 "
    f"""WHEN 0 THEN '{{"deidentification": {{"pii_items": [{_ITEM}, {{"type": "ssn"}}]}}, "pii_items_masked": 9}}' """
    f"""WHEN 1 THEN '{{"deidentification": {{' || chr(10) || '"pii_items": [' || chr(9) || '{_CONTROL_ITEM}]}}}}' """
    """WHEN 2 THEN '{''deidentification'': {''pii_items'': [{''type'': ''phone'', ''value'': None}]}, ''final_output'': True}' """
    f"""WHEN 3 THEN 'cut off {{"pii_items" : [{_ITEM}], "x": ' """
    """WHEN 4 THEN 'cut off {"pii_items": [{"type": "a", "value": "[b]"}], "x": ' """
    "ELSE 'nothing to see' END"
)


def stored(spark, sf):
    return table(spark, sf, "documents").select(
        F.concat(F.lit("d"), "doc_id").alias("file_id"), F.expr(STORED).alias("deidentify_result"))


@query(
    "json_repair",
    """SELECT 'd' || doc_id AS file_id, CASE doc_id % 6 WHEN 0 THEN 'json' WHEN 1 THEN 'json' WHEN 2 THEN 'repaired'
    WHEN 3 THEN 'salvaged' ELSE 'unreadable' END AS read_as FROM documents""",
)
def json_repair(spark, sf):
    return views.read_deidentify(stored(spark, sf)).select("file_id", "read_as")


@query("json_salvage",
       "SELECT 'd' || doc_id AS file_id, 'v' || doc_id AS value FROM documents WHERE doc_id % 6 = 3")
def json_salvage(spark, sf):
    """Items cut out of text that cannot be read as JSON."""
    rows = stored(spark, sf).filter(rp.repair_json(F.col("deidentify_result")).isNull())
    return rows.select("file_id", F.explode(rp.salvage_items(F.col("deidentify_result"))).alias("i")).select("file_id", "i.value")


@query(
    "pii_items_table",
    """SELECT 'd' || doc_id AS file_id, CASE WHEN doc_id % 6 = 0 THEN 9 ELSE 1 END AS pii_shown, 0 AS pos,
    CASE WHEN doc_id % 6 = 2 THEN 'phone' ELSE 'email' END AS type,
    CASE doc_id % 6 WHEN 2 THEN '' WHEN 1 THEN 'a v' || doc_id ELSE 'v' || doc_id END AS original_value,
    CASE WHEN doc_id % 6 = 2 THEN '' ELSE 'REDACT' END AS strategy, '' AS replacement FROM documents WHERE doc_id % 6 < 4
    UNION ALL SELECT 'd' || doc_id, 9, 1, 'ssn', '', '', '' FROM documents WHERE doc_id % 6 = 0""",
)
def pii_items_table(spark, sf):
    return views.pii_items_table(stored(spark, sf))


@query(
    "run_history",
    """SELECT left(sha256(CAST(event_id AS varchar)), 8) || '...' AS run, 'f' || user_id AS filename,
    upper(left(event_type, 1)) || substr(event_type, 2) AS status,
    printf('%d.%02ds', CAST(floor(event_id / 4) AS bigint), (event_id % 4) * 25) AS duration, strftime(ts, '%Y-%m-%d %H:%M:%S') AS timestamp
    FROM events WHERE event_type <> 'error'""",
)
def run_history(spark, sf):
    done = table(spark, sf, "events").filter("event_type <> 'error'").select(
        F.sha2(F.col("event_id").cast("string"), 256).alias("run_id"), F.concat(F.lit("f"), "user_id").alias("filename"),
        F.col("event_type").alias("status"), (F.col("event_id") / 4).alias("seconds"), F.col("ts").cast("string").alias("timestamp"))
    return views.run_history(done)


@query("upload_list", "SELECT filename, round(strlen(text) / 1048576.0, 2) AS size_mb FROM uploads", ("uploads",))
def upload_list(spark, sf):
    files = fx.uploads(spark, sf).select("filename", F.octet_length("text").alias("size_bytes"))
    return views.upload_list(files)
