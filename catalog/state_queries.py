"""Status and results tables."""

from pyspark.sql import functions as F

from catalog import fixtures as fx
from catalog.registry import query, table
from dossierflow.plans import results as res, snapshot as sn, status as st
from dossierflow.sources import upsert as up
from dossierflow.sources.folders import work_folder
from dossierflow.sources.tables import append, ensure_table

_STAGES = [f"stage_{s}_status" for s in ("ingest", "parse", "categorize", "extract", "deidentify")]
_MAIN = ["file_id", "filename", "volume_path", "status", "current_stage", "error_message", *_STAGES,
         "primary_category", "entities_count", "pii_items_masked"]


def _time(column: str):
    return F.date_format(column, "yyyy-MM-dd HH:mm:ss.SSSSSS").alias(column)


def _time_sql(column: str) -> str:
    return f"strftime(CAST({column} AS timestamp), '%Y-%m-%d %H:%M:%S.%f') AS {column}"


@query("status_initial",
       f"SELECT doc_id, {fx.UPLOAD_NAME} AS filename, 'processing' AS status, 'ingest' AS current_stage, '2024-01-01' AS created "
       "FROM documents")
def status_initial(spark, sf):
    """A record for every upload of a batch before any work starts."""
    docs = table(spark, sf, "documents").select(F.col("doc_id").cast("string").alias("file_id"), F.expr(fx.UPLOAD_NAME).alias("filename"))
    now = F.lit("2024-01-01 00:00:00").cast("timestamp")
    folded = st.fold(st.initial_events(docs, now))
    return folded.select(F.col("file_id").cast("long").alias("doc_id"), "filename", "status", "current_stage",
                         F.date_format("created_at", "yyyy-MM-dd").alias("created"))


@query("status_fold",
       f"SELECT {', '.join(_MAIN)}, {_time_sql('end_time')}, {_time_sql('created_at')}, {_time_sql('updated_at')} FROM status",
       ("status",))
def status_fold(spark, sf):
    return fx.status(spark, sf).select(*_MAIN, _time("end_time"), _time("created_at"), _time("updated_at"))


@query(
    "status_incremental",
    f"SELECT {', '.join(_MAIN)}, {_time_sql('end_time')}, {_time_sql('created_at')}, {_time_sql('updated_at')} FROM status",
    ("status",),
)
def status_incremental(spark, sf):
    """Every second event compacted first, the others added to what that leaves."""
    log = fx.stage_events(spark, sf)
    old = st.compact(log.filter("seq % 2 = 0"))
    status = st.fold(st.compact(old.unionByName(log.filter("seq % 2 <> 0"))))
    return status.select(*_MAIN, _time("end_time"), _time("created_at"), _time("updated_at"))


def _snapshot(spark, sf):
    """The log merged in three parts, each of which holds events of all times."""
    folder = work_folder(spark, "status-snapshot")
    table_ = sn.SnapshotTable(spark, f"status_{folder.rsplit('-', 1)[1]}", folder, buckets=8)
    log = fx.stage_events(spark, sf)
    for part in (2, 0, 1):
        table_.merge(log.filter(F.pmod("seq", F.lit(3)) == part))
    return table_


@query("status_snapshot_merge",
       f"SELECT {', '.join(_MAIN)}, {_time_sql('end_time')}, {_time_sql('created_at')}, {_time_sql('updated_at')} FROM status",
       ("status",))
def status_snapshot_merge(spark, sf):
    """Status read from a bucketed snapshot that new and late events were merged into."""
    return _snapshot(spark, sf).status().select(*_MAIN, _time("end_time"), _time("created_at"), _time("updated_at"))


@query("status_snapshot_topk",
       f"SELECT file_id, status, {_time_sql('created_at')} FROM (SELECT * FROM status ORDER BY created_at DESC NULLS FIRST, file_id LIMIT 20)",
       ("status",))
def status_snapshot_topk(spark, sf):
    """The newest files of a snapshot: no log is read."""
    return st.processing_status(_snapshot(spark, sf).status(), limit=20).select("file_id", "status", _time("created_at"))


@query("status_failed",
       f"SELECT file_id, current_stage, error_message, {', '.join(_STAGES)}, {_time_sql('end_time')} FROM status WHERE status = 'failed'",
       ("status",))
def status_failed(spark, sf):
    return fx.status(spark, sf).filter("status = 'failed'").select(
        "file_id", "current_stage", "error_message", *_STAGES, _time("end_time"))


def _through_table(spark, rows, kind):
    """Rows appended to a table that is created for them, read back from it."""
    folder = work_folder(spark, f"{kind}-table")
    name = f"{kind}_{folder.rsplit('-', 1)[1]}"
    ensure_table(spark, name, kind, folder)
    append(rows, name, kind)
    return spark.table(name)


@query("status_table_rows",
       f"SELECT {', '.join(_MAIN)}, {_time_sql('created_at')} FROM status", ("status",))
def status_table_rows(spark, sf):
    return _through_table(spark, fx.status(spark, sf), "status").select(*_MAIN, _time("created_at"))


@query(
    "results_table_rows",
    """SELECT 'f' || doc_id AS file_id, 'tr' || doc_id AS trace_id, 'exp' AS experiment_id,
    '/Volumes/main/docs/inbox/' || doc_id AS source_volume_path, CAST(NULL AS varchar) AS parse_result FROM labels""",
)
def results_table_rows(spark, sf):
    rows = res.skeleton(_results(spark, sf), F.lit("2024-01-01 00:00:00").cast("timestamp"))
    return _through_table(spark, rows, "results").select(
        "file_id", "trace_id", "experiment_id", "source_volume_path", "parse_result")


@query("status_lookup", f"SELECT {', '.join(_MAIN)} FROM status WHERE file_id = 'f7'", ("status",))
def status_lookup(spark, sf):
    return st.processing_status(fx.status(spark, sf), "f7").select(*_MAIN)


@query("status_topk",
       f"SELECT file_id, status, {_time_sql('created_at')} FROM (SELECT * FROM status ORDER BY created_at DESC NULLS FIRST, file_id LIMIT 20)",
       ("status",))
def status_topk(spark, sf):
    return st.processing_status(fx.status(spark, sf), limit=20).select("file_id", "status", _time("created_at"))


@query("status_delete",
       "SELECT file_id, status FROM status WHERE CAST(substr(file_id, 2) AS bigint) NOT IN (SELECT doc_id FROM labels WHERE toxic = 0)",
       ("status",))
def status_delete(spark, sf):
    return st.delete_records(fx.status(spark, sf), _to_delete(spark, sf)).select("file_id", "status")


def _to_delete(spark, sf):
    return table(spark, sf, "labels").filter("toxic = 0").select(F.concat(F.lit("f"), "doc_id").alias("file_id"))


@query(
    "status_delete_report",
    """SELECT 'f' || doc_id AS file_id, CASE WHEN s.file_id IS NULL THEN 0 ELSE 1 END AS deleted,
    CASE WHEN s.file_id IS NULL THEN 'no record of this file' END AS error
    FROM labels LEFT JOIN status s ON s.file_id = 'f' || doc_id WHERE toxic = 0""",
    ("status",),
)
def status_delete_report(spark, sf):
    report = st.deletion_report(fx.status(spark, sf), _to_delete(spark, sf))
    return report.select("file_id", F.col("deleted").cast("int").alias("deleted"), "error")


_STUCK = """SELECT file_id, 'failed' AS status, current_stage,
    'The run was cut off by a restart during stage ' || current_stage AS error_message,
    CASE WHEN current_stage = 'extract' THEN 'failed' ELSE stage_extract_status END AS stage_extract_status
    FROM status WHERE status = 'processing'"""


@query("reset_stuck", _STUCK, ("status",))
def reset_stuck(spark, sf):
    now = F.lit("2024-02-01 00:00:00").cast("timestamp")
    return st.reset_stuck(fx.status(spark, sf), now).select(
        "file_id", "status", "current_stage", "error_message", "stage_extract_status")


@query("reset_stuck_count", f"SELECT count(*) AS reset_count FROM ({_STUCK})", ("status",))
def reset_stuck_count(spark, sf):
    """The sweep as log entries, counted."""
    now = F.lit("2024-02-01 00:00:00").cast("timestamp")
    return st.reset_stuck_events(fx.status(spark, sf), now).agg(F.count("*").alias("reset_count"))


def _results(spark, sf):
    """A result for every file number that has a label."""
    labels = table(spark, sf, "labels")
    return labels.select(
        F.concat(F.lit("f"), "doc_id").alias("file_id"), F.concat(F.lit("tr"), "doc_id").alias("trace_id"),
        F.lit("exp").alias("experiment_id"), F.concat(F.lit("/Volumes/main/docs/inbox/"), "doc_id").alias("volume_path"),
        "quality")


@query(
    "results_after_rerun",
    """SELECT 'f' || doc_id AS file_id, 'tr' || doc_id AS trace_id,
    CASE WHEN quality = 0 THEN 'parse 2' ELSE 'parse 1' END AS parse_result, 'category 1' AS categorize_result,
    '2024-01-01' AS created, CASE WHEN quality = 0 THEN '2024-01-02' ELSE '2024-01-01' END AS updated FROM labels""",
)
def results_after_rerun(spark, sf):
    """One row per file after a rerun that got no further than parse."""
    def rows(part, day, **stages):
        now = F.lit(f"2024-01-0{day} 00:00:00").cast("timestamp")
        return res.skeleton(part, now).withColumns({f"{s}_result": F.lit(v) for s, v in stages.items()})

    first = rows(_results(spark, sf), 1, parse="parse 1", categorize="category 1")
    again = rows(_results(spark, sf).filter("quality = 0"), 2, parse="parse 2")
    return res.fold(first.unionByName(again)).select(
        "file_id", "trace_id", "parse_result", "categorize_result",
        F.date_format("created_at", "yyyy-MM-dd").alias("created"), F.date_format("updated_at", "yyyy-MM-dd").alias("updated"))


@query(
    "results_upsert",
    """SELECT 'f' || doc_id AS file_id, 'tr' || doc_id AS trace_id, CASE WHEN quality = 0 THEN 'parse 2' ELSE 'parse 1' END AS parse_result,
    'category 1' AS categorize_result, CASE WHEN quality = 0 AND toxic = 1 THEN 'found 3' END AS extract_result,
    CASE WHEN quality = 0 AND toxic = 1 THEN '2024-01-03' WHEN quality = 0 THEN '2024-01-02' ELSE '2024-01-01' END AS updated
    FROM labels""",
)
def results_upsert(spark, sf):
    """Stage results written into their buckets one after the other, one of them twice."""
    folder = work_folder(spark, "results-upsert")
    day = lambda n: F.lit(f"2024-01-0{n} 00:00:00").cast("timestamp")
    first = res.skeleton(_results(spark, sf), day(1)).withColumns(
        {"parse_result": F.lit("parse 1"), "categorize_result": F.lit("category 1")})
    up.create(first, folder, buckets=16)
    labels = table(spark, sf, "labels").filter("quality = 0").withColumn("file_id", F.concat(F.lit("f"), "doc_id"))
    for rows, stage, json, at in ((labels, "parse", "parse 2", 2), (labels.filter("toxic = 1"), "extract", "found 3", 3),
                                  (labels, "parse", "parse 2", 2)):
        up.upsert(up.stage_rows(rows.select(
            "file_id", F.lit(stage).alias("stage_name"), F.lit(json).alias("result_json"), day(at).alias("updated_at"))),
            folder, buckets=16)
    return up.read(spark, folder).select(
        "file_id", "trace_id", "parse_result", "categorize_result", "extract_result",
        F.date_format("updated_at", "yyyy-MM-dd").alias("updated"))


@query(
    "results_skeleton",
    """SELECT 'f' || doc_id AS file_id, 'tr' || doc_id AS trace_id, 'exp' AS experiment_id,
    '/Volumes/main/docs/inbox/' || doc_id AS source_volume_path, 4 AS empty_columns FROM labels""",
)
def results_skeleton(spark, sf):
    rows = res.skeleton(_results(spark, sf), F.lit("2024-01-01 00:00:00").cast("timestamp"))
    empty = sum(F.col(f"{s}_result").isNull().cast("int") for s in ("parse", "categorize", "extract", "deidentify"))
    return rows.select("file_id", "trace_id", "experiment_id", "source_volume_path", empty.alias("empty_columns"))


_STAGE_NAME = "CASE event_type WHEN 'click' THEN 'parse' WHEN 'view' THEN 'categorize' WHEN 'signup' THEN 'extract' WHEN 'purchase' THEN 'deidentify' ELSE 'ingest' END"


@query(
    "results_json_by_stage",
    "SELECT 'f' || user_id AS file_id, " + ", ".join(
        f"CAST(json_extract(arg_max(props, (ts, event_id)) FILTER (WHERE event_type = '{e}'), '$.k') AS bigint) AS {s}_k"
        for e, s in (("click", "parse"), ("view", "categorize"), ("signup", "extract"), ("purchase", "deidentify")))
    + " FROM events WHERE event_type <> 'error' GROUP BY user_id",
)
def results_json_by_stage(spark, sf):
    updates = table(spark, sf, "events").select(
        F.concat(F.lit("f"), "user_id").alias("file_id"), F.expr(_STAGE_NAME).alias("stage_name"),
        F.col("props").alias("result_json"), F.struct("ts", "event_id").alias("updated_at"))
    rows = res.from_stage_updates(updates)
    return rows.select("file_id", *[
        F.get_json_object(f"{s}_result", "$.k").cast("bigint").alias(f"{s}_k") for s in ("parse", "categorize", "extract", "deidentify")])


@query(
    "results_lookup",
    """SELECT s.file_id, CASE WHEN l.doc_id IS NULL THEN 'no result is stored for this file' END AS lookup_error, quality
    FROM status s LEFT JOIN labels l ON s.file_id = 'f' || l.doc_id""",
    ("status",),
)
def results_lookup(spark, sf):
    found = res.for_files(fx.status(spark, sf), _results(spark, sf))
    return found.select("file_id", "lookup_error", "quality")


@query("orphan_results",
       "SELECT 'f' || doc_id AS file_id FROM labels WHERE 'f' || doc_id NOT IN (SELECT file_id FROM status)", ("status",))
def orphan_results(spark, sf):
    return res.orphans(_results(spark, sf), fx.status(spark, sf)).select("file_id")


@query(
    "stage_counts",
    """SELECT position, stage, coalesce(n, 0) AS n FROM
    (VALUES (0, 'ingest'), (1, 'parse'), (2, 'categorize'), (3, 'extract'), (4, 'deidentify'), (5, 'total')) AS v(position, stage)
    LEFT JOIN (SELECT lower(current_stage) AS stage, count(*) AS n FROM status WHERE status = 'processing' GROUP BY 1
    UNION ALL SELECT 'total', count(*) FROM status WHERE status = 'processing') USING (stage)""",
    ("status",),
)
def stage_counts(spark, sf):
    return st.stage_counts(fx.status(spark, sf))
