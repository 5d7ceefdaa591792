"""Whole runs, resume, spans and logs."""

from pyspark.sql import functions as F

from catalog import fixtures as fx
from catalog.registry import query, table, view
from catalog.rule_queries import categorize_sql
from dossierflow.plans import cache, resume, results as res, runs, spans as sp, status as st, views
from dossierflow.plans.runs import run_stages
from dossierflow.sources import logs
from dossierflow.sources.folders import work_folder

# documents that reach stage 3, with the outcome of the three rule stages
view("finished", "SELECT doc_id, file_id, content AS text FROM runs WHERE error IS NULL", ("runs",))
view("finished_categories", categorize_sql("finished", "lexicon"), ("finished", "lexicon"))
view(
    "outcomes",
    """SELECT r.file_id, r.doc_id, r.filename, CASE WHEN r.error IS NULL THEN 'completed' ELSE 'failed' END AS status,
    r.error, r.failed_stage, CASE r.failed_stage WHEN 'ingest' THEN 1 WHEN 'parse' THEN 2 ELSE 5 END AS stages_completed,
    c.primary_category, c.primary_confidence,
    CASE WHEN r.error IS NULL THEN (SELECT count(*) FROM doc_entities e WHERE e.doc_id = r.doc_id) ELSE 0 END AS entities_count,
    CASE WHEN r.error IS NULL THEN (SELECT count(*) FROM doc_pii p WHERE p.doc_id = r.doc_id) ELSE 0 END AS pii_items_masked
    FROM runs r LEFT JOIN finished_categories c USING (doc_id)""",
    ("runs", "finished_categories", "doc_entities", "doc_pii"),
)
_COUNTS = ("CAST(entities_count AS int) AS entities_count", "CAST(pii_items_masked AS int) AS pii_items_masked")


def wide(spark, sf, **changes):
    return run_stages(fx.run_docs(spark, sf), fx.run_settings(**changes))


@query(
    "document_wide",
    f"""SELECT o.file_id, o.status, o.failed_stage, o.error, o.stages_completed,
    CASE WHEN o.failed_stage = 'ingest' THEN NULL ELSE '/Volumes/main/docs/inbox/' || {fx.SAFE_SQL.replace('filename', 'o.filename')} END AS volume_path,
    sha256(r.content) AS file_hash_sha256, CAST(CASE WHEN o.error IS NULL THEN length(r.content) END AS int) AS text_length,
    o.primary_category, o.primary_confidence, {_COUNTS[0]}, {_COUNTS[1]},
    CASE WHEN o.error IS NULL THEN 'rules' END AS model_used, CASE WHEN o.error IS NULL THEN 1 ELSE 0 END AS final_output
    FROM outcomes o JOIN runs r USING (file_id)""",
    ("outcomes",),
)
def document_wide(spark, sf):
    return wide(spark, sf).select(
        "file_id", "status", "failed_stage", "error", "stages_completed", "volume_path", "ingest.file_hash_sha256",
        F.length("parse.document_text").alias("text_length"), "primary_category", "categorization.primary_confidence",
        "entities_count", "pii_items_masked", "model_used", F.col("final_output").cast("int").alias("final_output"),
    )


@query("run_failures",
       """SELECT file_id, filename, failed_stage, stages_completed, error, left(error, 500) AS error_attribute
       FROM outcomes WHERE status = 'failed'""", ("outcomes",))
def run_failures(spark, sf):
    return runs.failures(wide(spark, sf))


@query("run_summary",
       f"SELECT file_id, filename, status, stages_completed, primary_category, {_COUNTS[0]}, {_COUNTS[1]} FROM outcomes",
       ("outcomes",))
def run_summary(spark, sf):
    return runs.summary(wide(spark, sf))


@query(
    "forced_failure",
    """SELECT file_id, 'failed' AS status, coalesce(failed_stage, 'extract') AS failed_stage,
    CASE WHEN failed_stage IS NULL THEN 4 ELSE stages_completed END AS stages_completed,
    coalesce(error, 'forced to fail at extract') AS error,
    CAST(entities_count AS int) AS entities_count, 0 AS pii_items_masked FROM outcomes""",
    ("outcomes",),
)
def forced_failure(spark, sf):
    out = wide(spark, sf, force_fail_stage="EXTRACT")
    return out.select("file_id", "status", "failed_stage", "stages_completed", "error", "entities_count", "pii_items_masked")


@query(
    "batch_outcomes",
    """SELECT status, count(*) AS files, CAST(sum(entities_count) AS bigint) AS entities,
    CAST(sum(pii_items_masked) AS bigint) AS pii_items FROM outcomes GROUP BY status""",
    ("outcomes",),
)
def batch_outcomes(spark, sf):
    return views.batch_outcomes(wide(spark, sf))


@query(
    "statement_runs",
    """SELECT s.doc_id, 'completed' AS status, (SELECT count(*) FROM st_entities e WHERE e.doc_id = s.doc_id) AS entities_count,
    (SELECT count(*) FROM st_pii_found p WHERE p.doc_id = s.doc_id) AS pii_items_masked FROM statements s""",
    ("statements", "st_entities", "st_pii_found"),
)
def statement_runs(spark, sf):
    """All five stages over the account statements with the default rules and lexicon."""
    docs = fx.statements(spark, sf).select(
        F.col("doc_id"), F.concat(F.lit("s"), "doc_id").alias("file_id"),
        F.concat(F.lit("statement "), "doc_id", F.lit(".txt")).alias("filename"), F.col("text").cast("binary").alias("content"))
    out = run_stages(docs, fx.Settings(**fx.RUN_SETTINGS))
    return out.select("doc_id", "status", F.col("entities_count").cast("long").alias("entities_count"),
                      F.col("pii_items_masked").cast("long").alias("pii_items_masked"))


@query(
    "run_status_rows",
    """SELECT file_id, filename, status, CASE WHEN failed_stage IS NULL THEN 'deidentify' ELSE failed_stage END AS current_stage,
    CASE WHEN failed_stage = 'ingest' THEN 'failed' ELSE 'completed' END AS stage_ingest_status,
    CASE failed_stage WHEN 'ingest' THEN NULL WHEN 'parse' THEN 'failed' ELSE 'completed' END AS stage_parse_status,
    CASE WHEN failed_stage IS NULL THEN 'completed' END AS stage_deidentify_status, error AS error_message,
    primary_category, CASE WHEN failed_stage IS NULL THEN CAST(entities_count AS int) END AS entities_count
    FROM outcomes""",
    ("outcomes",),
)
def run_status_rows(spark, sf):
    """Status table that a batch of runs leaves behind, by way of its update log."""
    log = st.events_of_runs(wide(spark, sf), F.lit("2024-01-01 00:00:00").cast("timestamp"))
    return st.fold(log).select(
        "file_id", "filename", "status", "current_stage", "stage_ingest_status", "stage_parse_status",
        "stage_deidentify_status", "error_message", "primary_category", "entities_count")


@query(
    "results_rows",
    """SELECT file_id, md5(CASE WHEN status = 'completed' THEN content END) AS text_md5, primary_category,
    CASE WHEN status = 'completed' THEN CAST(o.entities_count AS int) END AS entities_count,
    CASE WHEN status = 'completed' THEN CAST(o.pii_items_masked AS int) END AS pii_items_masked,
    CASE WHEN status = 'completed' THEN (SELECT count(*) FROM doc_entities e WHERE e.doc_id = o.doc_id AND e.type = 'email') END AS emails_found,
    CASE WHEN status = 'completed' THEN (SELECT count(*) FROM doc_entities e WHERE e.doc_id = o.doc_id
        AND e.type IN ('person', 'organization', 'email')) END AS values_masked
    FROM outcomes o JOIN runs r USING (file_id) WHERE o.failed_stage IS DISTINCT FROM 'ingest'""",
    ("outcomes", "runs"),
)
def results_rows(spark, sf):
    """Results table of a batch of runs, read back from its JSON."""
    rows = res.from_wide(wide(spark, sf), F.lit("2024-01-01 00:00:00").cast("timestamp"))
    entity = "entities:array<struct<type:string,value:string,masked:boolean>>"
    found = F.from_json("extract_result", f"struct<extraction:struct<{entity}>,entities_count:int>")
    masked = F.from_json("deidentify_result", f"struct<extraction:struct<{entity}>,pii_items_masked:int>")
    return rows.withColumns({"x": found, "m": masked}).select(
        "file_id",
        F.md5(F.get_json_object("parse_result", "$.document_text")).alias("text_md5"),
        F.get_json_object("categorize_result", "$.categorization.primary_category").alias("primary_category"),
        "x.entities_count", "m.pii_items_masked",
        F.size(F.filter("x.extraction.entities", lambda e: e["value"].contains("@"))).cast("long").alias("emails_found"),
        F.size(F.filter("m.extraction.entities", lambda e: e["value"] == "[REDACTED]")).cast("long").alias("values_masked"),
    ).withColumns({c: F.when(F.col("entities_count").isNotNull(), F.col(c)) for c in ("emails_found", "values_masked")})


# --- resume -------------------------------------------------------------------------------
# cached results of every document: which stages are stored, and the stage asked for
FAILED = ("CASE doc_id % 7 WHEN 0 THEN NULL WHEN 1 THEN 'ingest' WHEN 2 THEN 'parse' WHEN 3 THEN 'Categorize' "
          "WHEN 4 THEN 'EXTRACT' WHEN 5 THEN 'deidentify' ELSE 'other' END")
view(
    "requests",
    f"""SELECT doc_id, 'd' || doc_id AS file_id, text, {FAILED} AS failed_stage,
    CASE doc_id % 7 WHEN 3 THEN 1 WHEN 4 THEN 2 WHEN 5 THEN 3 ELSE 0 END AS requested_index,
    CASE WHEN doc_id % 19 <> 0 THEN '/Volumes/main/docs/inbox/d' || doc_id || '.txt' END AS volume_path,
    CASE WHEN doc_id % 5 = 0 THEN NULL ELSE 'old' || doc_id END AS old_trace FROM documents""",
)
view(
    "plans",
    """SELECT *, CASE WHEN doc_id % 8 = 0 THEN 0 WHEN doc_id % 8 = 1 THEN least(requested_index, 2) ELSE requested_index END AS start_index
    FROM requests""",
    ("requests",),
)


def requests(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id")
    return docs.select(
        F.concat(F.lit("d"), "doc_id").alias("file_id"),
        # half the requests leave the path to the status table
        F.when(F.col("doc_id") % 19 == 0, F.lit("")).when(
            F.col("doc_id") % 2 == 0, F.concat(F.lit("/Volumes/main/docs/inbox/d"), "doc_id", F.lit(".txt"))
        ).otherwise(F.lit("")).alias("volume_path"),
        F.concat(F.lit("d"), "doc_id", F.lit(".txt")).alias("filename"),
        F.expr(FAILED).alias("failed_stage"),
        F.concat(F.lit("new"), "doc_id").alias("trace_id"),
    )


def known_status(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id")
    return docs.select(
        F.concat(F.lit("d"), "doc_id").alias("file_id"),
        F.when(F.col("doc_id") % 19 != 0, F.concat(F.lit("/Volumes/main/docs/inbox/d"), "doc_id", F.lit(".txt"))).alias("volume_path"),
        F.when(F.col("doc_id") % 5 != 0, F.concat(F.lit("old"), "doc_id")).alias("trace_id"),
    )


def known_results(spark, sf):
    """Stored JSON: broken parse results for every eighth document, no extract result
    for the next."""
    docs = table(spark, sf, "documents").select("doc_id", "text")
    pages = F.array(F.struct(F.col("text").alias("text"), F.lit(0).alias("page_id")))
    parsed = F.to_json(F.struct(F.lit("success").alias("status"), F.col("text").alias("document_text"), pages.alias("pages")))
    category = F.to_json(F.struct(F.struct(
        F.concat(F.lit("Cached "), F.col("doc_id") % 3).alias("primary_category"),
        F.lit(0.5).alias("primary_confidence")).alias("categorization")))
    entity = F.struct(F.lit("date").alias("type"), F.lit("2024-01-01").alias("value"), F.lit(1.0).alias("confidence"))
    extraction = F.to_json(F.struct(F.struct(F.array(entity, entity).alias("entities")).alias("extraction")))
    return docs.select(
        F.concat(F.lit("d"), "doc_id").alias("file_id"),
        F.when(F.col("doc_id") % 8 == 0, F.lit('{"status": "succ')).otherwise(parsed).alias("parse_result"),
        category.alias("categorize_result"),
        F.when(F.col("doc_id") % 8 != 1, extraction).alias("extract_result"),
    )


def planned(spark, sf):
    return resume.plan(requests(spark, sf), known_status(spark, sf), known_results(spark, sf))


@query(
    "resume_plan",
    """SELECT file_id, requested_index, start_index, CASE start_index WHEN 0 THEN 'parse' WHEN 1 THEN 'categorize' WHEN 2 THEN 'extract'
    ELSE 'deidentify' END AS start_stage, CASE WHEN requested_index > 0 THEN 1 ELSE 0 END AS is_resume FROM plans""",
    ("plans",),
)
def resume_plan(spark, sf):
    return planned(spark, sf).select("file_id", "requested_index", "start_index", "start_stage",
                                     F.col("is_resume").cast("int").alias("is_resume"))


@query(
    "resume_backfill",
    """SELECT file_id, volume_path, CASE WHEN volume_path IS NULL THEN
    'no volume path, neither given nor recorded' END AS error FROM requests""",
    ("requests",),
)
def resume_backfill(spark, sf):
    return resume.backfill(requests(spark, sf), known_status(spark, sf)).select("file_id", "volume_path", "error")


@query(
    "resume_cached",
    """SELECT file_id, CASE WHEN start_index > 0 THEN md5(text) END AS parse_md5,
    CASE WHEN start_index > 1 THEN 'Cached ' || (doc_id % 3) END AS cached_category,
    CASE WHEN start_index > 2 THEN 2 END AS cached_entities FROM plans""",
    ("plans",),
)
def resume_cached(spark, sf):
    return planned(spark, sf).select(
        "file_id", F.md5("cached_parse.document_text").alias("parse_md5"),
        F.col("cached_categorization.primary_category").alias("cached_category"),
        F.size("cached_extraction.entities").alias("cached_entities"))


@query(
    "trace_history",
    """SELECT file_id, CASE WHEN requested_index > 0 AND old_trace IS NOT NULL THEN old_trace || ',new' || doc_id
    ELSE 'new' || doc_id END AS trace_ids FROM requests""",
    ("requests",),
)
def trace_history(spark, sf):
    return planned(spark, sf).select("file_id", "trace_ids")


def resumed(spark, sf):
    landed = table(spark, sf, "documents").select(
        F.concat(F.lit("d"), "doc_id").alias("file_id"), F.col("text").cast("binary").alias("content"))
    return resume.run(planned(spark, sf), landed, fx.run_settings())


view("all_categories", categorize_sql("documents", "lexicon"), ("lexicon",))


@query(
    "resume_result",
    """SELECT p.file_id, CASE WHEN volume_path IS NULL THEN 'failed' ELSE 'completed' END AS status, start_index,
    CASE WHEN start_index > 1 THEN 'Cached ' || (p.doc_id % 3) WHEN volume_path IS NOT NULL THEN c.primary_category END AS primary_category,
    CASE WHEN start_index > 2 THEN 2 WHEN volume_path IS NULL THEN 0
        ELSE CAST((SELECT count(*) FROM doc_entities e WHERE e.doc_id = p.doc_id) AS int) END AS entities_count,
    CASE WHEN volume_path IS NULL THEN 0 ELSE CAST((SELECT count(*) FROM doc_pii e WHERE e.doc_id = p.doc_id) AS int) END AS pii_items_masked
    FROM plans p JOIN all_categories c USING (doc_id)""",
    ("plans", "all_categories", "doc_entities", "doc_pii"),
)
def resume_result(spark, sf):
    return resumed(spark, sf).select("file_id", "status", "start_index", "primary_category", "entities_count", "pii_items_masked")


@query(
    "status_null_reset",
    """SELECT file_id, 'processing' AS status,
    CASE WHEN start_index > 0 THEN 'completed' END AS stage_parse_status,
    CASE WHEN start_index > 1 THEN 'completed' END AS stage_categorize_status,
    CASE WHEN start_index > 2 THEN 'completed' END AS stage_extract_status,
    CAST(NULL AS varchar) AS stage_deidentify_status, CAST(NULL AS varchar) AS error_message
    FROM plans WHERE volume_path IS NOT NULL""",
    ("plans",),
)
def status_null_reset(spark, sf):
    """Failed files as a rerun opens them: kept stages completed, the others NULL again."""
    plan = planned(spark, sf)
    before = plan.select(
        "file_id", F.lit("2024-01-01 00:00:00").cast("timestamp").alias("event_time"), F.lit(0).cast("long").alias("seq"),
        st.failed(F.lit("old error"), F.lit("deidentify"), F.lit("2024-01-01 00:00:00")).alias("changes"))
    opened = resume.reset_changes(plan, F.lit("2024-01-02 00:00:00").cast("timestamp"))
    status = st.fold(before.unionByName(opened)).filter("status = 'processing'")
    return status.select("file_id", "status", "stage_parse_status", "stage_categorize_status", "stage_extract_status",
                         "stage_deidentify_status", "error_message")


# --- spans and logs -----------------------------------------------------------------------
view(
    "span_names",
    """SELECT * FROM (VALUES (0, 'process_file_pipeline', 'CHAIN'), (1, 'stage_1_ingest', 'CHAIN'), (2, 'stage_2_parse', 'PARSER'),
    (3, 'stage_3_categorize', 'LLM'), (4, 'stage_4_extract', 'RETRIEVER'), (5, 'stage_5_deidentify', 'LLM')) AS v(position, name, kind)""",
)


def spans_of(spark, sf):
    settings = fx.run_settings()
    return sp.spans(wide(spark, sf), settings)


@query(
    "spans_long",
    """SELECT file_id, position, name, kind, CASE WHEN position > 0 THEN 'process_file_pipeline' END AS parent,
    CASE WHEN position = 0 THEN status WHEN position = stages_completed AND status = 'failed' THEN error
         WHEN position = 3 THEN primary_category WHEN position = 4 THEN CAST(entities_count AS varchar)
         WHEN position = 5 THEN CAST(pii_items_masked AS varchar) ELSE 'success' END AS outcome
    FROM outcomes JOIN span_names ON position <= stages_completed""",
    ("outcomes", "span_names"),
)
def spans_long(spark, sf):
    o = F.col("outputs")
    outcome = F.coalesce(
        F.when(F.col("position") == 0, o["status"]), F.when(F.col("position") > 0, o["error"]), o["primary_category"],
        o["entities_count"], o["pii_items_masked"], o["status"])
    return spans_of(spark, sf).select("file_id", "position", "name", "kind", "parent", outcome.alias("outcome"))


_KEYS = {
    # (position, when failed): attributes | inputs | outputs
    0: ("pipeline_version pipeline_id filename file_size_bytes", "filename file_size_bytes pipeline_id",
        "status stages_completed primary_category entities_count pii_items_masked"),
    1: ("stage filename catalog schema volume_name file_size_bytes",
        "filename catalog schema volume_name file_size_bytes overwrite",
        "status volume_path safe_filename size_bytes file_hash_sha256"),
    2: ("stage parser volume_path", "volume_path parser", "status text_length text_sample image_output_path pages_count"),
    3: ("stage model request_id prompt_tokens completion_tokens total_tokens finish_reason",
        "prompt_template model document_text_length",
        "primary_category primary_confidence primary_justification secondary_category secondary_confidence"),
    4: ("stage model request_id prompt_tokens completion_tokens total_tokens finish_reason",
        "prompt_template model document_text_length", "entities_count entities"),
    5: ("stage model request_id prompt_tokens completion_tokens total_tokens finish_reason",
        "prompt_template model document_text_length", "pii_items_masked pii_items"),
}
_KEY_ROWS = ", ".join(f"({p}, '{w}', '{k}')" for p, sets in _KEYS.items()
                      for w, names in zip(("attributes", "inputs", "outputs"), sets) for k in names.split())


@query(
    "spans_keys",
    f"""SELECT position, map_name, key, count(*) AS spans FROM (
    SELECT position, map_name, key FROM outcomes o JOIN (VALUES {_KEY_ROWS}) AS k(position, map_name, key)
        ON position <= stages_completed WHERE status = 'completed' OR map_name <> 'outputs' OR (position > 0 AND position < stages_completed)
    UNION ALL SELECT stages_completed, 'outputs', 'error' FROM outcomes WHERE status = 'failed'
    UNION ALL SELECT 0, 'attributes', unnest(['pipeline_status', 'failed_at_stage', 'stages_completed', 'error_message']) FROM outcomes WHERE status = 'failed'
    UNION ALL SELECT 0, 'outputs', unnest(['status', 'failed_at_stage', 'stages_completed', 'error']) FROM outcomes WHERE status = 'failed')
    GROUP BY ALL""",
    ("outcomes",),
)
def spans_keys(spark, sf):
    sides = F.array(*[
        F.struct(F.lit(n).alias("map_name"), F.map_keys(n).alias("keys")) for n in ("attributes", "inputs", "outputs")])
    rows = spans_of(spark, sf).select("position", F.inline(sides)).select("position", "map_name", F.explode("keys").alias("key"))
    return rows.groupBy("position", "map_name", "key").agg(F.count("*").alias("spans"))


@query("spans_failed",
       "SELECT failed_stage AS failed_at_stage, count(*) AS runs FROM outcomes WHERE status = 'failed' GROUP BY ALL",
       ("outcomes",))
def spans_failed(spark, sf):
    return sp.failed_runs(spans_of(spark, sf))


@query(
    "spans_replay",
    """SELECT file_id, position, name, CASE WHEN position - 2 < start_index THEN 'true' END AS is_cached_replay,
    CASE WHEN position - 2 < start_index THEN CASE position WHEN 2 THEN CAST(length(text) AS varchar)
        WHEN 3 THEN '0.5' ELSE '2' END END AS replayed
    FROM plans JOIN span_names ON position >= 2 WHERE volume_path IS NOT NULL""",
    ("plans", "span_names"),
)
def spans_replay(spark, sf):
    rows = sp.spans(resumed(spark, sf), fx.run_settings()).filter("position >= 2")
    a = F.col("attributes")
    replayed = F.when(a["is_cached_replay"].isNotNull(), F.coalesce(a["text_length"], a["confidence"], a["entities_count"]))
    return rows.select("file_id", "position", "name", a["is_cached_replay"].alias("is_cached_replay"), replayed.alias("replayed"))


view(
    "log_entries",
    """SELECT file_id, 0 AS pos, 'INFO' AS level, 'Starting ' || filename AS message FROM outcomes
    UNION ALL SELECT file_id, n, 'INFO', 'Stage ' || n || ': ' || ['Ingest', 'Parse', 'Categorize', 'Extract', 'De-identify'][n]
        FROM outcomes, (SELECT unnest([1, 2, 3, 4, 5]) AS n) WHERE n <= stages_completed
    UNION ALL SELECT file_id, 6, CASE WHEN status = 'failed' THEN 'ERROR' ELSE 'INFO' END,
        CASE WHEN status = 'failed' THEN 'Failed: ' || error ELSE 'Completed' END FROM outcomes""",
    ("outcomes",),
)
_LINE = "'2024-03-05 06:07:08,009 - dossierflow.runs - ' || level || ' - [RUN ' || file_id || '] ' || message"


def run_logs(spark, sf):
    return logs.run_logs(wide(spark, sf), F.lit("2024-03-05 06:07:08.009").cast("timestamp"), "/Volumes/main/docs/logs")


@query("log_lines",
       f"SELECT file_id, CAST(row_number() OVER (PARTITION BY file_id ORDER BY pos) - 1 AS int) AS seq, {_LINE} AS line FROM log_entries",
       ("log_entries",))
def log_lines(spark, sf):
    return logs.log_lines(run_logs(spark, sf)).select("file_id", "seq", "line")


@query("log_file_content",
       f"""SELECT '/Volumes/main/docs/logs/2024-03-05/' || file_id || '.log' AS log_file_path,
       string_agg({_LINE}, chr(10) ORDER BY pos) || chr(10) AS content FROM log_entries GROUP BY file_id""",
       ("log_entries",))
def log_file_content(spark, sf):
    return logs.log_file_content(run_logs(spark, sf)).select("log_file_path", "content")


@query(
    "run_durations",
    """SELECT user_id, CAST(epoch_us(max(ts)) - epoch_us(min(ts)) AS double) / 1000000.0 AS seconds FROM events GROUP BY user_id""",
)
def run_durations(spark, sf):
    spans = table(spark, sf, "events").groupBy("user_id").agg(F.min("ts").alias("a"), F.max("ts").alias("b"))
    return spans.select("user_id", runs.duration_seconds(F.col("a"), F.col("b")).alias("seconds"))


_FULL = "SELECT doc_id, text, 'd' || doc_id AS file_id FROM documents WHERE length(trim(text)) > 0"


@query(
    "resume_by_fingerprint",
    f"""SELECT file_id, cached, NOT cached AND file_id = min(file_id) OVER (PARTITION BY text, cached) AS ran, primary_category,
    CAST((SELECT count(*) FROM doc_entities e WHERE e.doc_id = d.doc_id) AS int) AS entities_count
    FROM (SELECT *, text IN (SELECT text FROM ({_FULL}) WHERE doc_id % 2 = 0) AS cached FROM ({_FULL})) d JOIN all_categories USING (doc_id)""",
    ("all_categories", "doc_entities"),
)
def resume_by_fingerprint(spark, sf):
    """Half of the documents run and fill the cache, then all do under other names: no equal bytes run twice."""
    docs = table(spark, sf, "documents").filter("length(trim(text)) > 0").select(
        "doc_id", F.concat(F.lit("d"), "doc_id").alias("file_id"), F.col("text").cast("binary").alias("content"))
    half = docs.filter("doc_id % 2 = 0").select("file_id", F.concat("file_id", F.lit(".txt")).alias("filename"), "content")
    folder = work_folder(spark, "result-cache")
    cache.new_entries(cache.run_cached(half, fx.run_settings())).write.parquet(folder)
    again = docs.select("file_id", F.concat(F.lit("copy of "), "file_id", F.lit(".txt")).alias("filename"), "content")
    done = cache.run_cached(again, fx.run_settings(), spark.read.parquet(folder))
    return done.select("file_id", "cached", "ran", "primary_category", "entities_count")
