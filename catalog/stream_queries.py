"""Streaming jobs run to the end of the given tables."""

from pyspark.sql import functions as F

from catalog import fixtures as fx
from catalog.registry import query, table
from dossierflow.plans.runs import summary
from dossierflow.settings import Settings
from dossierflow.sources.folders import work_folder
from dossierflow.streaming import arrivals, progress, stateful


def _stream(spark, sf, name):
    schema = table(spark, sf, name).schema
    # a pattern, as a stream takes a single file only by one
    return spark.readStream.schema(schema).parquet(f"{sf}/{name}.parque[t]")


@query(
    "stream_ingest",
    """SELECT file_id, status, stages_completed, primary_category, CAST(entities_count AS int) AS entities_count,
    CAST(pii_items_masked AS int) AS pii_items_masked FROM outcomes""",
    ("outcomes",),
)
def stream_ingest(spark, sf):
    """The stages over a stream of documents; the written table must equal the batch run."""
    docs = _stream(spark, sf, "documents").select(
        F.concat(F.lit("d"), F.col("doc_id")).alias("file_id"), F.expr(fx.RUN_NAME).alias("filename"),
        F.expr("CASE WHEN doc_id % 23 <> 0 THEN CAST(text AS binary) END").alias("content"))
    base = work_folder(spark, "stream-ingest")
    arrivals.process_arrivals(docs, fx.run_settings(), f"{base}/out", f"{base}/checkpoint").awaitTermination()
    done = spark.read.parquet(f"{base}/out")
    return summary(done).select("file_id", "status", "stages_completed", "primary_category", "entities_count", "pii_items_masked")


@query(
    "stream_arrivals",
    """SELECT CAST(sum(strlen(text) + 1) AS bigint) AS total_bytes, CAST(0 AS bigint) AS failed FROM documents WHERE text IS NOT NULL""",
)
def stream_arrivals(spark, sf):
    """Documents written as files, old ones last, and run as a stream of arriving files."""
    base = work_folder(spark, "stream-arrivals")
    docs = table(spark, sf, "documents").filter("text IS NOT NULL").select("text")
    docs.write.option("maxRecordsPerFile", 500).text(f"{base}/inbox")
    arriving = arrivals.arriving_files(spark, f"{base}/inbox", "*.txt", max_files=200)
    arrivals.process_arrivals(arriving, Settings(), f"{base}/out", f"{base}/checkpoint").awaitTermination()
    done = spark.read.parquet(f"{base}/out")
    return done.agg(
        F.sum("file_size_bytes").cast("long").alias("total_bytes"), F.count_if(F.col("status") == "failed").alias("failed"))


@query("stream_stage_counts", "SELECT event_type, count(*) AS n FROM events GROUP BY event_type")
def stream_stage_counts(spark, sf):
    base = work_folder(spark, "stream-counts")
    counts = progress.live_counts(_stream(spark, sf, "events"), "event_type")
    progress.start_snapshots(counts, f"{base}/out", f"{base}/checkpoint").awaitTermination()
    return progress.latest_of_updates(spark.read.parquet(f"{base}/out"), "event_type")


@query(
    "stream_progress",
    """SELECT strftime(date_trunc('day', ts), '%Y-%m-%d') AS day, event_type, count(*) AS n FROM events GROUP BY ALL""",
)
def stream_progress(spark, sf):
    base = work_folder(spark, "stream-progress")
    events = _stream(spark, sf, "events").select(F.col("ts").cast("timestamp").alias("ts"), "event_type")
    counts = progress.window_progress(events, "ts", "event_type", "1 day")
    progress.start_snapshots(counts, f"{base}/out", f"{base}/checkpoint").awaitTermination()
    latest = progress.latest_of_updates(spark.read.parquet(f"{base}/out"), "window_start", "event_type")
    return latest.select(F.date_format("window_start", "yyyy-MM-dd").alias("day"), "event_type", "n")


def _file_events(spark, sf):
    return table(spark, sf, "events").select(
        F.concat(F.lit("f"), "user_id").alias("file_id"), F.col("ts").cast("timestamp").alias("event_time"),
        F.col("event_id").alias("seq"), "event_type")


@query(
    "stuck_by_gap",
    """SELECT 'f' || user_id AS file_id, arg_max(event_type, (ts, event_id)) AS last_event,
    CAST(floor(epoch(TIMESTAMP '2024-02-01')) - floor(epoch(max(ts))) AS bigint) AS idle_seconds FROM events GROUP BY user_id
    HAVING arg_max(event_type, (ts, event_id)) NOT IN ('purchase', 'error')
    AND floor(epoch(TIMESTAMP '2024-02-01')) - floor(epoch(max(ts))) >= 86400""",
)
def stuck_by_gap(spark, sf):
    now = F.lit("2024-02-01 00:00:00").cast("timestamp")
    stuck = progress.stuck_by_gap(_file_events(spark, sf), now, 86400, ["purchase", "error"])
    return stuck.select("file_id", "last_event", "idle_seconds")


@query(
    "stuck_sessions",
    """SELECT file_id, last_event, strftime(started, '%Y-%m-%d %H:%M:%S') AS started FROM (
    SELECT 'f' || user_id AS file_id, session, min(ts) AS started, arg_max(event_type, (ts, event_id)) AS last_event FROM (
      SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS session FROM (
        SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) < INTERVAL 6 HOUR THEN 0 ELSE 1 END AS fresh
        FROM events)) GROUP BY user_id, session) WHERE last_event NOT IN ('purchase', 'error')""",
)
def stuck_sessions(spark, sf):
    stuck = progress.stuck_sessions(_file_events(spark, sf), "6 hours", ["purchase", "error"])
    return stuck.select("file_id", "last_event", F.date_format("started", "yyyy-MM-dd HH:mm:ss").alias("started"))


def _halves(spark, rows, by):
    """A folder to stream from, and what adds the next of two halves of the rows to it."""
    base = work_folder(spark, "halves")

    def add(half):
        rows.filter(F.pmod(by, F.lit(2)) == half).write.parquet(f"{base}/in/half={half}")

    return base, add


@query(
    "stream_stuck_timers",
    """WITH e AS (SELECT 'f' || user_id AS file_id, ts, event_id, event_type FROM events),
    firsts AS (SELECT file_id, max(ts) AS newest FROM e WHERE event_id % 2 = 0 GROUP BY file_id)
    SELECT file_id, arg_max(event_type, (ts, event_id)) AS last_event, strftime(max(ts), '%Y-%m-%d %H:%M:%S') AS idle_since,
    count(*) AS n_events, count(*) FILTER (WHERE event_id % 2 <> 0 AND ts < newest) AS n_late
    FROM e LEFT JOIN firsts USING (file_id) GROUP BY file_id HAVING last_event NOT IN ('purchase', 'error')""",
)
def stream_stuck_timers(spark, sf):
    """Events in two runs, the second with late ones; then nothing but time passes, and timers fire."""
    own = stateful.session_for_state(spark)
    events = _file_events(spark, sf)
    base, add = _halves(spark, events, F.col("seq"))

    def run():
        stream = own.readStream.schema(events.schema).parquet(f"{base}/in/*").withWatermark("event_time", "60 days")
        stuck = stateful.stuck_by_timers(stream, 6 * 3600, ["purchase", "error"], by_event_time=True)
        stateful.start(stuck, f"{base}/out", f"{base}/checkpoint").awaitTermination()

    add(0)
    run()
    add(1)
    run()
    tick = spark.range(1).select(
        F.lit(None).cast("string").alias("file_id"), F.lit("2024-12-31").cast("timestamp").alias("event_time"),
        F.lit(0).cast("long").alias("seq"), F.lit(None).cast("string").alias("event_type"))
    tick.write.parquet(f"{base}/in/half=2")
    run()
    reports = stateful.latest_report(spark.read.parquet(f"{base}/out"))
    return reports.withColumn("idle_since", F.date_format("idle_since", "yyyy-MM-dd HH:mm:ss"))


@query(
    "stream_overwrites",
    """SELECT path, version, length, CASE WHEN version > first_run THEN first_run END AS replaces FROM (
    SELECT volume_path AS path, max(doc_id) AS version, arg_max(strlen(coalesce(text, '')), doc_id) AS length,
    max(doc_id) FILTER (WHERE doc_id % 2 = 0) AS first_run FROM uploads GROUP BY volume_path)""",
    ("uploads",),
)
def stream_overwrites(spark, sf):
    """Uploads of colliding paths in two runs; older versions that arrive late change nothing."""
    own = stateful.session_for_state(spark)
    seconds = lambda c: F.unix_seconds(c)
    files = fx.uploads(spark, sf).select(
        F.col("volume_path").alias("path"), F.timestamp_seconds("doc_id").alias("modificationTime"),
        F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("length"), "doc_id")
    base, add = _halves(spark, files, F.col("doc_id"))
    for half in (0, 1):
        add(half)
        stream = own.readStream.schema(files.schema).parquet(f"{base}/in/*")
        stateful.start(stateful.newest_versions(stream), f"{base}/out", f"{base}/checkpoint").awaitTermination()
    current = stateful.current_versions(spark.read.parquet(f"{base}/out"))
    return current.select(
        "path", seconds("modificationTime").alias("version"), "length", seconds("replaces").alias("replaces"))


@query(
    "stream_late",
    """SELECT strftime(d, '%Y-%m-%d') AS day, event_type, count(*) FILTER (WHERE NOT closed) AS counted,
    count(*) FILTER (WHERE closed) AS late, count(*) AS n FROM (
    SELECT date_trunc('day', ts) AS d, event_type, event_id % 2 <> 0 AND date_trunc('day', ts) + INTERVAL 1 DAY <=
    (SELECT max(ts) - INTERVAL 10 DAY FROM events WHERE event_id % 2 = 0) AS closed FROM events) GROUP BY ALL""",
)
def stream_late(spark, sf):
    """Events in two runs: those of the second whose day has closed are kept apart."""
    events = table(spark, sf, "events").select(F.col("ts").cast("timestamp").alias("ts"), "event_type", "event_id")
    base, add = _halves(spark, events, F.col("event_id"))
    for half in (0, 1):
        add(half)
        stream = spark.readStream.schema(events.schema).parquet(f"{base}/in/*")
        stateful.split_late(stream, "ts", "1 day", "10 days", f"{base}/out", f"{base}/checkpoint").awaitTermination()
    rows = spark.read.parquet(f"{base}/out/rows")
    return stateful.split_counts(rows.withColumn("day", F.date_format("window_start", "yyyy-MM-dd")), "day", "event_type")


@query("stream_replayed_batch", "SELECT event_type, count(*) AS n, CAST(sum(event_id) AS bigint) AS ids FROM events GROUP BY event_type")
def stream_replayed_batch(spark, sf):
    """The same batch written twice, as after a failure before its end was recorded: it counts once."""
    base = work_folder(spark, "stream-replay")
    for attempt in (1, 2):
        events = _stream(spark, sf, "events").select("event_id", "event_type")
        arrivals.write_once(events, f"{base}/out", f"{base}/checkpoint-{attempt}").awaitTermination()
    return spark.read.parquet(f"{base}/out").groupBy("event_type").agg(F.count("*").alias("n"), F.sum("event_id").alias("ids"))
