import random

from pyspark.sql import functions as F

from dossierflow.plans import results, status as st, views
from dossierflow.schemas import RESULTS_SCHEMA, STATUS_EVENT_SCHEMA, STATUS_SCHEMA
from dossierflow.sources import logs, tables

COLUMNS = [f.name for f in STATUS_SCHEMA.fields]


def brute_fold(events):
    """Updates applied one by one in (time, seq) order."""
    files = {}
    for file_id, time, seq, changes in sorted(events, key=lambda e: (e[0], e[1], e[2])):
        if not changes:
            continue
        row = files.setdefault(file_id, {c: None for c in COLUMNS} | {"file_id": file_id})
        row.update({k: v for k, v in changes.items() if k in COLUMNS})
        row["updated_at"] = time
    return files


def random_events(n=400, seed=3):
    from datetime import datetime, timedelta

    rng = random.Random(seed)
    names = ["status", "current_stage", "error_message", "stage_parse_status", "primary_category", "entities_count", "no_such_column"]
    events = []
    for i in range(n):
        # a third of all updates belong to one file
        file_id = "hot" if rng.random() < 0.34 else f"f{rng.randint(0, 20)}"
        changes = {k: rng.choice([None, "1", "2", "x"]) for k in rng.sample(names, rng.randint(0, 3))}
        events.append((file_id, datetime(2024, 1, 1) + timedelta(minutes=rng.randint(0, 50)), i, changes))
    return events


def as_dicts(df):
    return {r.file_id: {**r.asDict(), "entities_count": r.entities_count} for r in df.collect()}


def test_fold_against_brute_force_in_any_order(spark):
    events = random_events()
    want = brute_fold(events)
    for row in want.values():
        row["entities_count"] = int(row["entities_count"]) if (row["entities_count"] or "").isdigit() else None
    for seed in (1, 2):
        shuffled = events[:]
        random.Random(seed).shuffle(shuffled)
        df = spark.createDataFrame(shuffled, STATUS_EVENT_SCHEMA).repartition(5)
        assert as_dicts(st.fold(df)) == want


def test_partial_updates(spark):
    row = spark.sql("SELECT '' AS e, CAST(NULL AS string) AS n, 'x' AS x")
    build = st.changes({"status": F.col("e"), "trace_id": F.col("n"), "error_message": F.col("x"), "log_file_path": F.col("n"), "stage_parse_status": F.col("n")})
    assert row.select(build).first()[0] == {"error_message": "x", "log_file_path": None, "stage_parse_status": None}
    done = st.completed(F.col("e"), F.lit(0), F.col("n"), F.lit("2024-01-01"))
    got = row.select(done).first()[0]
    assert got["entities_count"] == "0" and "primary_category" not in got and "pii_items_masked" not in got
    assert all(got[f"stage_{s}_status"] == "completed" for s in ("ingest", "parse", "categorize", "extract", "deidentify"))
    failed = row.select(st.failed(F.col("x"), F.lit("parse"), F.lit("t")).alias("a"), st.failed(F.col("x"), F.col("n"), F.lit("t")).alias("b")).first()
    assert failed.a == {"status": "failed", "error_message": "x", "end_time": "t", "current_stage": "parse", "stage_parse_status": "failed"}
    assert failed.b == {"status": "failed", "error_message": "x", "end_time": "t"}


def test_new_ids_are_repeatable(spark):
    files = spark.createDataFrame([("a", 1), ("a", 2), ("b", None)], "filename string, size int")
    first = [r.file_id for r in st.new_file_ids(files, "filename", "size").collect()]
    assert len(set(first)) == 3 and first == [r.file_id for r in st.new_file_ids(files, "filename", "size").collect()]
    log = st.initial_events(st.new_file_ids(files, "filename", "size"), F.lit("2024-01-01").cast("timestamp"))
    rows = st.fold(log).collect()
    assert {(r.status, r.current_stage, r.filename) for r in rows} == {("processing", "ingest", "a"), ("processing", "ingest", "b")}
    assert all(r.created_at == r.start_time == r.updated_at for r in rows)


def some_status(spark):
    rows = [("a", "processing", "parse", "2024-01-03"), ("b", "completed", "deidentify", "2024-01-03"), ("c", "processing", None, None),
            ("d", "processing", "odd", "2024-01-01"), ("e", "failed", "Parse", "2024-01-02")]
    df = spark.createDataFrame(rows, "file_id string, status string, current_stage string, created string")
    cols = [F.lit(None).cast(f.dataType).alias(f.name) if f.name not in ("file_id", "status", "current_stage", "created_at")
            else F.col("created").cast("timestamp").alias("created_at") if f.name == "created_at" else F.col(f.name) for f in STATUS_SCHEMA.fields]
    return df.select(*cols)


def test_newest_first_with_missing_times_ahead(spark):
    assert [r.file_id for r in st.newest(some_status(spark)).collect()] == ["c", "a", "b", "e", "d"]
    assert [r.file_id for r in st.processing_status(some_status(spark), limit=2).collect()] == ["c", "a"]
    assert [r.status for r in st.processing_status(some_status(spark), "e").collect()] == ["failed"]
    assert st.processing_status(some_status(spark), "zz").count() == 0


def test_reset_looks_at_the_newest_only(spark):
    now = F.lit("2024-02-01").cast("timestamp")
    got = {r.file_id: r for r in st.reset_stuck(some_status(spark), now, limit=4).collect()}
    assert set(got) == {"a", "c"}
    assert got["a"].error_message == "The run was cut off by a restart during stage parse" and got["a"].stage_parse_status == "failed"
    assert {r.file_id for r in st.reset_stuck(some_status(spark), now, limit=None).collect()} == {"a", "c", "d"}
    events = {r.file_id: r.changes for r in st.reset_stuck_events(some_status(spark), now, limit=None).collect()}
    assert events["a"]["stage_parse_status"] == "failed" and "current_stage" not in events["c"]


def test_delete_leaves_results(spark):
    ids = spark.createDataFrame([("a",), ("zz",)], "file_id string")
    assert {r.file_id for r in st.delete_records(some_status(spark), ids).collect()} == {"b", "c", "d", "e"}
    assert {r.file_id: (r.deleted, r.error) for r in st.deletion_report(some_status(spark), ids).collect()} == {
        "a": (True, None), "zz": (False, "no record of this file")}
    found = spark.createDataFrame([("a", "r"), ("q", "r")], "file_id string, parse_result string")
    left = st.delete_records(some_status(spark), ids)
    assert {r.file_id for r in results.orphans(found, left).collect()} == {"a", "q"}
    assert {r.file_id: r.lookup_error for r in results.for_files(ids, found).collect()} == {"a": None, "zz": "no result is stored for this file"}


def test_stage_counts(spark):
    got = [(r.stage, r.n) for r in st.stage_counts(some_status(spark)).orderBy("position").collect()]
    assert got == [("ingest", 0), ("parse", 1), ("categorize", 0), ("extract", 0), ("deidentify", 0), ("total", 3)]
    empty = some_status(spark).filter("false")
    assert [r.n for r in st.stage_counts(empty).collect()] == [0] * 6


def test_results_from_updates_skip_unknown_stages(spark):
    rows = [("a", "parse", "1", 1), ("a", "parse", "2", 2), ("a", "ingest", "x", 3), ("a", "extract", "e", 1), ("b", "other", "x", 1)]
    df = spark.createDataFrame(rows, "file_id string, stage_name string, result_json string, updated_at int")
    got = results.from_stage_updates(df).collect()
    assert [(r.file_id, r.parse_result, r.categorize_result, r.extract_result) for r in got] == [("a", "2", None, "e")]


def test_tables(spark, tmp_path):
    events = spark.createDataFrame(random_events(50), STATUS_EVENT_SCHEMA)
    name = "dossier_test_status_events"
    spark.sql(f"DROP TABLE IF EXISTS {name}")
    for _ in range(2):
        tables.ensure_table(spark, name, "status_events", str(tmp_path / "ev"))
    tables.append(events, name, "status_events")
    assert as_dicts(tables.current_status(spark, name)) == as_dicts(st.fold(events))
    tables.ensure_table(spark, "dossier_test_results", "results", str(tmp_path / "res"))
    assert [f.name for f in spark.table("dossier_test_results").schema] == [f.name for f in RESULTS_SCHEMA.fields]
    spark.sql(f"DROP TABLE {name}")
    spark.sql("DROP TABLE dossier_test_results")


def test_landings_and_reruns_keep_earlier_data(spark, tmp_path):
    from dossierflow.sources import files

    folder = str(tmp_path / "landed")
    for rows in ([("/p/a", 1, b"one"), ("/p/b", 2, b"two")], [("/p/a", 3, b"new")]):
        files.land(spark.createDataFrame(rows, "volume_path string, seq long, content binary"), folder)
    got = {r.volume_path: bytes(r.content) for r in files.landed(spark, folder, "seq").collect()}
    assert got == {"/p/a": b"new", "/p/b": b"two"}


def test_size_filter_reaches_the_scan(spark, tmp_path):
    from dossierflow.sources import files

    (tmp_path / "a.txt").write_text("x" * 50)
    (tmp_path / "b.txt").write_text("x")
    (tmp_path / "c.exe").write_text("x")
    found = files.read_files(spark, str(tmp_path))
    plan = files.supported_only(found, 10)._jdf.queryExecution().executedPlan().toString()
    assert "LessThanOrEqual(length,10)" in plan
    assert [r.filename for r in files.supported_only(found, 10).collect()] == ["b.txt"]
    assert {r.filename: r.error for r in files.refused(found, 10).collect()} == {
        "a.txt": "file is too large", "c.exe": "file type is not supported"}


def test_the_sweep_reads_the_whole_table(spark):
    now = F.lit("2024-02-01 00:00:00").cast("timestamp")
    log = spark.range(1500).select(
        F.concat(F.lit("f"), "id").alias("file_id"), now.alias("event_time"), F.lit(0).cast("long").alias("seq"),
        st.changes({"status": F.lit("processing"), "current_stage": F.lit("parse")}).alias("changes"))
    assert st.reset_stuck(st.fold(log), now).count() == 1500 == st.reset_stuck_events(st.fold(log), now).count()


def test_rerun_keeps_creation_time_and_writes_ids(spark):
    old, new = (F.lit(f"2024-01-0{d} 00:00:00").cast("timestamp") for d in (1, 2))
    wide = spark.createDataFrame(
        [("a", "a.txt", "/Volumes/c/s/v/a.txt", "completed", None, None, "C", 1, 2, "x", "x", "x", "x", "t1", "/logs/a.log")],
        "file_id string, filename string, volume_path string, status string, error string, failed_stage string, primary_category string, "
        "entities_count int, pii_items_masked int, parse string, categorization string, extraction string, cached_parse string, "
        "trace_id string, log_file_path string")
    first = st.events_of_runs(wide.drop("cached_parse"), old)
    failed = spark.range(1).select(F.lit("a").alias("file_id"), old.alias("event_time"), F.lit(99).cast("long").alias("seq"),
                                   st.failed(F.lit("boom"), F.lit("extract"), old).alias("changes"))
    row = st.fold(first.unionByName(failed).unionByName(st.events_of_runs(wide, new))).first()
    assert str(row.created_at) == str(row.start_time) == "2024-01-01 00:00:00" and str(row.end_time) == "2024-01-02 00:00:00"
    assert (row.status, row.error_message, row.trace_id, row.log_file_path) == ("completed", None, "t1", "/logs/a.log")


def test_log_lines_and_files(spark, tmp_path):
    wide = spark.createDataFrame([("r1", "a.txt", 2, "failed", "Parse failed: x"), ("r2", "b.txt", 5, "completed", None)],
                                 "file_id string, filename string, stages_completed int, status string, error string")
    made = logs.run_logs(wide, F.lit("2024-03-05 06:07:08.009").cast("timestamp"), "/Volumes/c/s/v/logs")
    content = {r.log_file_path: r.content for r in logs.log_file_content(made).collect()}
    assert content["/Volumes/c/s/v/logs/2024-03-05/r1.log"].splitlines() == [
        "2024-03-05 06:07:08,009 - dossierflow.runs - INFO - [RUN r1] Starting a.txt",
        "2024-03-05 06:07:08,009 - dossierflow.runs - INFO - [RUN r1] Stage 1: Ingest",
        "2024-03-05 06:07:08,009 - dossierflow.runs - INFO - [RUN r1] Stage 2: Parse",
        "2024-03-05 06:07:08,009 - dossierflow.runs - ERROR - [RUN r1] Failed: Parse failed: x"]
    for _ in range(2):
        logs.write_logs(made, str(tmp_path / "logs"), "morning")
    assert spark.read.parquet(str(tmp_path / "logs")).count() == 4 + 7
    logs.write_logs(made, str(tmp_path / "logs"), "evening")
    assert spark.read.parquet(str(tmp_path / "logs")).count() == 2 * (4 + 7)


def test_read_deidentify_counts(spark):
    rows = [("a", '{"deidentification": {"pii_items": [{"type": "t"}]}, "pii_items_masked": 4}'), ("b", '{"deidentification": {"pii_items": [{"type": "t"}]}}'),
            ("c", '{"other": 1}'), ("d", None), ("e", "[1]")]
    got = {r.file_id: (r.read_as, r.pii_shown) for r in views.read_deidentify(spark.createDataFrame(rows, "file_id string, deidentify_result string")).collect()}
    assert got == {"a": ("json", 4), "b": ("json", 1), "c": ("json", 0), "d": ("unreadable", 0), "e": ("json", 0)}
