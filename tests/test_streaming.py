import os

from pyspark.sql import functions as F

from dossierflow.plans.runs import run_stages
from dossierflow.settings import Settings
from dossierflow.sources.files import read_files, supported_only
from dossierflow.sources.folders import work_folder
from dossierflow.streaming import arrivals, progress
from samples import SAMPLES


def put(folder, name, text):
    folder.mkdir(exist_ok=True)
    (folder / name).write_bytes(text.encode())


def test_scan_of_files(spark, tmp_path):
    inbox = tmp_path / "in"
    for name, text, *_ in SAMPLES:
        put(inbox, name, text)
    put(inbox, "a b+c é.md", "# x")
    put(inbox, "big.exe", "x" * 10)
    files = read_files(spark, str(inbox))
    assert "a b+c é.md" in {r.filename for r in files.select("filename").collect()}
    assert {r.filename for r in supported_only(files, 10_000).select("filename").collect()} == {s[0] for s in SAMPLES} | {"a b+c é.md"}
    assert {r.filename for r in supported_only(files, 5).select("filename").collect()} == {"a b+c é.md"}
    assert read_files(spark, str(inbox), "*.txt").count() == len(SAMPLES)
    got = {r.filename: r.status for r in run_stages(files, Settings()).collect()}
    assert got["bank.txt"] == "completed"


def test_arrivals_equal_the_batch_run(spark, tmp_path):
    inbox = tmp_path / "in"
    for name, text, *_ in SAMPLES[:3]:
        put(inbox, name, text)
    out, check = str(tmp_path / "out"), str(tmp_path / "check")

    def run():
        arrivals.process_arrivals(arrivals.arriving_files(spark, str(inbox)), Settings(), out, check).awaitTermination()

    run()
    assert spark.read.parquet(out).count() == 3
    for name, text, *_ in SAMPLES[3:]:
        put(inbox, name, text)
    run()
    keep = ["filename", "status", "primary_category", "entities_count", "pii_items_masked", "extraction"]
    streamed = {r.filename: r for r in spark.read.parquet(out).select(*keep).collect()}
    batch = {r.filename: r for r in run_stages(read_files(spark, str(inbox)), Settings()).select(*keep).collect()}
    assert streamed == batch and len(streamed) == len(SAMPLES)


def test_late_and_old_files_are_not_lost(spark, tmp_path):
    import os
    import time

    inbox = tmp_path / "late"
    inbox.mkdir()
    now = time.time()
    for name, age in (("a.txt", 0), ("b.txt", 3 * 3600), ("c.txt", 30 * 86400)):
        (inbox / name).write_text("text of " + name)
        os.utime(inbox / name, (now - age, now - age))
        arrivals.process_arrivals(
            arrivals.arriving_files(spark, str(inbox)), Settings(), str(tmp_path / "out"), str(tmp_path / "check")
        ).awaitTermination()
    done = spark.read.parquet(str(tmp_path / "out"))
    assert {r.filename for r in done.collect()} == {"a.txt", "b.txt", "c.txt"}


def test_replayed_batch_replaces_itself(spark, tmp_path):
    inbox = tmp_path / "in"
    put(inbox, *SAMPLES[0][:2])
    out = str(tmp_path / "out")
    for attempt in ("c1", "c2"):
        # a lost checkpoint replays batch 0
        arrivals.process_arrivals(arrivals.arriving_files(spark, str(inbox)), Settings(), out, str(tmp_path / attempt)).awaitTermination()
    assert spark.read.parquet(out).count() == 1


def event_stream(spark, tmp_path, batches):
    folder = tmp_path / "ev"
    for i, rows in enumerate(batches):
        df = spark.createDataFrame(rows, "file_id string, t string, seq long, event_type string")
        df.coalesce(1).write.mode("append").json(str(folder / "all"))
        os.sync()
    reader = spark.readStream.schema("file_id string, t string, seq long, event_type string").option("maxFilesPerTrigger", 1)
    return reader.json(str(folder / "all")).withColumn("event_time", F.to_timestamp("t"))


def test_live_counts_and_windows(spark, tmp_path):
    rows = [("a", "2024-01-01 00:10:00", 1, "x"), ("b", "2024-01-01 00:20:00", 2, "y"), ("a", "2024-01-01 01:10:00", 3, "x")]
    more = [("a", "2024-01-01 00:40:00", 4, "x"), ("c", "2024-01-01 02:10:00", 5, "y")]
    stream = event_stream(spark, tmp_path, [rows, more])
    progress.start_snapshots(progress.live_counts(stream, "event_type"), str(tmp_path / "o1"), str(tmp_path / "c1")).awaitTermination()
    got = progress.latest_of_updates(spark.read.parquet(str(tmp_path / "o1")), "event_type").collect()
    assert {r.event_type: r.n for r in got} == {"x": 3, "y": 2}
    windows = progress.window_progress(stream, "event_time", "event_type", "1 hour", "1 day")
    progress.start_snapshots(windows, str(tmp_path / "o2"), str(tmp_path / "c2")).awaitTermination()
    got = progress.latest_of_updates(spark.read.parquet(str(tmp_path / "o2")), "window_start", "event_type").collect()
    assert sorted((str(r.window_start)[11:13], r.event_type, r.n) for r in got) == [("00", "x", 2), ("00", "y", 1), ("01", "x", 1), ("02", "y", 1)]


def test_stuck_sessions_as_a_stream(spark, tmp_path):
    rows = [("a", "2024-01-01 00:00:00", 1, "start"), ("a", "2024-01-01 00:05:00", 2, "work"), ("b", "2024-01-01 00:00:00", 3, "start"),
            ("b", "2024-01-01 00:05:00", 4, "done")]
    late = [("c", "2024-01-01 09:00:00", 5, "start")]
    flush = [("d", "2024-01-01 20:00:00", 6, "start")]
    stream = event_stream(spark, tmp_path, [rows, late, flush])
    stuck = progress.stuck_sessions(stream, "1 hour", ["done"], "1 minute")
    progress.start_snapshots(stuck, str(tmp_path / "o"), str(tmp_path / "c"), mode="append").awaitTermination()
    got = {r.file_id: r.last_event for r in spark.read.parquet(str(tmp_path / "o")).collect()}
    assert got.get("a") == "work" and "b" not in got and "d" not in got


def test_work_folder_follows_the_session(spark):
    base = spark.conf.get("spark.checkpoint.dir", None)
    first, second = work_folder(spark, "x"), work_folder(spark, "x")
    assert first != second and (not base or first.startswith(base.rstrip("/")))
