import datetime as dt
import os
import shutil
import time

import pytest
from pyspark.sql import functions as F

from dossierflow.streaming import stateful as sf

EVENTS = "file_id string, event_time timestamp, seq bigint, event_type string"


def at(minutes):
    return dt.datetime(2024, 1, 1) + dt.timedelta(minutes=minutes)


class Feed:
    """A folder that a stream reads, to which tables are added."""

    def __init__(self, spark, folder, schema):
        self.spark, self.folder, self.schema, self.n = sf.session_for_state(spark), str(folder), schema, 0
        os.makedirs(f"{folder}/in")
        self.add([])

    def add(self, rows):
        self.n += 1
        self.spark.createDataFrame(rows, self.schema).coalesce(1).write.parquet(f"{self.folder}/in/part={self.n}")

    def stream(self):
        return self.spark.readStream.schema(self.schema).parquet(f"{self.folder}/in/*")

    def paths(self):
        return f"{self.folder}/out", f"{self.folder}/checkpoint"

    def out(self):
        return self.spark.read.parquet(f"{self.folder}/out")


@pytest.fixture
def feed(spark, tmp_path):
    return lambda schema: Feed(spark, tmp_path, schema)


def test_a_stream_that_falls_silent_reports_its_files(feed):
    f = feed(EVENTS)
    f.add([("a", at(0), 1, "start"), ("a", at(1), 2, "parse"), ("b", at(0), 3, "start"), ("b", at(2), 4, "done")])
    query = sf.start(sf.stuck_by_timers(f.stream(), 2, ["done"]), *f.paths(), every="1 second")
    try:
        until = time.time() + 90
        found = []
        while not found and time.time() < until:
            time.sleep(2)
            if query.exception():
                raise query.exception()
            rows = f.spark.read.schema(f"{sf.STUCK}, batch_id int").option("ignoreMissingFiles", True)
            if os.path.isdir(f.paths()[0]):
                found = rows.parquet(f.paths()[0]).collect()
    finally:
        query.stop()
    assert [(r.file_id, r.last_event, r.n_events, r.stuck) for r in found] == [("a", "parse", 2, True)]


def test_timers_by_event_time_late_events_and_recovery(feed):
    f = feed(EVENTS)
    run = lambda: sf.start(
        sf.stuck_by_timers(f.stream().withWatermark("event_time", "0 seconds"), 600, ["done"], by_event_time=True), *f.paths()
    ).awaitTermination()
    f.add([("a", at(0), 1, "start"), ("b", at(0), 2, "start"), ("b", at(1), 3, "done")])
    run()
    f.add([(None, at(60), 0, None)])  # a tick
    run()
    assert {(r.file_id, r.stuck) for r in f.out().collect()} == {("a", True)}
    f.add([("a", at(61), 5, "done")])
    run()
    assert sf.latest_report(f.out()).count() == 0
    assert sorted((r.file_id, r.stuck) for r in f.out().collect()) == [("a", False), ("a", True)]


def test_late_events_are_counted(feed):
    f = feed(EVENTS)
    run = lambda: sf.start(
        sf.stuck_by_timers(f.stream().withWatermark("event_time", "1 day"), 60, ["done"], by_event_time=True), *f.paths()
    ).awaitTermination()
    f.add([("a", at(10), 1, "start")])
    run()
    f.add([("a", at(5), 2, "parse"), ("a", at(1), 3, "done"), ("a", at(20), 4, "parse")])
    run()
    f.add([(None, at(60 * 25), 0, None)])
    run()
    assert [tuple(r) for r in sf.latest_report(f.out()).collect()] == [("a", "parse", at(20), 4, 2)]


FILES = "path string, modificationTime timestamp, length bigint, content binary"


def test_newest_versions_and_replay(feed):
    f = feed(FILES)
    run = lambda: sf.start(sf.newest_versions(f.stream()), *f.paths()).awaitTermination()
    f.add([("p", at(1), 1, b"1"), ("p", at(3), 3, b"333"), ("q", at(2), 2, b"22")])
    run()
    f.add([("p", at(2), 9, b"old"), ("q", at(5), 5, b"new"), ("r", at(0), 0, b"")])
    run()
    want = {("p", at(3), 3, None), ("q", at(5), 5, at(2)), ("r", at(0), 0, None)}
    assert {tuple(r) for r in sf.current_versions(f.out()).collect()} == want
    everything = f.spark.read.schema(FILES).parquet(f"{f.folder}/in/*")
    kept = sf.contents_of(everything, sf.current_versions(f.out())).collect()
    assert {(r.path, bytes(r.content)) for r in kept} == {("p", b"333"), ("q", b"new"), ("r", b"")}
    # a batch whose end was not recorded runs again and gives the same
    before = sorted(tuple(r) for r in f.out().drop("batch_id").collect())
    commits = f"{f.folder}/checkpoint/commits"
    last = max((n for n in os.listdir(commits) if n.isdigit()), key=int)
    shutil.move(f"{commits}/{last}", f"{f.folder}/{last}.away")
    os.path.exists(f"{commits}/.{last}.crc") and shutil.move(f"{commits}/.{last}.crc", f"{f.folder}/{last}.crc.away")
    run()
    assert sorted(tuple(r) for r in f.out().drop("batch_id").collect()) == before


def test_late_rows_are_kept_apart(feed):
    schema = "ts timestamp, kind_of string"
    f = feed(schema)
    run = lambda: sf.split_late(f.stream(), "ts", "10 minutes", "5 minutes", *f.paths()).awaitTermination()
    f.add([(at(0), "x"), (at(31), "x")])
    run()
    # windows that end by minute 26 are closed
    f.add([(at(5), "y"), (at(15), "y"), (at(25), "x"), (at(90), "x"), (None, "z")])
    run()
    rows = f.spark.read.parquet(f"{f.paths()[0]}/rows")
    got = {r.kind_of: (r.counted, r.late, r.n) for r in sf.split_counts(rows, "kind_of").collect()}
    assert got == {"x": (4, 0, 4), "y": (0, 2, 2), "z": (0, 1, 1)}
    assert rows.count() == 7
