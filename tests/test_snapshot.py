import datetime as dt
import os
import random

import pytest
from pyspark.sql import functions as F

from dossierflow.plans import snapshot as sn
from dossierflow.plans import status as st
from dossierflow.sources import upsert as up
from dossierflow.schemas import RESULTS_SCHEMA, STATUS_EVENT_SCHEMA


def log(spark, rows):
    return spark.createDataFrame(rows, STATUS_EVENT_SCHEMA)


def events(n=400, seed=1):
    rng = random.Random(seed)
    out = []
    for i in range(n):
        changed = {c: rng.choice(["a", "b", None]) for c in rng.sample(["status", "error_message", "filename", "current_stage"], 2)}
        at = dt.datetime(2024, 1, 1) + dt.timedelta(seconds=rng.randint(0, 1000))
        out.append({"file_id": f"f{rng.randint(0, 30)}", "event_time": at, "seq": i, "changes": changed})
    return [[e[f.name] for f in STATUS_EVENT_SCHEMA.fields] for e in out]


@pytest.fixture
def table(spark, tmp_path):
    return sn.SnapshotTable(spark, f"snap_{os.path.basename(tmp_path).replace('-', '_')}", f"file://{tmp_path}/snap", 4)


def test_merges_in_any_order_equal_the_fold(spark, table):
    rows = events()
    assert table.status().count() == 0
    for part in (rows[200:], rows[:100], rows[100:200], rows[50:150]):
        table.merge(log(spark, part))
    assert table.version() == 4
    got = {tuple(r) for r in table.status().collect()}
    assert got == {tuple(r) for r in st.fold(log(spark, rows)).collect()}


def test_only_new_events_move(spark, table):
    table.merge(log(spark, events()))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = sn.merged(table.read(), log(spark, events(50, 2)), 4)._jdf.queryExecution().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    plan = plan[plan.index("== Physical Plan =="):]
    old, new = plan.split("FileScan parquet")[0], plan.split("FileScan parquet")[1]
    join = old.index("SortMergeJoin")
    assert "Exchange" not in old[join:], plan
    assert "Bucketed: true" in new and "Exchange" in new


def test_failed_merge_leaves_the_current_version(spark, table):
    table.merge(log(spark, events()))
    before = {tuple(r) for r in table.status().collect()}
    bad = log(spark, events(10)).withColumn("file_id", F.raise_error(F.lit("broken")).cast("string"))
    with pytest.raises(Exception):
        table.merge(bad)
    assert table.version() == 1
    assert {tuple(r) for r in table.status().collect()} == before
    assert table.merge(log(spark, events(10))) == 2


def results(spark, rows):
    day = dt.datetime(2024, 1, 1)
    full = [{"file_id": f, "parse_result": p, "created_at": day, "updated_at": day} for f, p in rows]
    return spark.createDataFrame([[r.get(f.name) for f in RESULTS_SCHEMA.fields] for r in full], RESULTS_SCHEMA)


def files_of(folder):
    return {
        os.path.join(d, n): os.stat(os.path.join(d, n)).st_mtime_ns
        for d, _, names in os.walk(folder) for n in names if n.endswith(".parquet")
    }


def test_upsert_rewrites_only_touched_buckets(spark, tmp_path):
    folder = str(tmp_path / "results")
    up.create(results(spark, [(f"f{i}", "old") for i in range(60)]), folder, buckets=8)
    before = files_of(folder)
    updates = spark.createDataFrame(
        [("f3", "parse", "new", dt.datetime(2024, 1, 2)), ("f3", "other", "x", dt.datetime(2024, 1, 3)), ("new", "extract", "e", dt.datetime(2024, 1, 2))],
        "file_id string, stage_name string, result_json string, updated_at timestamp",
    )
    for _ in range(2):  # the second time changes nothing
        touched = up.upsert(up.stage_rows(updates), folder, buckets=8)
        after = files_of(folder)
        same = {p for p in before if after.get(p) == before[p]}
        assert {p for p in before if any(f"bucket={b}/" in p for b in touched)} == set(before) - same
        assert len(same) >= len(before) - 2
        rows = {r.file_id: r for r in up.read(spark, folder).collect()}
        assert len(rows) == 61
        assert (rows["f3"].parse_result, rows["f3"].updated_at, rows["f3"].created_at) == ("new", dt.datetime(2024, 1, 2), dt.datetime(2024, 1, 1))
        assert (rows["new"].extract_result, rows["f5"].parse_result) == ("e", "old")
    assert up.upsert(up.stage_rows(updates.limit(0)), folder, buckets=8) == []


def test_lookup_reads_one_bucket(spark, tmp_path):
    folder = str(tmp_path / "results")
    up.create(results(spark, [(f"f{i}", str(i)) for i in range(60)]), folder, buckets=8)
    found = up.lookup(spark, folder, "f7", buckets=8)
    assert [r.parse_result for r in found.collect()] == ["7"]
    plan = found._jdf.queryExecution().toString()
    assert "PartitionFilters: [isnotnull(bucket" in plan
