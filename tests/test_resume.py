import pytest
from pyspark.sql import functions as F

from dossierflow.plans import resume, results, runs, spans, status as st
from dossierflow.settings import Settings
from samples import SAMPLES

SETTINGS = Settings(catalog="c", schema="s", volume="v")
NOW = "2024-01-01 00:00:00"


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(f"f{i}", name, bytearray(text.encode())) for i, (name, text, *_) in enumerate(SAMPLES)]
    return spark.createDataFrame(rows, "file_id string, filename string, content binary")


def landed(docs):
    return docs.select(F.concat(F.lit("/Volumes/c/s/v/"), "filename").alias("volume_path"), "content")


@pytest.fixture(scope="module")
def state_after(docs, tmp_path_factory):
    """Status, results and update log of runs that failed at a stage, written once."""
    made = {}

    def state(stage):
        if stage not in made:
            spark, folder = docs.sparkSession, tmp_path_factory.mktemp("state")
            wide = runs.run_stages(docs, Settings(catalog="c", schema="s", volume="v", force_fail_stage=stage))
            now = F.lit(NOW).cast("timestamp")
            log = st.events_of_runs(wide, now)
            for name, df in (("log", log), ("results", results.from_wide(wide, now))):
                df.write.parquet(str(folder / name))
            log, stored = (spark.read.parquet(str(folder / n)) for n in ("log", "results"))
            made[stage] = (st.fold(log), stored, log)
        return made[stage]

    return state


SAME = ["file_id", "status", "error", "parse", "categorization", "extraction", "deidentification", "masked_entities",
        "primary_category", "entities_count", "pii_items_masked"]


@pytest.fixture(scope="module")
def uninterrupted(docs):
    return {r.file_id: r for r in runs.run_stages(docs, SETTINGS).select(*SAME).collect()}


@pytest.mark.parametrize("stage,index", [("parse", 0), ("categorize", 1), ("extract", 2), ("deidentify", 3)])
def test_resumed_run_equals_uninterrupted_run(state_after, uninterrupted, docs, tmp_path, stage, index):
    status, stored, _ = state_after(stage)
    requests = status.select("file_id", F.lit("").alias("volume_path"), "filename", F.col("current_stage").alias("failed_stage"),
                             F.concat(F.lit("t-"), "file_id").alias("trace_id"))
    resume.run(resume.plan(requests, status, stored), landed(docs), SETTINGS).write.parquet(str(tmp_path / "again"))
    again = docs.sparkSession.read.parquet(str(tmp_path / "again"))
    assert {r.file_id: r for r in again.select(*SAME).collect()} == uninterrupted
    assert {(r.start_index, r.stages_completed) for r in again.select("start_index", "stages_completed").collect()} == {(index, 4)}
    rows = spans.spans(again, SETTINGS).filter("file_id = 'f0'").orderBy("position").collect()
    assert [r.position for r in rows] == [0, 2, 3, 4, 5]
    assert [r.position - 2 for r in rows[1:] if "is_cached_replay" in r.attributes] == list(range(index))


def test_broken_cache_starts_at_first_missing_stage(state_after, uninterrupted, docs):
    status, stored, _ = state_after("deidentify")
    broken = stored.withColumn("categorize_result", F.when(F.col("file_id") == "f1", F.lit("{oops")).otherwise(F.col("categorize_result")))
    broken = broken.withColumn("extract_result", F.when(F.col("file_id") == "f2", F.lit(None).cast("string")).otherwise(F.col("extract_result")))
    broken = broken.filter("file_id <> 'f3'")
    requests = status.select("file_id", "volume_path", "filename", F.lit("deidentify").alias("failed_stage"), F.lit("n").alias("trace_id"))
    planned = resume.plan(requests, status, broken)
    assert {r.file_id: (r.requested_index, r.start_index) for r in planned.collect()} == {
        "f0": (3, 3), "f1": (3, 1), "f2": (3, 2), "f3": (3, 0), "f4": (3, 3)}
    again = resume.run(planned, landed(docs), SETTINGS)
    assert {r.file_id: r for r in again.select(*SAME).collect()} == uninterrupted


def test_requests_without_path_fail_with_a_message(state_after, docs):
    status, stored, _ = state_after("parse")
    status = status.withColumn("volume_path", F.when(F.col("file_id") != "f0", F.col("volume_path")))
    requests = status.select("file_id", F.lit(None).cast("string").alias("volume_path"), "filename", F.lit("parse").alias("failed_stage"), F.lit("n").alias("trace_id"))
    again = {r.file_id: r for r in resume.run(resume.plan(requests, status, stored), landed(docs), SETTINGS).collect()}
    assert (again["f0"].status, again["f0"].error, again["f0"].stages_completed) == ("failed", resume.NO_PATH, 0)
    assert {r.status for k, r in again.items() if k != "f0"} == {"completed"}


def test_start_index_of_stage_names(spark):
    rows = [(None, 0), ("", 0), ("ingest", 0), ("parse", 0), ("Categorize", 1), ("EXTRACT", 2), ("deidentify", 3), ("odd", 0)]
    df = spark.createDataFrame(rows, "s string, want int")
    assert df.filter(resume.requested_index(F.col("s")) != F.col("want")).count() == 0


def test_trace_history(spark):
    rows = [(True, "a", "n", "a,n"), (True, "", "n", "n"), (True, None, "n", "n"), (False, "a", "n", "n"), (True, "a,b", "n", "a,b,n")]
    df = spark.createDataFrame(rows, "r boolean, old string, new string, want string")
    assert df.filter(resume.trace_history(F.col("r"), F.col("old"), F.col("new")) != F.col("want")).count() == 0


def test_opening_a_rerun_resets_stages_error_and_end(state_after):
    status, stored, log = state_after("extract")
    requests = status.select("file_id", "volume_path", "filename", F.col("current_stage").alias("failed_stage"), F.lit("n").alias("trace_id"))
    opened = resume.reset_changes(resume.plan(requests, status, stored), F.lit("2024-01-02").cast("timestamp"))
    row = st.fold(log.unionByName(opened)).filter("file_id = 'f0'").first()
    assert (row.status, row.current_stage, row.error_message, row.end_time) == ("processing", "extract", None, None)
    assert (row.stage_ingest_status, row.stage_parse_status, row.stage_categorize_status, row.stage_extract_status) == ("completed", "completed", "completed", None)


def test_resume_joins_each_table_once(spark, sf):
    from catalog.run_queries import resumed

    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = resumed(spark, sf)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert plan.count("SortMergeJoin") == 3 and plan.count("Exchange hashpartitioning") <= 4
