"""What the physical plans must and must not hold."""

import pytest

from catalog import QUERIES, fixtures as fx
from dossierflow.operators import ingest
from dossierflow.operators.rules import SharedMatches
from dossierflow.plans import status as st
from dossierflow.plans.runs import run_stages
from dossierflow.settings import Settings


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_a_run_is_one_pass_without_shuffle_or_python(spark, sf):
    plan = plan_of(run_stages(fx.run_docs(spark, sf), Settings()))
    for node in ("Exchange", "Python", "Join", "Window", "Aggregate"):
        assert node not in plan, node


def test_each_pattern_is_searched_once():
    settings = Settings()
    shared = SharedMatches(settings.entity_rules, settings.pii_rules)
    patterns = {r.pattern for r in (*settings.entity_rules, *settings.pii_rules)}
    assert len(shared.names) == len(patterns) < len(settings.entity_rules) + len(settings.pii_rules)


def test_unused_results_are_not_computed(spark, sf):
    plan = plan_of(run_stages(fx.run_docs(spark, sf), Settings()).select("file_id", "primary_category"))
    assert "Routing Number" not in plan


def test_scans_read_only_what_is_used(spark, sf):
    plan = QUERIES["safe_filename"](spark, sf)._jdf.queryExecution().executedPlan().toString()
    schema = plan[plan.index("ReadSchema"):]
    assert "text" not in schema and "n_chars" not in schema


def test_top_k_is_not_a_full_sort(spark, sf):
    assert "TakeOrderedAndProject" in plan_of(st.newest(fx.status(spark, sf), 20))


def test_landing_thins_hot_paths_before_the_shuffle(spark):
    up = spark.range(10).selectExpr("concat('/p/', id % 2) AS volume_path", "id AS seq", "concat('t', id) AS text")
    plan = plan_of(ingest.latest_content(up, "seq"))
    assert "Sort" not in plan and "partial_max" in plan
    assert "partial_max_by" in plan_of(ingest.manifest(up, "seq"))


def test_fold_has_one_shuffle_after_partial_folding(spark):
    log = spark.createDataFrame([], "file_id string, event_time timestamp, seq long, changes map<string,string>")
    plan = plan_of(st.fold(log))
    assert plan.count("Exchange") == 1 and "partial_max_by" in plan


def test_only_prompts_cross_to_python(spark, sf):
    from dossierflow.operators.scoring import stub_scorer

    plan = plan_of(run_stages(fx.run_docs(spark, sf), Settings(scorers={"categorize": stub_scorer})))
    assert plan.count("ArrowEvalPython") == 1 and "MapInPandas" not in plan


@pytest.mark.parametrize("name", ["document_wide", "statement_runs", "status_fold", "resume_result", "ingest_manifest"])
def test_no_cross_join(spark, sf, name):
    plan = plan_of(QUERIES[name](spark, sf))
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan
