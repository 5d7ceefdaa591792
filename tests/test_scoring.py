import os
import uuid

from pyspark.sql import functions as F

from dossierflow.functions import prompts
from dossierflow.operators import scoring
from dossierflow.plans.runs import run_stages, usage_rows
from dossierflow.settings import Settings


def test_every_part_of_a_long_text_is_counted(spark):
    text = " ".join(f"word{i:04d}" for i in range(3667))  # 33,002 characters
    assert len(text) == 33002
    docs = spark.createDataFrame([("a", "a.txt", bytearray(text.encode()))], "file_id string, filename string, content binary")
    stages = ("categorize", "extract", "deidentify")
    wide = run_stages(docs, Settings(scorers={s: scoring.stub_scorer for s in stages}))
    usage = {r.stage: r for r in scoring.token_usage(usage_rows(wide)).collect()}
    windows = [text[i : i + 5000] for i in range(0, len(text) - 500, 4500)]
    assert len(windows) == 8 and windows[-1].endswith("word3666")
    for stage in stages:
        around = len(prompts.default_prompt(stage).replace("{document_text}", " ").split())
        assert usage[stage].prompt_tokens == sum(len(w.split()) + around for w in windows)
        assert usage[stage].completion_tokens == 6 * len(windows)


def test_equal_prompts_are_scored_once(spark, tmp_path):
    folder = str(tmp_path / "called")
    os.mkdir(folder)

    def counting(asked, options):
        for _ in asked:
            open(os.path.join(folder, uuid.uuid4().hex), "w").close()
        if any("bad" in p for p in asked):
            raise ValueError("no answer")
        return scoring.stub_scorer(asked, options)

    rows = [(i, "the same prompt") for i in range(700)] + [(1000 + i, f"own prompt {i % 300}") for i in range(600)]
    rows += [(2000, None), (2001, ""), (2002, "bad one"), (2003, "bad one"), (1, "the same prompt")]
    df = spark.createDataFrame(rows, "id int, prompt string").repartition(5)
    got = scoring.distinct_scores(df, "prompt", counting, f"file://{tmp_path}/work", batch=1).collect()
    assert sorted((r.id, r.prompt or "") for r in got) == sorted((i, p or "") for i, p in rows)
    different = {p for _, p in rows if p is not None}
    assert sum(r.asked for r in got) == len(different)
    # one call for each distinct prompt, a second one for the prompt that failed
    assert len(os.listdir(folder)) == len(different) + 1
    for r in got:
        if r.prompt is None:
            assert r.r is None
        elif "bad" in r.prompt:
            assert r.r.error == "no answer"
        else:
            assert r.r.prompt_tokens == len(r.prompt.split())
