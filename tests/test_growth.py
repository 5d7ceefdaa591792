"""Steps whose cost grew too fast: what must not come back."""

import collections
import random
import re

from pyspark.sql import functions as F

from catalog import QUERIES
from dossierflow.functions.redaction import mask_entities
from dossierflow.operators import categorize, deidentify, extract, phrases, rules
from dossierflow.streaming import arrivals
from tests.test_plan_shapes import plan_of


def test_listed_items_are_computed_once(spark):
    # an inner posexplode brings a filter on the list's size, and with it a second search
    docs = spark.createDataFrame([(1, "Email: a@b.cc"), (2, None)], "doc_id int, text string")
    found = deidentify.with_pii_items(docs)
    rows = extract.item_rows(found, F.col("pii_items"))
    assert [(r.doc_id, r.pos, r.i.value) for r in rows.collect()] == [(1, 0, "a@b.cc")]
    once = plan_of(found).count("ABA Number")
    assert plan_of(rows).count("ABA Number") == once


def test_registered_lists_are_computed_once(spark, sf):
    for name in ("pii_strategies", "pii_preview", "mask_entities"):
        plan = plan_of(QUERIES[name](spark, sf))
        assert plan.count("Lender|Employer" if name == "mask_entities" else "ABA Number") == 1, name


def test_rules_read_only_lines_that_can_match(spark):
    text = "Name: Ann Lee\r\n\nEmail: a@b.cc\nx@y.zz\nBalance: $5\n\n(303) 555-0101 or 1-800-555-0199\nDOB: 2001-02-03"
    docs = spark.createDataFrame([(1, text), (2, ""), (3, None), (4, "\n\n"), (5, "Name:\nAnn Lee")], "doc_id int, text string")
    for rule in (*rules.ENTITY_RULES, *rules.PII_RULES):
        sql = rules.matches_sql("text", rule)
        assert rule.one_line and "filter(split(text" in sql
        for row in docs.select("text", F.expr(sql).alias("m")).collect():
            assert row.m == [m.group(rule.group) for m in re.finditer(rule.pattern, row.text or "")], rule.type


def test_rules_over_several_lines_see_the_whole_text(spark):
    docs = spark.createDataFrame([(1, "total\n5 and total\n6")], "doc_id int, text string")
    rule = rules.Rule("total", "total\n[0-9]", 1.0, ("total",))
    assert docs.select(F.expr(rules.matches_sql("text", rule)).alias("m")).first().m == ["total\n5", "total\n6"]
    entities = docs.select(rules.entities_of("text", [rule]).alias("e")).first().e
    assert [e.value for e in entities] == ["total\n5", "total\n6"]


def test_masked_rows_keep_their_places(spark):
    docs = extract.with_entities(spark.createDataFrame([(1, "Name: Ann Lee\na@b.cc 50%")], "doc_id int, text string"))
    rows = extract.item_rows(docs, mask_entities(F.col("entities"))).collect()
    assert [(r.pos, r.i.type, r.i.masked) for r in rows] == [(0, "person", True), (1, "amount", None), (2, "email", True)]


def test_only_runs_that_may_be_terms_are_made(spark):
    docs = spark.createDataFrame([(1, "x rate swap y swap rate"), (2, "rate"), (3, "")], "doc_id int, text string")
    runs = docs.select("doc_id", phrases._runs(F.col("text"), 2, {1: ["swap"], 2: ["rate"]}).alias("r")).collect()
    assert [[tuple(x) for x in row.r] for row in runs] == [[(2, 1, "swap"), (4, 1, "swap"), (1, 2, "rate swap")], [], []]


def test_large_lexicons_join_all_runs(spark, monkeypatch):
    docs = spark.createDataFrame([(1, "an interest rate swap"), (2, "swap swap rate"), (3, None)], "doc_id int, text string")
    lexicon = spark.createDataFrame([("A", "interest rate", 1.0), ("B", "swap", 2.0), ("B", None, 1.0)], "category string, term string, weight double")
    thinned = sorted(map(tuple, phrases.categorize_phrases(docs, lexicon).collect()))
    monkeypatch.setattr(phrases, "FIRSTS", 1)
    assert sorted(map(tuple, phrases.categorize_phrases(docs, lexicon).collect())) == thinned


def test_words_are_counted_without_a_shuffle(spark):
    rng = random.Random(3)
    texts = [" ".join(rng.choice("A a b ccc éé 12-3".split()) for _ in range(n)) for n in (0, 1, 2, 50)] + [None, "..."]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    counted = docs.select("doc_id", categorize.word_counts(F.col("text")).alias("c"))
    assert "Exchange" not in plan_of(counted)
    for row in counted.collect():
        words = collections.Counter(re.findall(r"[a-zé0-9]+(?:-[0-9]+)?", (texts[row.doc_id] or "").lower()))
        assert {c.term: c.n for c in row.c} == dict(words) and len(row.c) == len(words)


def test_arrivals_take_many_files_at_once(spark, sf, monkeypatch):
    most = []
    real = arrivals.arriving_files
    monkeypatch.setattr(arrivals, "arriving_files", lambda *a, **k: most.append(k.get("max_files", 1000)) or real(*a, **k))
    assert QUERIES["stream_arrivals"](spark, sf).first().failed == 0
    assert most == [200]
