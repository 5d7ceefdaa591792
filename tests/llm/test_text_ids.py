"""Operators on documents whose ids are texts."""

import pytest

from dossierflow.llm import (
    decontamination,
    exact_dedup,
    jaccard_join,
    packing,
    secrets,
    sharding,
    simhash,
    substring_dedup,
    suffix_dedup,
)

PASSAGE = " ".join(f"word{i}" for i in range(60))
ROWS = [
    ("a", f"first {PASSAGE} end"), ("b", f"second {PASSAGE} end"), ("c", None), ("d", ""), ("b", "short"),
    (None, f"first {PASSAGE} end"),
]


@pytest.fixture
def docs(spark):
    return spark.createDataFrame(ROWS, "doc_id string, text string").repartition(2)


@pytest.mark.parametrize("make", [
    lambda d, s: substring_dedup.digest(d),
    lambda d, s: suffix_dedup.digest(d),
    lambda d, s: jaccard_join.join(d),
    lambda d, s: sharding.shard(d),
    lambda d, s: exact_dedup.decide(d),
    lambda d, s: simhash.near_duplicates(d),
    lambda d, s: secrets.find(d),
    lambda d, s: packing.pack(d, __import__("public_tokenizers").path("byte_bpe_50k.json")),
    lambda d, s: decontamination.find(d, s.createDataFrame([("i", "word1 word2 word3")], "item_id string, text string"), n=10),
], ids=["substring", "suffix", "jaccard", "sharding", "exact", "simhash", "secrets", "packing", "decontamination"])
def test_text_ids(spark, docs, make):
    got = [r.doc_id for r in make(docs, spark).collect()]
    assert sorted(got, key=str) == sorted((i for i, _ in ROWS), key=str)


def test_text_ids_find_the_same_links(spark, docs):
    got = {(r.doc_id, r.class_id) for r in jaccard_join.join(docs).collect()}
    assert {("a", "a"), ("b", "a"), (None, "a")} <= got


def test_dedup_keeps_text_ids(spark, docs):
    assert sorted(r.doc_id or "-" for r in jaccard_join.dedup(docs).collect()) == ["a", "b", "c", "d"]
