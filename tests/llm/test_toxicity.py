import random
import zlib

import numpy as np
import pytest

from dossierflow.llm import toxicity as tx


def texts(n, seed=1):
    rng = random.Random(seed)
    out = []
    for i in range(n):
        bad = i % 5 == 0
        lines = [" ".join(f"w{rng.randint(0, 400)}" for _ in range(8)) for _ in range(rng.randint(1, 6))]
        if bad:
            k = rng.randrange(len(lines))
            lines[k] += " " + rng.choice(["scum", "vermin"])
        out.append((i, ". ".join(lines) + ".", int(bad)))
    return out


@pytest.fixture(scope="module")
def case(spark, docs_of):
    rows = texts(1500)
    labels = spark.createDataFrame([(i, 1, y) for i, _, y in rows], "doc_id long, quality int, toxic int")
    return rows, docs_of([(i, t) for i, t, _ in rows]), labels


def test_held_out_accuracy_and_sentences(case):
    rows, docs, labels = case
    truth = {i: (t, y) for i, t, y in rows}
    got = tx.predict(docs, labels).collect()
    held = [r for r in got if r.held_out]
    assert {r.doc_id for r in held} == {i for i in truth if zlib.crc32(str(i).encode()) % 5 == 0}
    assert all(r.predicted == truth[r.doc_id][1] for r in held)
    for r in held:
        text, bad = truth[r.doc_id]
        found = [text[s.start : s.end] for s in r.sentences]
        assert len(found) == bad and all("scum" in s or "vermin" in s for s in found)


def test_labels_of_held_out_rows_do_not_matter(spark, case):
    rows, docs, labels = case
    turned = spark.createDataFrame(
        [(i, 1, 1 - y if zlib.crc32(str(i).encode()) % 5 == 0 else y) for i, _, y in rows],
        "doc_id long, quality int, toxic int",
    )
    a = {r.doc_id: round(r.score, 9) for r in tx.predict(docs, labels).collect()}
    assert a == {r.doc_id: round(r.score, 9) for r in tx.predict(docs, turned).collect()}


def test_gradient_finds_the_witness():
    bags = [[[0, 1]], [[1]], [[0]], [[1], [0, 1]]] * 20
    labels = np.array([1, 0, 1, 1] * 20)
    weights, bias, leak = tx.fit_bags(labels, bags, 2)
    assert weights[0] > 1 > weights[1] and 0 < leak < 0.5


def test_awkward_rows(spark, docs_of, awkward, case):
    _, docs, labels = case
    model = tx.fit(docs, labels)
    got = tx.score(docs_of(awkward), model).collect()
    assert len(got) == len(awkward) and all(0 <= r.score <= 1 for r in got)
    assert {r.score for r in got if r.doc_id in (100, 101)} == {1 - (1 - model.leak)}
    none = labels.limit(0)
    assert {r.score for r in tx.predict(docs_of(awkward), none).collect()} == {0.0}
    assert tx.predict(docs_of([]).limit(0), labels).count() == 0
    odd = spark.createDataFrame([(None, 1), (1, None), (2, 0), (2, 1), (2, 1)], "doc_id long, toxic int")
    assert tx.predict(docs_of(awkward), odd).count() == len(awkward)


def test_reject_keeps_clean_rows(case):
    rows, docs, labels = case
    left = tx.reject(docs, labels)
    assert left.columns == docs.columns
    assert {r.doc_id for r in left.collect()} == {i for i, _, y in rows if not y}


@pytest.mark.parametrize("every", [2, 3, 10])
def test_mostly_toxic_labels(spark, docs_of, every):
    """All but one of ``every`` documents are toxic; the words are found and clean documents stay."""
    rng = random.Random(every)
    rows = []
    for i in range(3000):
        bad = int(i % every > 0)
        lines = [" ".join(f"w{rng.randint(0, 400)}" for _ in range(8)) for _ in range(rng.randint(1, 6))]
        if bad:
            lines[rng.randrange(len(lines))] += " " + rng.choice(["scum", "vermin"])
        rows.append((i, ". ".join(lines) + ".", bad))
    docs = docs_of([(i, t) for i, t, _ in rows])
    labels = spark.createDataFrame([(i, 1, y) for i, _, y in rows], "doc_id long, quality int, toxic int")
    assert {b"scum", b"vermin"} <= tx.fit(docs, labels).weights.keys()
    assert {r.doc_id for r in tx.reject(docs, labels).collect()} == {i for i, _, y in rows if not y}


def test_word_of_every_document_and_one_label_only(spark, docs_of):
    docs = docs_of([(i, "always here") for i in range(60)])
    some = spark.createDataFrame([(i, i % 2) for i in range(60)], "doc_id long, toxic int")
    assert tx.fit(docs, some).weights == {}
    assert tx.fit(docs, some.withColumn("toxic", some.toxic * 0 + 1)).weights == {}
