import hashlib
import random
import re

import pytest

from dossierflow.llm import decontamination as dc

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute(rows, items, n):
    windows = {}
    for i, t in items:
        w = words(t)
        for j in range(len(w) - n + 1) if len(w) >= n else [0] * bool(w):
            windows.setdefault(tuple(w[j : j + n]), set()).add(str(i))
    out = []
    for i, t in rows:
        w = words(t)
        hit, found = set(), set()
        for size in {len(x) for x in windows}:
            for j in range(len(w) - size + 1):
                who = windows.get(tuple(w[j : j + size]))
                if who:
                    found |= who
                    hit |= set(range(j, j + size))
        sha = hashlib.sha256(",".join(sorted(found)).encode()).hexdigest()
        out.append((i, len(w), len(hit), len(found), sha, bool(hit)))
    return sorted(out, key=repr)


@pytest.fixture(scope="module")
def case():
    rng = random.Random(5)
    vocabulary = [f"w{i}" for i in range(12)] + ["é", "Über", "X9"]
    items = [(i, " ".join(rng.choice(vocabulary) for _ in range(rng.randint(0, 9)))) for i in range(40)]
    items += [(50, None), (51, ""), (52, items[3][1]), (53, "w1")]
    rows = [(i, ", ".join(rng.choice(vocabulary) for _ in range(rng.randint(0, 80)))) for i in range(120)]
    rows += [(None, rows[0][1]), (7, None), (8, ""), rows[1], rows[1]]
    return rows, items


@pytest.mark.parametrize("n", [2, 4, 20])
@pytest.mark.parametrize("shard", [100_000, 20])
def test_against_brute_force(spark, docs_of, case, n, shard, monkeypatch):
    rows, items = case
    monkeypatch.setattr(dc, "SHARD_WORDS", shard)
    got = dc.find(docs_of(rows), spark.createDataFrame(items, "item_id long, text string"), n)
    assert sorted([tuple(r) for r in got.collect()], key=repr) == brute(rows, items, n)


def test_long_item_in_pieces():
    n, ws = 3, [b"%d" % i for i in range(50)]
    old, dc.SHARD_WORDS = dc.SHARD_WORDS, 10
    try:
        pieces = dc._pieces("a", ws, n)
    finally:
        dc.SHARD_WORDS = old
    assert {tuple(p[i : i + n]) for _, p in pieces for i in range(len(p) - n + 1)} == {
        tuple(ws[i : i + n]) for i in range(48)
    }


def test_clean(spark, docs_of):
    item = "one two three four five six seven eight nine ten eleven"
    rows = [(1, "before it. " * 20 + item.upper() + "! and after"), (2, item), (3, "clean text"), (4, None), (5, "")]
    items = spark.createDataFrame([(1, item)], "item_id long, text string")
    docs = docs_of(rows)
    left = dc.clean(docs, items)
    assert left.columns == docs.columns
    got = {r.doc_id: r.text for r in left.collect()}
    assert got == {1: "before it. " * 20 + "! and after", 3: "clean text", 4: None, 5: ""}


def test_empty_tables(spark, docs_of):
    none = spark.createDataFrame([], "item_id long, text string")
    assert dc.find(docs_of([(1, "a b")]), none).collect()[0].contaminated is False
    assert dc.find(docs_of([]).limit(0), none).count() == 0
    assert dc.clean(docs_of([]).limit(0), none).count() == 0


def test_items_without_id_hit(spark, docs_of):
    items = spark.createDataFrame([(None, "a b c"), (None, "x y"), (1, "c d e")], "item_id long, text string")
    docs = docs_of([(1, "z a b c d e z"), (2, "q x y q"), (3, "q")])
    got = {r.doc_id: r for r in dc.find(docs, items, 3).collect()}
    assert [(got[i].n_hit, got[i].n_items, got[i].contaminated) for i in (1, 2, 3)] == [(5, 1, True), (2, 0, True), (0, 0, False)]
    assert [got[i].items_sha256 for i in (1, 2)] == [hashlib.sha256(x).hexdigest() for x in (b"1", b"")]
    assert {r.doc_id: r.text for r in dc.clean(docs, items, 3, 1.0).collect()}[2] == "q  q"
