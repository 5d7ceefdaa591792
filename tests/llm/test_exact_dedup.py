import hashlib
import re

import pytest

from dossierflow.llm import exact_dedup


def brute(rows):
    groups = {}
    for n, (i, t) in enumerate(rows):
        groups.setdefault(re.sub(r"[\x20\x09-\x0D]", "", t or ""), []).append((-len(t or ""), i is None, i or 0, n))
    out = []
    for text, members in groups.items():
        best = min(members)
        for m in members:
            i = rows[m[3]][0]
            out.append((i, rows[best[3]][0], len(members), hashlib.sha256(text.encode()).hexdigest()))
    return sorted(out, key=repr)


def test_against_brute_force(docs_of, awkward):
    got = exact_dedup.decide(docs_of(awkward)).collect()
    assert sorted([(r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in got], key=repr) == brute(awkward)
    kept = [r for r in got if r.kept]
    assert len(kept) == len({r.text_sha256 for r in got}) and all(r.doc_id == r.keep_id for r in kept)


def test_hot_group(docs_of):
    rows = [(i, "same text" if i % 3 == 0 else f"text {i}") for i in range(3000)]
    got = exact_dedup.decide(docs_of(rows))
    assert got.where("kept").count() == 2001 and got.where("group_size = 1000").count() == 1000
    heavy = exact_dedup.frequent(exact_dedup.digests(docs_of(rows))).collect()
    assert [r.group_size for r in heavy] == [1000]


def test_dedup_keeps_all_columns(docs_of, awkward):
    docs = docs_of(awkward)
    left = exact_dedup.dedup(docs)
    assert left.columns == docs.columns
    assert left.count() == len({re.sub(r"[\x20\x09-\x0D]", "", t or "") for _, t in awkward})


@pytest.mark.parametrize("make", [exact_dedup.decide, exact_dedup.dedup])
def test_empty_table(docs_of, make):
    assert make(docs_of([]).limit(0)).count() == 0


def test_plan_has_no_python(docs_of, awkward):
    plan = exact_dedup.decide(docs_of(awkward))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Broadcast" in plan
