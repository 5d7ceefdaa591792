import random

import numpy as np
import pytest

from dossierflow.llm import jaccard_join as jj


def grams(text):
    w = (text or "").split()
    return frozenset(tuple(w[j : j + 5]) for j in range(max(1, len(w) - 4))) if w else frozenset()


def brute(rows):
    sets = [grams(t) for _, t in rows]
    near = [
        [b for b in range(len(rows)) if a != b and sets[a] and 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b])]
        for a in range(len(rows))
    ]
    label = list(range(len(rows)))
    for _ in rows:
        label = [min([label[a], *(label[b] for b in near[a])]) for a in range(len(rows))]
    order = lambda n: (rows[n][0] is None, rows[n][0] or 0)
    out = []
    for a, (i, _) in enumerate(rows):
        group = [b for b in range(len(rows)) if label[b] == label[a]]
        out.append((i, rows[min(group, key=order)][0], len(near[a])))
    return sorted(out, key=repr), len(set(label))


@pytest.fixture(scope="module")
def rows(awkward):
    rng = random.Random(9)
    base = [[f"v{rng.randint(0, 300)}" for _ in range(120)] for _ in range(6)]
    out = [r for r in awkward if r[0] != 105]
    for i in range(200, 330):
        w = list(base[i % 6 if i % 2 else 0])
        for _ in range(rng.choice([0, 1, 1, 2, 3])):
            w[rng.randrange(len(w))] = f"n{i}"
        out.append((i, " ".join(w)))
    out += [(400, "one two three"), (401, "one  two\tthree"), (402, "one two four")]
    return out


@pytest.mark.parametrize("block", [128, 7])
def test_against_brute_force(docs_of, rows, block, monkeypatch):
    monkeypatch.setattr(jj, "BLOCK", block)
    got = jj.join(docs_of(rows)).collect()
    assert sorted([(r.doc_id, r.class_id, r.n_links) for r in got], key=repr) == brute(rows)[0]


def test_dedup_keeps_one_of_each_group(docs_of, rows):
    docs = docs_of(rows)
    left = jj.dedup(docs)
    assert left.columns == docs.columns
    assert left.count() == brute(rows)[1]


def test_recall_of_bands():
    assert 1 - (1 - 0.8**jj.ROWS) ** jj.BANDS >= jj.RECALL


def test_overlaps():
    rng = np.random.default_rng(1)
    sets = [np.unique(rng.integers(0, 9000, rng.integers(1, 6000)).astype(np.uint64)) for _ in range(9)]
    want = [[len(np.intersect1d(a, b)) for b in sets] for a in sets]
    off = ~np.eye(9, dtype=bool)
    assert (jj.overlaps(sets)[off] == np.array(want)[off]).all()


def test_empty(docs_of):
    assert jj.join(docs_of([]).limit(0)).count() == 0
    assert [tuple(r)[:3] for r in jj.join(docs_of([(1, None)])).collect()] == [(1, 1, 1)]
