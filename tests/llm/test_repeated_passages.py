import hashlib
import random
import re
from collections import Counter

import numpy as np
import pytest

from dossierflow.llm import recurrence as rec
from dossierflow.llm import substring_dedup, suffix_dedup


def brute_words(rows, window):
    texts = [re.findall(r"[^\x20\x09-\x0D]+", t or "") for _, t in rows]
    seen = Counter(tuple(w[j : j + window]) for w in texts for j in range(len(w) - window + 1))
    out = []
    for (i, _), w in zip(rows, texts):
        gone = set()
        for j in range(len(w) - window + 1):
            if seen[tuple(w[j : j + window])] > 1:
                gone |= set(range(j, j + window))
        left = " ".join(x for j, x in enumerate(w) if j not in gone)
        out.append((i, len(w), len(gone), hashlib.sha256(left.encode()).hexdigest()))
    return sorted(out, key=repr)


def brute_bytes(rows, window):
    seen, out = set(), []
    for i, t in sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, r[1] is not None, r[1] or "")):
        raw, gone = (t or "").encode(), set()
        for j in range(len(raw) - window + 1):
            if raw[j : j + window] in seen:
                gone |= set(range(j, j + window))
            seen.add(raw[j : j + window])
        left = bytes(x for j, x in enumerate(raw) if j not in gone)
        spans = sum(j - 1 not in gone for j in gone)
        out.append((i, len(raw), len(gone), spans, hashlib.sha256(left).hexdigest()))
    return sorted(out, key=repr)


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(3)
    base = [" ".join(rng.choice("ab cd ef gh é".split()) for _ in range(60)) for _ in range(3)]
    out = []
    for i in range(120):
        t = " ".join(rng.choice(["a", "bb", "c\n", "dé ", "\x0be", "f"]) for _ in range(rng.randint(0, 80)))
        if i % 3 == 0:
            b = rng.choice(base).split()
            s = rng.randint(0, 30)
            t += " " + " ".join(b[s : s + rng.randint(3, 40)]) + " " + t[:20]
        if i % 7 == 0:
            t = "x " * rng.randint(0, 60)
        out.append((i if i % 11 else (None if i % 2 else 5), t if i % 13 else None))
    return out + [out[3], out[3], (77, "")]


@pytest.mark.parametrize("hot", [50_000, 3])
def test_words_against_brute_force(docs_of, rows, hot):
    got = substring_dedup.digest(docs_of(rows), 6, 2, hot).collect()
    assert sorted(map(tuple, got), key=repr) == brute_words(rows, 6)


@pytest.mark.parametrize("hot", [50_000, 3])
def test_bytes_against_brute_force(docs_of, rows, hot):
    got = suffix_dedup.digest(docs_of(rows), 12, 3, hot).collect()
    assert sorted(map(tuple, got), key=repr) == brute_bytes(rows, 12)


def test_values_with_a_large_share_go_by_aggregates(docs_of, rows, monkeypatch):
    plain = rec.hot_values
    seen = []

    def all_hot(docs, units, window, gram, parts):
        found = plain(docs, units, window, gram, 2000)
        seen.append(found.count())
        return found

    monkeypatch.setattr(rec, "hot_values", all_hot)
    got = suffix_dedup.digest(docs_of(rows), 12, 3).collect()
    assert sorted(map(tuple, got), key=repr) == brute_bytes(rows, 12)
    got = substring_dedup.digest(docs_of(rows), 6, 2).collect()
    assert sorted(map(tuple, got), key=repr) == brute_words(rows, 6)
    assert min(seen) > 0


def test_small_blocks(docs_of, rows, monkeypatch):
    monkeypatch.setattr(rec, "BLOCK_BYTES", 64)
    got = suffix_dedup.digest(docs_of(rows), 12, 3).collect()
    assert sorted(map(tuple, got), key=repr) == brute_bytes(rows, 12)
    got = substring_dedup.digest(docs_of(rows), 6, 2).collect()
    assert sorted(map(tuple, got), key=repr) == brute_words(rows, 6)


def test_awkward_and_empty(docs_of, awkward):
    got = substring_dedup.digest(docs_of(awkward)).collect()
    assert sorted(map(tuple, got), key=repr) == brute_words(awkward, 35)
    got = suffix_dedup.digest(docs_of(awkward)).collect()
    assert sorted(map(tuple, got), key=repr) == brute_bytes(awkward, 100)
    for make in (substring_dedup.digest, suffix_dedup.digest, substring_dedup.dedup, suffix_dedup.dedup):
        assert make(docs_of([]).limit(0)).count() == 0


def test_kept_text(docs_of):
    passage = " ".join(f"w{i}" for i in range(40))
    rows = [(1, f"start {passage} end"), (2, f"other {passage}")]
    assert {r.doc_id: r.kept for r in substring_dedup.dedup(docs_of(rows)).collect()} == {1: "start end", 2: "other"}
    kept = {r.doc_id: bytes(r.kept) for r in suffix_dedup.dedup(docs_of(rows)).collect()}
    assert kept == {1: rows[0][1].encode(), 2: b"other"}


def test_ranks():
    data = np.frombuffer(b"abcabcabcabcabcabcabdabcabc" * 3, np.uint8)
    for window in (3, 8, 13, 20):
        rank = suffix_dedup.ranks(data, window)
        places = range(len(data) - window + 1)
        raw = [data[p : p + window].tobytes() for p in places]
        assert all((rank[p] == rank[q]) == (raw[p] == raw[q]) for p in places for q in places)
