import random
import re

import pytest

import corpus_pipeline
from dossierflow.llm import packing


def near(a, b):
    return 5 * len(a & b) >= 4 * len(a | b)


def grams(t):
    w = re.findall(r"[^\x20\x09-\x0D]+", t or "")
    return frozenset(tuple(w[j : j + 5]) for j in range(max(1, len(w) - 4))) if w else frozenset()


def brute(rows, toxic, items):
    """The five stages in plain Python; texts by doc_id."""
    rows = [(i, t) for i, t in rows if i not in toxic]
    best = {}
    for i, t in rows:
        key = re.sub(r"[\x20\x09-\x0D]", "", t or "")
        rank = (-len(t or ""), i is None, i or 0)
        if key not in best or rank < best[key][0]:
            best[key] = (rank, i, t)
    rows = sorted([(i, t) for _, i, t in best.values()], key=lambda r: (r[0] is None, r[0] or 0))
    sets = [grams(t) for _, t in rows]
    label = list(range(len(rows)))
    pairs = [(a, b) for b in range(len(rows)) for a in range(b) if sets[a] & sets[b] and near(sets[a], sets[b])]
    changed = True
    while changed:
        changed = False
        for a, b in pairs:
            low = min(label[a], label[b])
            changed |= label[a] != low or label[b] != low
            label[a] = label[b] = low
    rows = [r for n, r in enumerate(rows) if label[n] == n]
    out = {}
    for i, t in rows:
        places = [(m.start(), m.end()) for m in re.finditer(r"[0-9A-Za-z\x80-\U0010ffff]+", t or "")]
        w = [(t[s:e]).lower() for s, e in places]
        hit = set()
        for item in items:
            x = item.split()
            for j in range(len(w) - 9):
                if any(w[j : j + 10] == x[k : k + 10] for k in range(len(x) - 9)):
                    hit |= set(range(j, j + 10))
        if hit:
            if len(hit) > 0.5 * len(w):
                continue
            cut, at = "", 0
            for p in sorted(hit):
                if p - 1 not in hit:
                    cut += t[at : places[p][0]]
                at = places[p][1]
            t = cut + t[at:]
        out[i] = t
    return out


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    rng = random.Random(8)
    folder = tmp_path_factory.mktemp("tables")
    text = lambda n: " ".join(f"w{rng.randint(0, 3000)}" for _ in range(n))
    items = [" ".join(f"item{k}x{j}" for j in range(14)) for k in range(3)]
    rows, toxic = [], set()
    for i in range(900):
        t = ". ".join(text(12) for _ in range(5))
        if i % 9 == 0:
            toxic.add(i)
            t += ". such scum here."
        rows.append((i, t))
    base = rows[1][1].split()
    for i in range(900, 920):  # copies, near copies, contaminated ones
        rows.append((i, rows[2][1] + " " * (i % 3)))
        w = list(base)
        w[i % len(base)] = f"new{i}"
        rows.append((i + 100, " ".join(w)))
        rows.append((i + 200, text(30) + " " + items[i % 3].title() + ". " + text(20)))
        rows.append((i + 300, "Intro: " + items[i % 3] + f" tail{i}"))
    rows += [(2000, None), (2001, ""), (2002, " \n"), (None, text(40)), (2003, "short"), (2003, "other"), (2004, text(9000))]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows],
                                 "doc_id long, text string, lang string, source string, n_chars long")
    docs.repartition(4).write.parquet(f"{folder}/documents.parquet")
    labels = [(i, 1, int(i in toxic)) for i in range(900)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame(list(enumerate(items)), "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return str(folder), rows, toxic, items


def test_run_against_brute_force(spark, tables):
    folder, rows, toxic, items = tables
    got = corpus_pipeline.run(spark, folder).collect()
    # doc 2003 names two different rows, which brute force by doc_id can't hold
    want = brute([r for r in rows if r[0] != 2003], toxic, items)
    enc = packing.Encoder(corpus_pipeline.TOKENIZER)
    lengths = {}
    for r in got:
        lengths[r.doc_id] = lengths.get(r.doc_id, 0) + r.length
    two = lengths.pop(2003)
    assert two == sum(len(enc.encode([t])[0]) // 4 + 1 for t in ("short", "other"))
    assert lengths == {i: len(enc.encode([t or ""])[0]) // 4 + 1 for i, t in want.items()}


def test_stages_keep_the_columns_of_documents(spark, tables):
    folder, *_ = tables
    docs = spark.read.parquet(f"{folder}/documents.parquet").limit(50)
    assert [n for n, _ in corpus_pipeline.STAGES] == [
        "toxicity", "exact_dedup", "ngram_jaccard_join", "decontamination", "packing"]
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, folder).columns == docs.columns


def test_empty_documents(spark, tables, tmp_path):
    folder, *_ = tables
    docs = spark.read.parquet(f"{folder}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, folder).count() == 0


def test_contract(spark):
    import __spark_entry__ as entry

    names = [n for n in entry.queries() if re.match(r"op\d+_", n)]
    assert sorted(int(n[2:].split("_")[0]) for n in names) == list(range(1, 11))
    assert entry.queries()["pipeline"] is corpus_pipeline.run and corpus_pipeline.ORACLE_SQL is None
    assert set(entry.oracle_sql()) <= set(entry.queries())
