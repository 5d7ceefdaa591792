from pyspark.sql import functions as F

from dossierflow.operators.rules import Lexicon
from dossierflow.plans import cache
from dossierflow.settings import Settings

DOCS = [
    ("1", "a.txt", b"Total $5"), ("2", "b.txt", b"Total $5"), ("3", "c.html", b"Total $5"), ("4", "d.txt", b"other"),
    ("5", "e.pdf", b"x"), ("6", "", b"Total $5"), ("7", "f.txt", None), ("8", "g.txt", None),
]
SCHEMA = "file_id string, filename string, content binary"


def frame(spark, rows):
    return spark.createDataFrame([(i, n, None if c is None else bytearray(c)) for i, n, c in rows], SCHEMA).repartition(3)


def test_equal_bytes_run_once(spark, tmp_path):
    first = cache.run_cached(frame(spark, DOCS), Settings())
    rows = {r.file_id: r for r in first.collect()}
    assert len(rows) == len(DOCS)
    assert {i for i, r in rows.items() if r.ran} == {"1", "3", "4", "5", "6", "7", "8"}
    assert [rows[i].entities_count for i in ("1", "2", "3")] == [1, 1, 1]
    assert {i for i, r in rows.items() if r.status == "failed"} == {"5", "6", "7", "8"}
    folder = str(tmp_path / "cache")
    cache.new_entries(first).write.parquet(folder)
    stored = spark.read.parquet(folder)
    assert stored.count() == 3

    # other names, and one new text: only it and what had failed runs
    again = frame(spark, [(f"n{i}", f"new {n}" if n else "", c) for i, n, c in DOCS] + [("9", "z.txt", b"new")])
    rows = {r.file_id: r for r in cache.run_cached(again, Settings(), stored).collect()}
    assert {i for i, r in rows.items() if r.cached} == {"n1", "n2", "n3", "n4"}
    assert {i for i, r in rows.items() if r.ran} == {"9", "n5", "n6", "n7", "n8"}
    assert rows["n2"].entities_count == 1 and rows["n2"].document_text == "Total $5"

    # other settings: nothing of it counts
    changed = Settings(lexicon=Lexicon.of({"X": "total"}))
    rows = {r.file_id: r for r in cache.run_cached(frame(spark, DOCS), changed, stored).collect()}
    assert not any(r.cached for r in rows.values()) and rows["2"].primary_category == "X"


def test_digest_follows_what_results_depend_on():
    base = cache.settings_digest(Settings())
    assert base == cache.settings_digest(Settings(catalog="other", volume="v"))
    assert base != cache.settings_digest(Settings(model="big"))
    assert base != cache.settings_digest(Settings(), version="2")


def test_thinning_keeps_every_match(spark):
    rows = spark.range(5000).select(F.sha2(F.col("id").cast("string"), 256).alias("key"))
    keys = rows.where("substring(key, 1, 1) = 'a'")
    kept = {r.key for r in cache.thinned(rows, keys, bits=12).collect()}
    want = {r.key for r in keys.collect()}
    assert want <= kept and len(kept) < 2500
    assert {r.key for r in cache.thinned(rows, keys).collect()} >= want
