"""Every registered query against its SQL on the smallest scale."""

import pytest

import __spark_entry__ as entry
from catalog import ORACLES, QUERIES
from check_catalog import compare, connect


@pytest.fixture(scope="module")
def con(sf):
    return connect(sf)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, sf, name):
    good, text = compare(spark, con, name, sf)
    assert good, text


def test_contract(spark):
    assert set(ORACLES) <= set(QUERIES) <= set(entry.queries())
    assert ORACLES.items() <= entry.oracle_sql().items()
    assert entry.entry(spark).count() == 200


def test_hot_keys_do_not_change_results(spark, tmp_path):
    """A third of all rows on one key: manifest and fold against plain Python."""
    from dossierflow.operators import ingest

    rows = [("/hot" if i % 3 == 0 else f"/p/{i}", i, f"n{i}") for i in range(6000)]
    want = {}
    for path, seq, name in rows:
        want[path] = name
    got = ingest.manifest(spark.createDataFrame(rows, "volume_path string, seq long, name string").repartition(7), "seq")
    assert {r.volume_path: r.name for r in got.collect()} == want
