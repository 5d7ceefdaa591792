import random

import pytest


@pytest.fixture(scope="session")
def docs_of(spark):
    """Documents from (doc_id, text), with columns whose names clash with the operators' own."""

    def make(rows):
        return spark.createDataFrame(
            [(i, t, "x", 1, None) for i, t in rows], "doc_id long, text string, row_id string, size int, kept string"
        ).repartition(3)

    return make


@pytest.fixture(scope="session")
def awkward():
    """Nulls, empty and blank texts, repeated rows, ties, a long text, non-ASCII words."""
    rng = random.Random(11)
    words = "alpha beta gamma delta epsilon zeta eta theta naïve ñu 1234 I'm".split()
    rows = [(i, " ".join(rng.choice(words) for _ in range(rng.randint(0, 60)))) for i in range(60)]
    rows += [(100, None), (101, ""), (102, " \t\n"), (None, rows[3][1]), (None, None), rows[4], rows[4]]
    rows += [(103, rows[5][1] + " \n"), (104, rows[5][1]), (105, " ".join(rng.choice(words) for _ in range(20000)))]
    return rows
