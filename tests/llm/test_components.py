import random

import pytest

from dossierflow.llm.components import components


def labels(spark, edges):
    got = components(spark.createDataFrame(edges, "a long, b long").repartition(3)).collect()
    assert len(got) == len({r.node for r in got})
    return {r.node: r.label for r in got}


def plain(edges):
    label = {n: n for e in edges for n in e}
    changed = True
    while changed:
        changed = False
        for a, b in edges:
            least = min(label[a], label[b])
            changed |= (label[a], label[b]) != (least, least)
            label[a] = label[b] = least
    return label


@pytest.mark.parametrize("edges", [
    [],
    [(3, 3)],
    [(5, 4), (4, 5), (4, 4), (9, 8)],
    [(i, i + 1) for i in range(60)],
    [(1000, i) for i in range(200)],
    [(0, i) for i in range(1, 200)] + [(500, 501)],
])
def test_components(spark, edges):
    assert labels(spark, edges) == plain(edges)


def test_random_graph(spark):
    rng = random.Random(4)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(190)]
    assert labels(spark, edges) == plain(edges)


def test_paths_stars_and_loops(spark):
    rng = random.Random(4)
    edges = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(50)] + [(200, 200)]
    rng.shuffle(edges)
    want = {**{i: 0 for i in range(41)}, **{100 + i: 100 for i in range(50)}, 200: 200}
    assert labels(spark, edges) == want
