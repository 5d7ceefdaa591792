import math

import numpy as np
import pytest

from dossierflow.llm import whitening


def table(spark, rows):
    rows = [(i, v, "a", 1) for i, v in rows]
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>, component string, n int").repartition(3)


def expected(rows):
    """Plain version: exact integers, then an eigendecomposition of the centred covariance."""
    def good(v):
        return v is not None and v and all(c is not None and math.isfinite(c) for c in v)

    x = {i: tuple(math.floor(64 * float(np.float32(c))) + 1_000_000 for c in v) for i, v in rows if good(v)}
    fit = sorted(set(x.values()))
    n, sums = len(fit), [sum(c) for c in zip(*fit)]
    a = np.array([[c - s // n - (s % n) / n for c, s in zip(f, sums)] for f in fit])
    e, v = np.linalg.eigh(a.T @ a / n)
    e, v = e[::-1], v[:, ::-1]
    deviation = {i: sum((n * c - s) ** 2 for c, s in zip(f, sums)) for i, f in x.items()}
    rest = {i: np.array([c - s // n - (s % n) / n for c, s in zip(f, sums)]) for i, f in x.items()}
    return n, e, v, deviation, rest


def test_against_plain_version(spark):
    rng = np.random.default_rng(3)
    base = rng.normal(size=(400, 20)) * np.geomspace(8, 0.05, 20)
    rows = [(i, [float(c) for c in np.float32(b)]) for i, b in enumerate(base)]
    rows += [(500, rows[0][1]), (501, rows[1][1]), (502, None), (503, [1.0] * 19 + [None]), (504, [float("nan")] * 20)]
    rows += [(505, [float("inf")] + [0.0] * 19), (506, [1.0] * 3), (507, [])]
    usable = [r for r in rows if r[0] not in (506, 507)]
    n, e, v, deviation, rest = expected(usable)
    got = whitening.whiten(table(spark, rows)).collect()
    assert {r.vec_id for r in got} == set(deviation)
    assert len(got) == 16 * len(deviation)
    w = np.zeros((len(deviation), 16))
    place = {i: k for k, i in enumerate(deviation)}
    for r in got:
        assert (r.n, r.deviation) == (n, deviation[r.vec_id])
        assert r.explained == pytest.approx(e[r.component - 1] / e.sum(), rel=1e-9)
        assert r.identity_error < 1e-9
        w[place[r.vec_id], r.component - 1] = r.whitened
    want = np.array([rest[i] @ v[:, :16] / np.sqrt(e[:16]) for i in deviation])
    assert np.abs(np.abs(w) - np.abs(want)).max() < 1e-7
    assert all(min(np.abs(w[:, j] - want[:, j]).max(), np.abs(w[:, j] + want[:, j]).max()) < 1e-7 for j in range(16))


def test_dependent_and_constant_dimensions_have_no_component(spark):
    rng = np.random.default_rng(5)
    a = rng.integers(-50, 50, (60, 3))
    rows = [(i, [float(x), float(y), float(z), float(x + y), 7.0]) for i, (x, y, z) in enumerate(a)]
    got = whitening.whiten(table(spark, rows)).collect()
    assert {r.component for r in got} == {1, 2, 3}
    assert sum({r.component: r.explained for r in got}.values()) == pytest.approx(1)
    assert max(r.identity_error for r in got) < 1e-6


def test_large_values_stay_exact_or_become_null(spark):
    rows = [(1, [1e6, 0.0]), (2, [-1e6, 1.0]), (3, [3e30, 1.0]), (4, [0.5, 2.0])]
    got = {r.vec_id: r.deviation for r in whitening.whiten(table(spark, rows)).collect()}
    assert got == expected([r for r in rows if r[0] != 3])[3]
    many = [(1, [1e14, 0.0]), (2, [-1e14, 1.0])]
    assert {r.deviation for r in whitening.whiten(table(spark, many)).collect()} == {None}


@pytest.mark.parametrize("rows", [[], [(1, None)], [(1, [1.0, 2.0]), (2, [1.0, 2.0])]])
def test_nothing_to_whiten(spark, rows):
    got = whitening.whiten(table(spark, rows))
    assert got.columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]
    assert got.count() == 0


def test_shifted_passes_recover_an_ill_conditioned_matrix(spark):
    """One Gram product loses directions below the root of the machine's precision; R keeps them."""
    rng = np.random.default_rng(9)
    q, _ = np.linalg.qr(rng.normal(size=(200, 4)))
    q -= q.mean(axis=0)
    a = np.rint(q * np.array([1e9, 1e6, 1e3, 3])) * 1.0
    rows = [(i, [float(c) for c in r]) for i, r in enumerate(a)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    fit = whitening.integers(df).select("x").distinct()
    x = np.array([r.x for r in fit.collect()], object)
    n, sums = len(x), [int(s) for s in x.sum(axis=0)]
    centre = whitening.Centre(n, sums)
    e, _ = whitening.fit_components(fit, centre)
    sigma = np.linalg.svd(centre.centred(x.astype(np.int64)), compute_uv=False)
    assert np.allclose(np.sqrt(e * n), sigma, rtol=1e-6)
