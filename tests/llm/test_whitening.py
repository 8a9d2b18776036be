import numpy as np
import pytest

from tidepool.llm import whitening as W

SCHEMA = "vec_id long, embedding array<float>, label int, n string, x string"


def frame(spark, rows):
    return spark.createDataFrame([(i, v, 0, "x", "y") for i, v in rows], SCHEMA).repartition(3)


def vectors(n, d=12, seed=0):
    rng = np.random.default_rng(seed)
    mix = rng.standard_normal((d, d)) * np.geomspace(0.3, 3, d)
    return (rng.standard_normal((n, d)) @ mix + rng.standard_normal(d)).astype(np.float32)


def check(spark, rows, components=16):
    """Against NumPy's own eigenvectors and exact sums."""
    x = [[int(np.floor(64 * np.float64(np.float32(c)))) + 1_000_000 for c in v] for _, v in rows]
    fit = np.array(sorted(set(map(tuple, x))), dtype=object)
    n, sums = len(fit), fit.sum(axis=0)
    y = (np.array(fit, float) - np.array(sums / n, float))
    cov = y.T @ y / n
    e, v = np.linalg.eigh(cov)
    e, v = e[::-1], v[:, ::-1]
    got = W.whiten(frame(spark, rows), components).collect()
    k = min(components, len(e))
    assert len(got) == len(rows) * k
    by = {}
    for r in got:
        by.setdefault(r["vec_id"], {})[r["component"]] = r
    for (i, _), own in zip(rows, x):
        deviation = sum((n * a - s) ** 2 for a, s in zip(own, sums))
        centred = np.array([float(n * a - s) / n for a, s in zip(own, sums)])
        for c in range(1, k + 1):
            r = by[i][c]
            assert (r["n"], r["deviation"]) == (n, deviation)
            assert r["explained"] == pytest.approx(e[c - 1] / np.trace(cov), rel=1e-9)
            assert abs(r["whitened"]) == pytest.approx(abs(centred @ v[:, c - 1]) / np.sqrt(e[c - 1]), abs=1e-8)
            assert r["identity_error"] < 1e-9
    # one sign for all rows
    for c in range(1, k + 1):
        own = np.array([by[i][c]["whitened"] for i, _ in rows])
        centred = np.array([[float(n * a - s) / n for a, s in zip(o, sums)] for o in x])
        want = centred @ v[:, c - 1] / np.sqrt(e[c - 1])
        assert np.allclose(own, want, atol=1e-8) or np.allclose(own, -want, atol=1e-8)


def test_equals_numpy(spark):
    rows = [(i, v.tolist()) for i, v in enumerate(vectors(300))]
    rows += [(1000 + i, v) for i, v in rows[:100]] + [(2000 + i, rows[0][1]) for i in range(200)]      # copies count once in the fit
    check(spark, rows, 5)


def test_all_components(spark):
    check(spark, [(i, v.tolist()) for i, v in enumerate(vectors(200, 20, 3))])


def test_bad_rows_are_left_out(spark):
    good = [(i, v.tolist()) for i, v in enumerate(vectors(40, 4))]
    bad = [(100, None), (101, []), (102, [1.0, None, 2.0, 3.0]), (103, [float("nan")] * 4), (104, [float("inf"), 0.0, 0.0, 0.0]), (105, [1.0, 2.0])]
    got = W.whiten(frame(spark, good + bad + [(None, good[0][1]), (1, good[1][1])])).collect()
    assert len(got) == (40 + 2) * 4 and {r["n"] for r in got} == {40}
    twice = [r["whitened"] for r in got if r["vec_id"] == 1 and r["component"] == 1]
    assert len(twice) == 2 and twice[0] == twice[1]
    assert sorted(r["component"] for r in got if r["vec_id"] is None) == [1, 2, 3, 4]


def test_components_without_variance(spark):
    one = W.whiten(frame(spark, [(1, [0.5, 0.25]), (2, [0.5, 0.25])])).collect()
    assert [(r["n"], r["deviation"], r["whitened"], r["explained"], r["identity_error"]) for r in one] == [(1, 0, None, None, 0.0)] * 4
    flat = W.whiten(frame(spark, [(i, [float(i), 1.0, 2.0]) for i in range(9)])).collect()
    assert all((r["whitened"] is None) == (r["component"] > 1) for r in flat) and max(r["identity_error"] for r in flat) < 1e-12
    assert W.whiten(frame(spark, [])).collect() == []
    huge = W.whiten(frame(spark, [(1, [3e38, 1.0]), (2, [-3e38, 2.0]), (3, [0.0, 5.0])])).collect()
    assert len(huge) == 6


@pytest.mark.parametrize("values", [[5, 4, 3, 2, 1], [1, 1, 1, 1], [3, 3, 3, 1, 1, 1], [1e6, 1, 1e-6, 0], [2, 1, 0, 0, 0, 0, 0],
                                    [1 + 1e-12, 1, 1 - 1e-12], [0, 0], [10, 0, -10], [7]])
def test_spectral_divide_and_conquer(values):
    rng = np.random.default_rng(1)
    q = np.linalg.qr(rng.standard_normal((len(values), len(values))))[0]
    a = q @ np.diag(np.array(values, float)) @ q.T
    e, v = W.eigen((a + a.T) / 2)
    scale = max(map(abs, values)) or 1
    assert np.allclose(e, sorted(values, reverse=True), atol=1e-12 * scale)
    assert np.allclose(v.T @ v, np.eye(len(values)), atol=1e-12)
    assert np.allclose(v @ np.diag(e) @ v.T, a, atol=1e-12 * scale)


def test_polar_factor_of_ill_conditioned_matrix():
    rng = np.random.default_rng(2)
    q = np.linalg.qr(rng.standard_normal((9, 9)))[0]
    values = np.array([1, 0.5, 1e-3, 1e-9, 1e-13, -1e-12, -1e-3, -0.5, -2])
    u = W.polar_factor(q @ np.diag(values) @ q.T)
    assert np.allclose(u @ u, np.eye(9), atol=1e-10)


def test_exact_products():
    rng = np.random.default_rng(3)
    for top in (10, 1 << 20, 1 << 26, 1 << 40):
        y = rng.integers(-top, top, (500, 3))
        want = [[sum(int(a) * int(b) for a, b in zip(y[:, i], y[:, j])) for j in range(3)] for i in range(3)]
        assert (W.exact_products(y) == np.array(want, object)).all()
