"""Closed forms against other ways to the same numbers: dense algebra, integrals, differences, brute force."""

import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from privspan.functions import numeric
from privspan.operators import asymptotic, blackbox, linear, relational, spectra


def _table(spark, n=30, d=2, seed=3):
    g = np.random.default_rng(seed)
    b, y = g.normal(size=(n, d)), g.normal(size=n)
    rows = [(i, *map(float, b[i]), float(y[i])) for i in range(n)]
    features = [f"x{j}" for j in range(d)]
    df = spark.createDataFrame(rows, ["row_id", *features, "y"])
    return df, linear.fit(df, features, "y"), b, y


def test_neighbours_by_dense_algebra(spark):
    """Coefficients, residual sums, covariances and their determinants without each row, from the matrix itself."""
    df, f, b, y = _table(spark)
    _, other = asymptotic.covariances(f)
    cells = {"rss": f.neighbor_rss(), "ratio": f.log_det_ratio(), **{f"b{j}": c for j, c in enumerate(f.neighbor_beta())}, **{f"c{i}{j}": other[i][j] for i in range(2) for j in range(2)}}
    assert f.gram @ f.beta == pytest.approx(b.T @ y)
    q = f.covariance(1)
    for r in f.rows(df).select("row_id", *[v.alias(k) for k, v in cells.items()]).collect():
        keep = np.arange(len(y)) != r.row_id
        beta = np.linalg.lstsq(b[keep], y[keep], rcond=None)[0]
        rss = ((y[keep] - b[keep] @ beta) ** 2).sum()
        cov = rss * np.linalg.inv(b[keep].T @ b[keep])
        assert [r.b0, r.b1] == pytest.approx(beta) and r.rss == pytest.approx(rss)
        assert [r.c00, r.c01, r.c10, r.c11] == pytest.approx(cov.ravel())
        assert r.ratio == pytest.approx(np.log(np.linalg.det(cov) / np.linalg.det(q)))
        fit = f.without(b[r.row_id], y[r.row_id])
        assert fit.beta == pytest.approx(beta) and fit.rss == pytest.approx(rss)


def test_a_row_that_holds_the_rank(spark):
    df = spark.createDataFrame([(0, 1.0, 0.0, 1.0), (1, 0.0, 1.0, 2.0), (2, 0.0, 2.0, 1.0)], ["row_id", "x0", "x1", "y"])
    with pytest.raises(np.linalg.LinAlgError):
        linear.fit(df, ["x0", "x1"], "y").without([1.0, 0.0], 1.0)
    assert linear.row_of(df, "row_id", 1, ["x0", "x1"]).tolist() == [0.0, 1.0]
    assert linear.kronecker_covariance(np.array([[2.0, 1.0], [1.0, 3.0]]), 2).tolist() == [[2, 1, 0, 0], [1, 3, 0, 0], [0, 0, 2, 1], [0, 0, 1, 3]]


def test_spectrum_of_one_feature_by_integration(spark):
    """Interval, means and variances give the hockey stick of the two normal outputs."""
    df, f, b, y = _table(spark, d=1)
    rows = spectra.sweep(f.rows(df), eps=[0.001, 0.05])
    x = np.linspace(-3, 3, 600_001)
    normal = lambda m, v: np.exp(-((x - m) ** 2) / (2 * v)) / np.sqrt(2 * np.pi * v)
    for r in asymptotic.spectrum_1d(rows, f, 20, "eps").collect():
        other = f.without(b[r.row_id], y[r.row_id])
        gap = normal(f.beta[0], f.covariance(20)[0, 0]) - np.exp(r.eps) * normal(other.beta[0], other.covariance(20)[0, 0])
        worth = float(np.maximum(gap, 0).sum() * (x[1] - x[0]))
        assert r.delta == pytest.approx(worth, abs=1e-6)


def test_log_ratio_of_outputs(spark):
    """threshold() less half of the quadratic form is the log ratio of the densities at a point, moved and scaled."""
    df, f, b, y = _table(spark)
    r, g = 20, np.random.default_rng(8)
    q = asymptotic.quadratic_form(f)
    own, _ = asymptotic.means(f, r)
    cells = {"a": asymptotic.threshold(f, r), "m0": own[0], "m1": own[1], "q00": q[0][0], "q01": q[0][1], "q11": q[1][1]}
    log = lambda z, m, c: -0.5 * (z - m) @ np.linalg.solve(c, z - m) - 0.5 * np.log(np.linalg.det(c))
    for row in f.rows(df).select("row_id", *[v.alias(k) for k, v in cells.items()]).collect():
        other = f.without(b[row.row_id], y[row.row_id])
        form = np.array([[row.q00, row.q01], [row.q01, row.q11]])
        for _ in range(3):
            z = f.beta + g.normal(size=2) * 0.1
            moved = np.sqrt(r) * (z - f.beta) + np.array([row.m0, row.m1])
            want = log(z, f.beta, f.covariance(r)) - log(z, other.beta, other.covariance(r))
            signs = [row.a - 0.5 * moved @ form @ moved, row.a + 0.5 * moved @ form @ moved]
            assert min(abs(s - want) for s in signs) < 1e-6 * max(1, abs(want))


@pytest.mark.parametrize("d, r, eps", list(itertools.product([2, 3, 5], [5, 50, 200], [0.01, 0.5, 1.0])))
def test_slopes_are_differences(d, r, eps):
    """A grid of leverages and shares; both integrations."""
    for p, s in itertools.product([0.01, 0.05, 0.2, 0.4], [0.005, 0.05, 0.2]):
        h = p * 1e-4
        want = (numeric.delta_left(p + h, p + h + s, d, r, eps)[0] - numeric.delta_left(p - h, p - h + s, d, r, eps)[0]) / (2 * h)
        assert numeric.slope_left(p, s, d, r, eps)[0] == pytest.approx(want, abs=2e-5, rel=2e-4)
        assert numeric.slope_left(p, s, d, r, eps, by_probability=True)[0] == pytest.approx(want, abs=2e-3, rel=2e-2)


def test_the_wider_normal_first_is_worse(spark):
    """Without a shift the spectrum from the wider to the narrower normal is at least the reverse, for eps >= 0."""
    grid = [(1.0 + a / 4, 1.0, e / 10) for a in range(1, 12) for e in range(0, 12)]
    rows = spark.createDataFrame(grid, "s1 double, s2 double, eps double").select(spectra.zero_mean("eps", "s1", "s2").alias("f"), spectra.zero_mean_reverse("eps", "s1", "s2").alias("r")).collect()
    assert all(x.f >= x.r - 1e-12 for x in rows)


@pytest.mark.parametrize("part", [7, 100_000])
def test_nearest_on_line_by_brute_force(spark, part):
    """Ties, a value that many points share, tests beyond both ends, parts smaller than k."""
    g = random.Random(9)
    train = [(i, g.choice([5.0, float(g.randrange(40)), g.uniform(0, 40)]), float(g.randrange(2))) for i in range(300)]
    test = [(i, g.choice([-3.0, 5.0, 60.0, g.uniform(0, 40)])) for i in range(80)]
    got = blackbox.nearest_on_line(spark.createDataFrame(train, "train_id long, v double, y double"), spark.createDataFrame(test, "test_id long, v double"), 9, part)
    want = {}
    for i, v in test:
        near = sorted(train, key=lambda t: (abs(t[1] - v), t[0]))[:9]
        want[i] = float(np.rint(np.mean([t[2] for t in near])))
    assert {r.test_id: r.predicted for r in got.collect()} == want


def test_median_and_numbers(spark, monkeypatch):
    monkeypatch.setattr(relational, "FEW", 3)
    monkeypatch.setattr(relational, "CELLS", 8)
    g = random.Random(2)
    for values in ([], [3.0], [1.0, 2.0], [g.gauss(0, 1) for _ in range(501)], [7.0] * 400 + [1.0] * 100, [g.choice([1e9, 1.0, 2.0, -5.0]) for _ in range(500)]):
        df = spark.createDataFrame([(v,) for v in [*values, None, float("nan")]], "v double")
        assert relational.exact_median(df, "v") == (None if not values else pytest.approx(float(np.median(values))))
    keys = [g.randrange(10_000) * 7 for _ in range(300)]
    rows = relational.numbered(spark.createDataFrame([(k,) for k in keys], "k long").repartition(5), "k", parts=6).collect()
    assert sorted(r.i for r in rows) == list(range(300)) and [r.k for r in sorted(rows, key=lambda r: r.i)] == sorted(keys)


def test_two_gaussians_in_either_order(spark):
    df = spark.createDataFrame([(2.0, 1.0, 0.3), (1.0, 2.0, 0.3), (1.5, 1.5, 0.7)], "a double, b double, m double")
    x, y, z = (r.d for r in df.select(spectra.two_gaussians(0.1, "a", "b", "m").alias("d")).collect())
    assert x == pytest.approx(y) and z == pytest.approx(df.where("a = b").select(spectra.mean_shift(0.1, 1.5, 0.7)).first()[0])
    assert spectra.mahalanobis(np.diag([4.0, 0.0]), [2.0, 0.0]) == 1.0 and spectra.mahalanobis(np.diag([4.0, 0.0]), [2.0, 1.0]) == np.inf
    assert df.select(F.max(spectra.same_covariance(0.1, np.diag([4.0, 0.0]), [2.0, 1.0]))).first()[0] == 1.0
