"""Sets of rows against dense algebra and closed forms, and tails of weighted chi squares."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from privspan.functions import gx2, numeric
from privspan.operators import row_sets


@pytest.mark.parametrize("r", [1, 2, 4, 6, 10, 300])
def test_tails_of_one_weight_are_within_their_bound(r):
    g = np.random.default_rng(r)
    w, x = np.abs(g.normal(size=(50, 1))) + 0.01, np.abs(g.normal(size=50)) * r
    value, bound = gx2.upper_tails(x, w, r)
    assert (np.abs(value - numeric.gamma_q(r / 2, x / w[:, 0] / 2)) <= bound + 1e-13).all()
    assert (bound < 3e-11).all() or r < 6
    mirrored, _ = gx2.upper_tails(-x, -w, r)
    assert mirrored == pytest.approx(1 - value, abs=1e-10 if r > 4 else 1e-5)


def test_tails_of_several_weights():
    # With two degrees of freedom each term is exponential: partial fractions, with six those of its third power by folding.
    w = np.array([[1.0, 0.5, 0.1], [2.0, 0.3, 0.001], [0.0, 0.0, 0.0], [1.0, 1.0, 1.0], [1.0, -1.0, 0.0]])
    x = np.array([20.0, 9.0, 0.0, 18.0, 0.0])
    value, _ = gx2.upper_tails(x, w, 6)
    assert value[2] == 0 and value[3] == pytest.approx(float(numeric.gamma_q(9.0, 9.0)), abs=1e-10) and value[4] == pytest.approx(0.5, abs=1e-10)
    nodes, parts = np.polynomial.legendre.leggauss(200)
    y = 60 * (nodes + 1)
    dense = lambda y: y * y * np.exp(-y / 2) / 16
    for row in (0, 1):
        a, b, c = w[row]
        rest = np.maximum(x[row] - b * y[:, None] - c * y[None], 0)
        want = (numeric.gamma_q(3.0, rest / a / 2) * (60 * parts * dense(y))[:, None] * (60 * parts * dense(y))[None]).sum()
        assert value[row] == pytest.approx(float(want), abs=2e-6)
    empty, bound = gx2.upper_tails(np.zeros(0), np.zeros((0, 3)), 6)
    assert len(empty) == len(bound) == 0


@pytest.mark.parametrize("first, second", [(0.0, 0.0), (1.0, 1.0), (0.5, 2.0)])
def test_sets_equal_dense_algebra(spark, first, second):
    g = np.random.default_rng(3)
    x, group = g.normal(size=(300, 3)) * [1, 5, 0.1], g.integers(0, 20, 300)
    rows = spark.createDataFrame([(int(k), *map(float, v)) for k, v in zip(group, x)], "g int, a double, b double, c double")
    found = {r.g: r for r in row_sets.set_spectra(rows, "g", ["a", "b", "c"], 10, 0.1, first, second).collect()}
    assert found.keys() == set(group.tolist())
    whole = x.T @ x + first * np.eye(3)
    for k, r in found.items():
        other = x[group != k]
        other = other.T @ other + second * np.eye(3)
        shares = 1 - np.linalg.eigvals(np.linalg.solve(whole, other)).real
        assert r.shares == pytest.approx(sorted(shares, reverse=True), abs=1e-9) and r.n == (group == k).sum()
        assert r.log_det == pytest.approx(math.log(np.linalg.det(whole) / np.linalg.det(other)), abs=1e-9)
        # The loss drawn: rows of the table's Gaussian and of its neighbour's.
        z = g.chisquare(10, size=(200_000, 3))
        loss = lambda y: 5 * np.log(1 - shares).sum() + (y * (1 / (1 - shares) - 1)).sum(1) / 2
        for value, l in ((r.delta, loss(z)), (r.back, -loss(z * (1 - shares)))):
            assert value == pytest.approx(np.maximum(0, 1 - np.exp(0.1 - l)).mean(), abs=0.006)
        assert r.error < 1e-9


def test_one_column_has_the_closed_form(spark):
    rows = spark.createDataFrame([(i % 7, float(i + 1)) for i in range(100)], "g int, a double")
    total = sum((i + 1.0) ** 2 for i in range(100))
    for r in row_sets.set_spectra(rows, "g", ["a"], 10, 0.01, 3.0, 3.0).collect():
        own = sum((i + 1.0) ** 2 for i in range(100) if i % 7 == r.g)
        assert r.delta == pytest.approx(float(numeric.ratio_delta(0.01, (total + 3) / (total - own + 3), 10)), abs=1e-9)


def test_odd_sets(spark):
    schema = "g string, a double, b double"
    rows = [("x", 1.0, 2.0), ("y", 3.0, None), ("y", float("nan"), 1.0), (None, 2.0, 1.0), ("z", 0.0, 0.0), ("x", 0.5, 0.1)]
    found = {r.g: r for r in row_sets.set_spectra(spark.createDataFrame(rows, schema), "g", ["a", "b"], 6, 0.1, 1.0, 1.0).collect()}
    assert found.keys() == {"x", None, "z"} and found["x"].n == 2
    assert found["z"].shares == [0.0, 0.0] and found["z"].delta == 0 and found["z"].log_det == 0
    # Without anything added the only set that reaches a direction leaves nothing of it.
    alone = {r.g: r for r in row_sets.set_spectra(spark.createDataFrame([("x", 1.0, 0.0), ("y", 0.0, 1.0)], schema), "g", ["a", "b"], 6, 0.1).collect()}
    assert alone["x"].delta == alone["x"].back == 1 and alone["x"].log_det is None
    assert row_sets.set_spectra(spark.createDataFrame([], schema), "g", ["a", "b"], 6, 0.1).count() == 0
    with pytest.raises(Exception, match="(?i)positive definite"):
        row_sets.set_spectra(spark.createDataFrame([("x", 1.0, 1.0), ("y", 2.0, 2.0)], schema).withColumn("b", F.col("a")), "g", ["a", "b"], 6, 0.1).collect()
