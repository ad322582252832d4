"""Tails of quadratic forms by contours, against closed forms, other methods and the quadrature of spectra."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from privspan.functions import gx2, numeric
from privspan.operators import quadratic_forms


@pytest.mark.parametrize("r", [1, 2, 3, 6, 300, 3000])
def test_one_weight_has_the_incomplete_gamma_function(r):
    g = np.random.default_rng(r)
    w, x = np.abs(g.normal(size=(500, 1))) + 0.01, g.exponential(size=500) * 2
    above, below, error = gx2.tails(x * r * w[:, 0], w, r)
    assert above == pytest.approx(numeric.gamma_q(r / 2, x * r / 2), abs=2e-12) and (error < 1e-8).all()
    assert above + below == pytest.approx(np.ones(500), abs=1e-12)
    mirrored, _, _ = gx2.tails(-x * r * w[:, 0], -w, r)
    assert mirrored == pytest.approx(below, abs=1e-12)
    far = gx2.tails(np.array([1200.0]), np.ones((1, 1)), 2)[0]
    assert far == pytest.approx(np.exp(-600.0), rel=1e-9)


@pytest.mark.parametrize("seed", range(6))
def test_any_signs_with_a_normal_part_equal_imhof(seed):
    g = np.random.default_rng(seed)
    w, shift, x = g.normal(size=2), np.abs(g.normal(size=2)), g.normal(size=40) * 3
    want = gx2.imhof(x, w, [1, 2], shift, 0, 0.5)
    weights, linear = np.tile([*w, 0.0], (40, 1)), np.tile([*(2 * w * np.sqrt(shift)), 0.5], (40, 1))
    _, below, error = gx2.tails(x - w @ shift, weights, [1, 2, 1], linear)
    assert below == pytest.approx(want, abs=1e-9) and (error < 1e-7).all()


def test_degenerate_forms():
    x = np.array([0.0, 1.0, -1.0, np.nan, np.inf, 0.5, -0.5])
    w = np.array([[0.0], [0.0], [0.0], [1.0], [1.0], [-1.0], [1.0]])
    above, below, error = gx2.tails(x, w, 1)
    assert above[[0, 1, 2]].tolist() == [0, 0, 1] and np.isnan(above[[3, 4]]).all()
    assert above[5] == 0 and below[6] == 0 and error[[0, 1, 2, 5, 6]].tolist() == [0] * 5
    assert all(len(v) == 0 for v in gx2.tails(np.zeros(0), np.zeros((0, 2)), 3))


@pytest.mark.parametrize("d", [2, 3, 7])
def test_spectra_equal_the_quadrature(d):
    g = np.random.default_rng(d)
    p = 10 ** g.uniform(-6, -0.3, 1000)
    q = p + (1 - p) * 10 ** g.uniform(-7, -0.2, 1000)
    for kernel, quadrature in ((numeric.left_kernel, numeric.delta_left), (numeric.right_kernel, numeric.delta_right)):
        value, error = quadratic_forms.exchange_deltas(*kernel(p, q, d, 20, 0.01)[:4], d, np.full(1000, 0.01))
        assert (error < 1e-7).all()
        # The rule itself is off by about 1e-8 where q - p is small.
        assert value == pytest.approx(quadrature(p, q, d, 20, 0.01, 64), abs=4e-8)
        wide = q - p > 1e-3
        assert value[wide] == pytest.approx(quadrature(p[wide], q[wide], d, 20, 0.01, 256), abs=1e-9)


def test_forms_of_rows_equal_drawn_ones(spark):
    g = np.random.default_rng(1)
    rows, want = [], []
    for i in range(5):
        mean, half, form = g.normal(size=3), g.normal(size=(3, 3)), g.normal(size=(3, 3))
        covariance, form = half @ half.T, form + form.T
        drawn = g.multivariate_normal(mean, covariance, 200_000)
        rows.append((i, 0.5, mean.tolist(), covariance.ravel().tolist(), form.ravel().tolist()))
        want.append((np.einsum("ni,ij,nj->n", drawn, form, drawn) <= 0.5).mean())
    rows += [(5, None, *rows[0][2:]), (6, 0.5, None, *rows[0][3:]), (7, 0.5, [1.0, None, 0.0], *rows[0][3:]), (8, float("nan"), *rows[0][2:]), (9, 0.5, [1.0], *rows[0][3:])]
    rows += [(10, 0.5, [0.5, 0.0, 0.0], [0.0] * 9, [1.0, *[0.0] * 8]), (11, 0.2, [0.5, 0.0, 0.0], [0.0] * 9, [1.0, *[0.0] * 8])]
    df = spark.createDataFrame(rows, "id int, x double, m array<double>, c array<double>, f array<double>")
    found = {r.id: r.s for r in df.select("id", quadratic_forms.distribution("x", "m", "c", "f", 3).alias("s")).collect()}
    for i in range(5):
        assert found[i].below == pytest.approx(want[i], abs=0.005) and found[i].error < 1e-7
    assert all(found[i].below is None and found[i].error is None for i in range(5, 10))
    assert found[10].below == 1 and found[11].below == 0
    assert df.limit(0).select(quadratic_forms.distribution("x", "m", "c", "f", 3)).count() == 0


def test_spectra_outside_of_their_bounds_are_null(spark):
    df = spark.createDataFrame([(0.1, 0.2), (0.2, 0.1), (0.0, 0.5), (0.5, 1.0), (None, 0.5), (float("nan"), 0.5)], "p double, q double")
    found = [r.s for r in df.select(quadratic_forms.least_squares("p", "q", 3, 20, F.lit(0.01)).alias("s")).collect()]
    assert 0 < found[0].left < 1 and 0 < found[0].right < 1
    assert all(s is None or (s.left is None and s.right is None) for s in found[1:])


def test_tails_below_the_smallest_double_need_no_contour(monkeypatch):
    """exp(-x / 2) at x = 1,480 is still a number; at 2,000 it is none and Chernoff's bound says so."""
    above, below, error = gx2.tails(np.array([1400.0, 1480.0]), np.ones((2, 1)), 2)
    assert above == pytest.approx(np.exp([-700.0, -740.0]), rel=1e-3, abs=0) and (below == 1).all() and (error < 1e-300).all()
    monkeypatch.setattr(gx2, "_along", None)
    above, below, error = gx2.tails(np.array([2000.0, 1e7]), np.array([[1.0, 0.5], [1.0, -2.0]]), np.array([2.0, 3.0]))
    assert (above == 0).all() and (below == 1).all() and (error == 0).all()


def test_half_the_points_do_where_they_are_close(monkeypatch):
    """Points between are added only where two spacings differ, and give the same values."""
    g = np.random.default_rng(11)
    x, w = g.normal(size=300) * 4, g.normal(size=(300, 3))
    few = gx2.tails(x, w, 2)
    monkeypatch.setattr(gx2, "LOST", -1.0)
    whole, logs = np.log, []
    monkeypatch.setattr(gx2.np, "log", lambda v: logs.append(np.size(v) if np.iscomplexobj(v) else 0) or whole(v))
    assert gx2.tails(x, w, 2)[0] == pytest.approx(few[0], abs=1e-13)
    every = sum(logs)
    monkeypatch.setattr(gx2, "LOST", 1e-19)
    logs.clear()
    gx2.tails(x, w, 2)
    assert sum(logs) < every and sum(logs) < 0.8 * 300 * 3 * gx2.CONTOUR
