"""Counts of resampled rows: an exact multinomial, whatever the parts and the order of rows."""

import math

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from privspan.operators import accuracy, resampling


@settings(max_examples=200, deadline=None)
@given(st.integers(1, 400), st.floats(0.01, 0.99))
def test_probabilities_of_a_binomial(m, p):
    got = resampling._probabilities(np.arange(-1, m + 2), np.array([m]), np.array([p]))
    want = [math.exp(math.lgamma(m + 1) - math.lgamma(k + 1) - math.lgamma(m - k + 1) + k * math.log(p) + (m - k) * math.log1p(-p)) for k in range(m + 1)]
    assert got[0] == got[-1] == 0 and got[1:-1] == pytest.approx(want, rel=1e-9, abs=1e-300)


def test_large_binomials_keep_their_precision():
    m, p = 10**9, 0.4999
    sd = math.sqrt(m * p * (1 - p))
    k = np.arange(int(m * p - 12 * sd), int(m * p + 12 * sd))
    q = resampling._probabilities(k, np.array([m]), np.array([p]))
    assert q.sum() == pytest.approx(1, abs=1e-12)
    assert (q * (k - m * p)).sum() == pytest.approx(0, abs=1e-6 * sd) and (q * (k - m * p) ** 2).sum() == pytest.approx(sd * sd, rel=1e-9)
    x = resampling.binomial(np.array([0.5, 1e-15, 1 - 1e-15, 0.5, 0.5]), np.array([m, m, m, 0, 1]), np.array([p, p, p, 0.5, 0.25]))
    assert abs(x[0] - m * p) < 2 and abs((x[1] - m * p) / sd + 7.94) < 0.05 and abs((x[2] - m * p) / sd - 7.94) < 0.05 and list(x[3:]) == [0, 0]


@pytest.mark.parametrize("n", [1, 2, 3, 1000, 1537])
def test_counts_add_up_and_do_not_hang_on_the_parts(n, monkeypatch):
    whole = resampling.counts("k", resampling.parts("k", n, 30), np.arange(n))
    assert (whole.sum(0) == n).all()
    monkeypatch.setattr(resampling, "PART", 10)
    monkeypatch.setattr(resampling, "CELLS", 500)
    top = resampling.parts("k", n, 30)
    assert top.size.sum() == n and (top.draws.sum(0) == n).all()
    some = np.random.default_rng(1).permutation(n)[: max(n // 3, 1)]
    assert (resampling.counts("k", top, some) == whole[some]).all()


def test_counts_have_the_moments_of_a_multinomial():
    n, reps = 50, 20_000
    c = resampling.counts("k", resampling.parts("k", n, reps), np.arange(n))
    assert abs(c.mean(1) - 1).max() < 5 * math.sqrt(1 / reps)
    cov = np.cov(c)
    assert abs(np.diag(cov) - (1 - 1 / n)).max() < 0.06
    assert abs(cov[np.triu_indices(n, 1)] + 1 / n).max() < 0.05 and cov[np.triu_indices(n, 1)].mean() == pytest.approx(-1 / n, abs=2e-3)
    assert (c == 0).mean() == pytest.approx((1 - 1 / n) ** n, abs=3e-3)


def test_resamples_of_a_table(spark):
    v = np.random.default_rng(2).normal(3, 1, 501)
    df = spark.createDataFrame([(i, float(x) if i % 9 else None) for i, x in enumerate(v)], "i long, v double")
    a = {r.rep: (r.m, r.n) for r in resampling.resampled_means(df, "i", "v", 501, 40, "k").collect()}
    b = {r.rep: (r.m, r.n) for r in resampling.resampled_means(df.orderBy(F.rand(1)).repartition(5), "i", "v", 501, 40, "k").collect()}
    c = resampling.counts("k", resampling.parts("k", 501, 40), np.arange(501))
    known = np.arange(501) % 9 > 0
    for rep in range(40):
        assert a[rep][1] == 501 and a[rep] == pytest.approx(b[rep])
        assert a[rep][0] == pytest.approx((c[known, rep] * v[known]).sum() / c[known, rep].sum())
    plan = resampling.resampled_means(df, "i", "v", 501, 40, "k")._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan


def test_bounds_of_odd_tables(spark):
    one = accuracy.bootstrap_bounds(spark.createDataFrame([(0, 2.5)], "i long, v double"), "i", "v", 0.9, 10, "k").collect()
    assert [tuple(r) for r in one] == [(2.5,) * 4]
    assert accuracy.bootstrap_bounds(spark.createDataFrame([], "i long, v double"), "i", "v", 0.9, 10, "k").collect() == []
    assert accuracy.bootstrap_bounds(spark.createDataFrame([(0, None)], "i long, v double"), "i", "v", 0.9, 10, "k").collect() == []
    for keys in ([0, 2], [1, 2], [0, None]):
        with pytest.raises(ValueError, match="number"):
            accuracy.bootstrap_bounds(spark.createDataFrame([(k, 1.0) for k in keys], "i long, v double"), "i", "v", 0.9, 10, "k")
