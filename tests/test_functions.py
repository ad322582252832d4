import math
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from privspan.functions import gx2, numeric, special
from privspan.operators import calibrate, spectra


def one(spark, *columns):
    return [float(x) for x in spark.range(1).select(*columns).first()]


def test_error_functions(spark):
    xs = [i / 37 - 8 for i in range(600)]
    rows = spark.createDataFrame([(x,) for x in xs], "x double").select("x", special.erf("x").alias("e"), special.erfc("x").alias("c")).collect()
    assert max(abs(r.e - math.erf(r.x)) for r in rows) < 1e-15
    assert max(abs(r.c / math.erfc(r.x) - 1) for r in rows) < 1e-13
    assert np.allclose(numeric.erfc(np.array(xs)), [math.erfc(x) for x in xs], rtol=1e-13, atol=0)


def test_quantile_inverts(spark):
    us = [10.0**-k for k in range(1, 15)] + [i / 100 for i in range(1, 100)]
    rows = spark.createDataFrame([(u,) for u in us], "u double").select("u", special.normal_quantile("u").alias("z")).collect()
    assert max(abs(0.5 * math.erfc(-r.z / math.sqrt(2)) / r.u - 1) for r in rows) < 1e-10


@pytest.mark.parametrize("nu, x, p", [(150, 100.0, 2.5037104e-06), (150, 160.0, 0.79963), (0.5, 1e-10, 1.1283791670579e-05), (1500, 1500.0, 0.50343327), (1, 1e-12, 9.999999999995e-13)])
def test_incomplete_gamma_of_many_terms(nu, x, p):
    """Against the finite sum with fractions where nu is whole, else the known value."""
    if nu == int(nu):
        top = Fraction(x)
        term, total = Fraction(1), Fraction(0)
        for k in range(int(nu)):
            total += term
            term = term * top / (k + 1)
        log = math.log(total.numerator) - math.log(total.denominator) - x
        q = math.exp(log)
        assert float(numeric.gamma_q(nu, x)) == pytest.approx(q, rel=1e-11)
    else:
        assert float(numeric.gamma_p(nu, x)) == pytest.approx(p, rel=1e-12)
    both = numeric.gamma_pq(nu, x)
    assert float(both[0] + both[1]) == pytest.approx(1, abs=1e-14)


def test_projections_of_many_rows(spark):
    """r = 82 and 300 by batches agree with the same spectrum by single values, and go on from r = 80."""
    df = spark.createDataFrame([(p,) for p in (0.0, 1e-4, 0.001, 0.01, 0.1, 0.5)], "p double")
    for r in (82, 300, 3000):
        rows = df.select("p", spectra.projection(0.1, "p", r).alias("delta")).collect()
        assert [x.delta for x in rows] == pytest.approx([numeric.projection_delta(0.1, x.p, r) for x in rows], abs=1e-14)
    a, b, c = (df.select(spectra.projection(0.1, "p", r).alias("delta")).collect() for r in (78, 80, 82))
    assert all(y.delta == pytest.approx((x.delta + z.delta) / 2, abs=2e-4) for x, y, z in zip(a, b, c))


@pytest.mark.parametrize("nu", [0.5, 1, 2.5, 15, 30.5])
def test_incomplete_gamma(spark, nu):
    xs = [0.0, 1e-8, 0.1, 1.0, 5.0, 20.0, 60.0]
    df = spark.createDataFrame([(x,) for x in xs], "x double")
    rows = df.select("x", special.gamma_q(nu, "x").alias("q"), special.gamma_p(nu, "x").alias("p"), special._gamma_q_series(F.lit(float(nu)), "x").alias("s")).collect()
    for r in rows:
        assert r.q == pytest.approx(r.s, abs=1e-13)
        assert r.q + r.p == pytest.approx(1, abs=1e-13)
        assert float(numeric.gamma_q(nu, r.x)) == pytest.approx(r.q, abs=1e-13)


def test_golden_spectra(spark):
    values = one(
        spark, spectra.mean_shift(1.0, 1.0), spectra.gaussian_mechanism(1.0, 1.0), spectra.mean_shift(1.0, 16.0, 1.0, 100.0), spectra.zero_mean(0.1, 2.0, 1.5),
        spectra.zero_mean_reverse(0.1, 2.0, 1.5), spectra.zero_mean(0.0, 2.0, 1.5), spectra.projection(1.0, 0.05, 30), spectra.projection(1.0, 0.2, 2),
        spectra.projection(1.0, 0.2, 10), spectra.projection(1.0, 0.2, 30), spectra.isotropic_scaling(1.0, 0.3, 10), spectra.two_variance(0.1, 2.0, 1.5, 1.0), spectra.two_variance_reverse(0.1, 2.0, 1.5, 1.0),
    )
    golden = [0.1269367375066439, 0.1269367375066439, 0.0231035362143624, 0.1157029863587985, 0.0790088238437945, 0.1382696320234030, 8.855090899680e-06, 0.00150041714, 0.02159294405, 0.10619001423, 0.9858235871266627, 0.2291148645, 0.1989129007]
    assert values == pytest.approx(golden, rel=1e-7)


def test_legacy_forms(spark):
    a, b, c, d = one(spark, spectra.zero_mean(0.0, 2.0, 1.5, legacy_eps0=True), spectra.projection_legacy(0.1, 0.3, 1), spectra.leverage_combination(0.1, 0.3), spectra.projection(0.1, 0.3, 1))
    assert a == 0
    assert b == pytest.approx(c) == pytest.approx(d)


def test_golden_quadrature():
    assert numeric.delta_right(0.02, 0.05, 5, 20, 0.1)[0] == pytest.approx(0.0158697251374, rel=1e-9)
    assert numeric.delta_left(0.02, 0.05, 5, 20, 0.1)[0] == pytest.approx(0.0128828544863, rel=1e-9)
    assert numeric.slope_left(0.3, 0.1, 5, 2, 0.5)[0] == pytest.approx(0.38937230, rel=1e-7)
    assert numeric.slope_left(0.1, 0.05, 3, 5, 0.1)[0] == pytest.approx(0.44914999, rel=1e-7)


@pytest.mark.parametrize("d", [2, 3, 10])
@pytest.mark.parametrize("s", [0.05, 0.3])
def test_slope_is_the_difference_quotient(d, s):
    p, h = 0.2 * (1 - s), 1e-5
    near = (numeric.delta_left(p + h, p + h + s, d, 3, 0.3) - numeric.delta_left(p - h, p - h + s, d, 3, 0.3)) / (2 * h)
    assert numeric.slope_left(p, s, d, 3, 0.3)[0] == pytest.approx(near[0], rel=1e-5, abs=1e-8)


def test_kernels_of_gaussians():
    for x, y, want in (((0, 4), (1, 2.25), 0.2291148645), ((1, 2.25), (0, 4), 0.1989129007)):
        a, b, c = numeric.kernel_of_gaussians(*x, *y)
        assert numeric.kernel_delta(a[0], b[0], c + 0.1) == pytest.approx(want, rel=1e-9)
    z = np.random.default_rng(0).normal(size=400_000)
    for a, b, c in ((1.5, 0.3, -0.7), (0.0, 0.3, 0.1), (1.0, 0.2, -0.3), (-2.0, 0.5, 0.4)):
        want = np.maximum(0, 1 - np.exp(np.minimum(a * z * z / 2 + b * z + c, 50))).mean()
        assert numeric.kernel_delta(a, b, c) == pytest.approx(want, abs=4e-3)


def test_calibrations():
    assert calibrate.minimal_c(1, 1e-3) == pytest.approx(0.3884012483387066, rel=1e-9)
    assert numeric.projection_delta(1.0, calibrate.leverage_bar(1.0, 1e-6, 10), 10) == pytest.approx(1e-6, rel=1e-3)
    sigma = calibrate.least_squares_sigma(1.0, 2, 20, 1.0, 1e-6)
    assert calibrate.least_squares_delta(1 / sigma**2, 2 / sigma**2, 2, 20, 1.0) == pytest.approx(1e-6, rel=1e-2)
    with pytest.raises(ValueError):
        calibrate.minimal_c(1, 1e-3, low=1.0, high=2.0)
    assert calibrate.ratio_for_delta(1e-4, 1.0, 10) > 1
    assert calibrate.bounded_leverage_sigma(1.0, 0.8, 2, 20, 1.0, 1e-6) > 0
    assert calibrate.fixed_residual_sigma(1.0, 10.0, 2, 20, 5.0, 1e-6) > 0


def test_convolved_losses_agree_with_the_closed_form():
    assert calibrate.fft_delta(1.0, 16.0, 100) == pytest.approx(0.0231035362143624, rel=1e-3)


@pytest.mark.parametrize("form", [np.diag([1, 2, 0.7]), np.array([[1, 0.2, 0], [0.2, -1.5, 0], [0, 0, 0.4]]), -np.eye(3)])
def test_quadratic_forms(form):
    mean, cov = np.array([0.5, -1, 0.2]), np.array([[2, 0.3, 0], [0.3, 1, 0.2], [0, 0.2, 0.5]])
    z = np.random.default_rng(0).multivariate_normal(mean, cov, 200_000)
    v = np.einsum("ni,ij,nj->n", z, form, z)
    found = gx2.parameters(mean, cov, form)
    for x in np.quantile(v, [0.1, 0.5, 0.9]):
        assert gx2.cdf(x, *found) == pytest.approx((v <= x).mean(), abs=5e-3)
        assert gx2.imhof(x, *found)[0] == pytest.approx(float(gx2.cdf(x, *found)), abs=1e-6)


def test_slope_by_probability():
    assert numeric.slope_left(0.3, 0.1, 5, 2, 0.5, by_probability=True)[0] == pytest.approx(0.38937230, rel=1e-5)


def test_calibration_of_rows(spark):
    assert one(spark, spectra.minimal_c(1.0, 1e-3))[0] == pytest.approx(0.3884012483387066, rel=1e-9)
