"""Special functions as Columns: deterministic, within generated code, usable under aggregates.

erf and erfc are the rational approximations of W. J. Cody (Mathematics of Computation 23, 1969).
Q(nu, x), the regularised upper incomplete gamma function, is a finite sum for whole and half nu.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from functools import reduce

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

# Cody's coefficients, numerators and denominators from the highest power down.
ERF_P = (1.85777706184603153e-1, 3.16112374387056560e0, 1.13864154151050156e2, 3.77485237685302021e2, 3.20937758913846947e3)
ERF_Q = (1.0, 2.36012909523441209e1, 2.44024637934444173e2, 1.28261652607737228e3, 2.84423683343917062e3)
ERFC_P = (
    2.15311535474403846e-8, 5.64188496988670089e-1, 8.88314979438837594e0, 6.61191906371416295e1, 2.98635138197400131e2,
    8.81952221241769090e2, 1.71204761263407058e3, 2.05107837782607147e3, 1.23033935479799725e3,
)
ERFC_Q = (
    1.0, 1.57449261107098347e1, 1.17693950891312499e2, 5.37181101862009858e2, 1.62138957456669019e3,
    3.29079923573345963e3, 4.36261909014324716e3, 3.43936767414372164e3, 1.23033935480374942e3,
)
TAIL_P = (1.63153871373020978e-2, 3.05326634961232344e-1, 3.60344899949804439e-1, 1.25781726111229246e-1, 1.60837851487422766e-2, 6.58749161529837803e-4)
TAIL_Q = (1.0, 2.56852019228982242e0, 1.87295284992346725e0, 5.27905102951428412e-1, 6.05183413124413191e-2, 2.33520497626869185e-3)

SQRT_PI = math.sqrt(math.pi)
#: Q(nu, x) is written out up to this nu; beyond it an Arrow function sums.
MOST_TERMS = 40


def _poly(coefficients, x: Column) -> Column:
    return reduce(lambda a, c: a * x + F.lit(c), coefficients[1:], F.lit(coefficients[0]))


def col(x) -> Column:
    return x if isinstance(x, Column) else F.col(x) if isinstance(x, str) else F.lit(float(x))


def let(value: Column, f: Callable[[Column], Column]) -> Column:
    """f(value) with value written and evaluated once; nested forms stay small."""
    return F.element_at(F.transform(F.array(value), f), 1)


def erfc(x) -> Column:
    """Complementary error function; null for null, NaN for NaN."""
    return let(col(x), _erfc)


def _erfc(x: Column) -> Column:
    a = F.abs(x)
    small = F.least(a, F.lit(0.5))
    inner = F.lit(1.0) - x * _poly(ERF_P, small * small) / _poly(ERF_Q, small * small)
    middle = F.exp(-a * a) * _poly(ERFC_P, a) / _poly(ERFC_Q, a)
    far = F.greatest(a, F.lit(4.0))
    z = F.lit(1.0) / (far * far)
    tail = F.exp(-far * far) / far * (F.lit(1 / SQRT_PI) - z * _poly(TAIL_P, z) / _poly(TAIL_Q, z))
    upper = F.when(a <= 4.0, middle).otherwise(tail)
    return F.when(F.isnan(x), x).when(a <= 0.46875, inner).when(x > 0, upper).otherwise(F.lit(2.0) - upper)


def erf(x) -> Column:
    return let(col(x), _erf)


def _erf(x: Column) -> Column:
    small = F.least(F.abs(x), F.lit(0.5))
    inner = x * _poly(ERF_P, small * small) / _poly(ERF_Q, small * small)
    return F.when(F.abs(x) <= 0.46875, inner).otherwise(F.lit(1.0) - _erfc(x))


def normal_cdf(x) -> Column:
    return F.lit(0.5) * erfc(-col(x) / math.sqrt(2))


def normal_sf(x) -> Column:
    return F.lit(0.5) * erfc(col(x) / math.sqrt(2))


def normal_pdf(x) -> Column:
    x = col(x)
    return F.exp(F.lit(-0.5) * x * x) / math.sqrt(2 * math.pi)


# P. J. Acklam's rational start for the inverse normal distribution function.
INV_A = (-3.969683028665376e1, 2.209460984245205e2, -2.759285104469687e2, 1.383577518672690e2, -3.066479806614716e1, 2.506628277459239e0)
INV_B = (-5.447609879822406e1, 1.615858368580409e2, -1.556989798598866e2, 6.680131188771972e1, -1.328068155288572e1, 1.0)
INV_C = (-7.784894002430293e-3, -3.223964580411365e-1, -2.400758277161838e0, -2.549732539343734e0, 4.374664141464968e0, 2.938163982698783e0)
INV_D = (7.784695709041462e-3, 3.224671290700398e-1, 2.445134137142996e0, 3.754408661907416e0, 1.0)


def normal_quantile(u) -> Column:
    """Inverse normal distribution function on (0, 1): a rational start and one step of Halley's method."""
    return let(F.least(F.greatest(col(u), F.lit(1e-300)), F.lit(1 - 2.0**-53)), _normal_quantile)


def _normal_quantile(u: Column) -> Column:
    low, high = F.sqrt(F.lit(-2.0) * F.ln(u)), F.sqrt(F.lit(-2.0) * F.ln(F.lit(1.0) - u))
    q = u - 0.5
    mid = q * _poly(INV_A, q * q) / _poly(INV_B, q * q)
    start = F.when(u < 0.02425, _poly(INV_C, low) / _poly(INV_D, low)).when(u > 1 - 0.02425, -_poly(INV_C, high) / _poly(INV_D, high)).otherwise(mid)

    def better(start: Column) -> Column:
        e = F.when(start < 0, normal_cdf(start) - u).otherwise((F.lit(1.0) - u) - normal_sf(start))
        return let(e * math.sqrt(2 * math.pi) * F.exp(start * start / 2), lambda step: start - step / (F.lit(1.0) + start * step / 2))

    return let(start, better)


@F.pandas_udf(DoubleType())
def _gamma_q_series(nu: pd.Series, x: pd.Series) -> pd.Series:
    """Q(nu, x) of a batch, all of its rows at once."""
    from privspan.functions.numeric import gamma_pq

    out = pd.Series(0.0, index=x.index)
    for value in nu.unique():
        own = nu == value
        out[own] = gamma_pq(float(value), x[own].to_numpy())[1]
    return out


def gamma_q(nu: float, x) -> Column:
    """Regularised upper incomplete gamma function; 1 for x <= 0."""
    z = F.greatest(col(x), F.lit(0.0))
    if nu > MOST_TERMS or (2 * nu) % 1:
        return _gamma_q_series(F.lit(float(nu)), z)
    return let(z, lambda z: _gamma_q(nu, z))


def _gamma_q(nu: float, z: Column) -> Column:
    n = int(nu)
    if nu == n:
        # 1 + x/1 (1 + x/2 (1 + ...)): n terms.
        inner = reduce(lambda a, k: F.lit(1.0) + z / k * a, [float(k) for k in range(n - 1, 0, -1)], F.lit(1.0))
        return F.exp(-z) * inner
    # sqrt(x) / Gamma(3/2) (1 + x/1.5 (1 + x/2.5 (...))): n terms beside erfc(sqrt(x)).
    inner = reduce(lambda a, k: F.lit(1.0) + z / k * a, [k + 0.5 for k in range(n - 1, 0, -1)], F.lit(1.0))
    rest = F.exp(-z) * F.sqrt(z) * (2 / SQRT_PI) * inner if n else F.lit(0.0)
    return erfc(F.sqrt(z)) + rest


def gamma_p(nu: float, x) -> Column:
    """1 - Q, without cancellation for small x: the lower series where x < nu + 1."""
    return let(F.greatest(col(x), F.lit(0.0)), lambda z: _gamma_p(nu, z))


def _gamma_p(nu: float, z: Column) -> Column:
    small = F.least(z, F.lit(nu + 1.0))
    inner = reduce(lambda a, k: F.lit(1.0) + small / (nu + k) * a, range(60, 0, -1), F.lit(1.0))
    front = F.when(z > 0, F.exp(F.lit(float(nu)) * F.ln(F.greatest(small, F.lit(1e-300))) - small - math.lgamma(nu + 1))).otherwise(0.0)
    return F.when(z < nu + 1, front * inner).otherwise(F.lit(1.0) - _gamma_q(nu, z))
