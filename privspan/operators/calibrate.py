"""Noise levels for a target (eps, delta): bisections of a few dozen scalar steps on the driver."""

from __future__ import annotations

import math

import numpy as np

from privspan.functions.numeric import bisect, delta_left, delta_right, gaussian_delta, normal_cdf, projection_delta

NEAR_ONE = 1 - 1e-8


def minimal_c(eps: float, delta: float, low: float = 1e-6, high: float = 1e2, tol: float = 1e-12) -> float:
    """Sensitivity over noise at which the Gaussian mechanism reaches delta."""
    return bisect(lambda c: gaussian_delta(eps, c), low, high, delta, tol)


def gaussian_sigma(sensitivity: float, eps: float, delta: float) -> float:
    return sensitivity / minimal_c(eps, delta)


def leverage_bar(eps: float, delta: float, r: int, low: float = 1e-6, high: float = 1 - 1e-6, tol: float = 1e-9) -> float:
    """Largest leverage whose projection spectrum stays within delta."""
    return bisect(lambda s: projection_delta(eps, s, r), low, high, delta, tol)


def projection_sigma(l2: float, eps: float, delta: float, r: int) -> float:
    """Noise for rows no longer than l2: with it no leverage passes leverage_bar."""
    return l2 / math.sqrt(leverage_bar(eps, delta, r))


def tested_projection_sigma(least_eigenvalue: float, l2: float, eps: float, delta: float, r: int, laplace_unit: float, share: float = 0.5) -> float:
    """Propose, test, release: noise that is still needed beyond a private lower bound of the least eigenvalue.

    laplace_unit is a Laplace draw of scale one; share of eps and half of delta pay for the test.
    """
    test = share * eps
    lower = max(least_eigenvalue + l2 * l2 / test * laplace_unit - l2 * l2 / test * math.log(1 / delta), 0.0)
    return math.sqrt(max(l2 * l2 / leverage_bar(eps - test, delta / 2, r) - lower, 0.0))


def _pair(p: float, q: float) -> tuple[float, float]:
    """0 < p < q < 1, as the kernels need it."""
    p = min(max(p, 1e-12), NEAR_ONE - 1e-9)
    return p, min(max(q, p + 1e-12), NEAR_ONE)


def least_squares_delta(p: float, q: float, d: int, r: int, eps: float) -> float:
    """The worse direction of the least-squares spectrum."""
    p, q = _pair(p, q)
    return float(max(delta_left(p, q, d, r, eps)[0], delta_right(p, q, d, r, eps)[0]))


def least_squares_sigma(l2: float, d: int, r: int, eps: float, delta: float, low: float = 1e-3, high: float = 1e2, tol: float = 1e-6) -> float:
    """Noise that bounds leverage by l2^2 / sigma^2 and augmented leverage by twice that."""

    def at(sigma: float) -> float:
        x = l2 * l2 / (sigma * sigma)
        return least_squares_delta(min(x, NEAR_ONE), min(2 * x, NEAR_ONE), d, r, eps)

    return bisect(at, low, max(high, 2 * l2), delta, tol, increasing=False)


def shrunk_leverage(l2: float, leverage: float, sigma: float) -> float:
    """Leverage after noise rows, of a row of length l2."""
    return leverage * l2 * l2 / (sigma * sigma * leverage + l2 * l2)


def bounded_leverage_sigma(l2: float, leverage: float, d: int, r: int, eps: float, delta: float, low: float = 1e-3, high: float = 1e2, tol: float = 1e-3) -> float:
    """Noise if leverages are known to be at most `leverage`; the left direction decides."""

    def at(sigma: float) -> float:
        p = shrunk_leverage(l2, leverage, sigma)
        return float(delta_left(*_pair(p, min(2 * p, NEAR_ONE)), d, r, eps)[0])

    return bisect(at, low, high, delta, tol, increasing=False)


def fixed_residual_sigma(l2: float, rho: float, d: int, r: int, eps: float, delta: float, low: float = 1e-3, high: float = 1e3, tol: float = 1e-3) -> float:
    """Noise if a row with target rho and zero features keeps the residual at rho or more."""
    share = 1 / (1 + rho * rho)

    def at(sigma: float) -> float:
        p = l2 * l2 / (sigma * sigma + l2 * l2)
        return float(delta_left(*_pair(p, p + share), d, r, eps)[0])

    return bisect(at, low, high, delta, tol, increasing=False)


def ratio_for_delta(delta: float, eps: float, r: int, low: float = 1 + 1e-6, high: float = 2.0) -> float:
    """Ratio of variances whose projection spectrum is delta."""
    return bisect(lambda rho: projection_delta(eps, 1 - 1 / rho, r), low, high, delta, 1e-12)


def information_eps(eps: float, delta: float) -> float:
    """Bits of mutual information that (eps, delta) implies, by way of (0, delta')."""
    total = 2 * (1 - delta) / (math.exp(eps) + 1)
    return total * total * math.log2(math.e) / 2


def tight_terms(gamma: float, n1: int, n2: int, d: int) -> tuple[float, float]:
    """The two errors of an accuracy estimated by nearest neighbours on n1 and tested on n2 samples."""
    c = (1 + 2 / math.sqrt(2 - math.sqrt(3))) ** d - 1
    return 12 * c * math.sqrt(math.log(4 / gamma) / (2 * n1)), math.sqrt(math.log(4 / gamma) / (2 * n2))


def tight_bound(gamma: float, n1: int, n2: int, d: int, eps: float) -> float:
    return 2 * math.exp(eps) * sum(tight_terms(gamma, n1, n2, d))


def odd_neighbours(n: int, d: int, method: str = "sqrt") -> int:
    """ceil(sqrt n), or floor(n^(2 / (d + 2))); made odd."""
    k = math.ceil(math.sqrt(n)) if method == "sqrt" else math.floor(n ** (2 / (d + 2)))
    return k + (k % 2 == 0)


def fft_delta(eps: float, sigma: float, k: int, mu: float = 1.0, grid: int = 1 << 16, width: float | None = None) -> float:
    """k-fold mean shift by convolving the discretised privacy loss k times, in one transform."""
    mean, sd = mu * mu / (2 * sigma * sigma), mu / sigma
    width = width or 2 * (abs(k * mean) + 12 * math.sqrt(k) * sd + 12 * sd)
    step = width / grid
    edges = (np.arange(grid + 1) - grid / 2 - 0.5) * step
    mass = np.diff(normal_cdf((edges - mean) / sd))
    folded = np.fft.irfft(np.fft.rfft(np.fft.ifftshift(mass / mass.sum())) ** k, grid)
    losses = np.fft.fftshift(np.maximum(folded, 0))
    x = (np.arange(grid) - grid / 2) * step
    return float((losses * np.maximum(0, 1 - np.exp(np.minimum(eps - x, 0)))).sum())
