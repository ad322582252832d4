"""The same functions over numpy arrays: for Arrow functions, and for scalars on the driver."""

from __future__ import annotations

import math
from functools import lru_cache, reduce

import numpy as np

from privspan.functions.special import ERF_P, ERF_Q, ERFC_P, ERFC_Q, INV_A, INV_B, INV_C, INV_D, SQRT_PI, TAIL_P, TAIL_Q


def erfc(x):
    x = np.asarray(x, np.float64)
    a = np.abs(x)
    small, mid, far = np.minimum(a, 0.5), np.clip(a, 0.4, 4.0), np.maximum(a, 4.0)
    inner = 1 - x * np.polyval(ERF_P, small**2) / np.polyval(ERF_Q, small**2)
    middle = np.exp(-mid * mid) * np.polyval(ERFC_P, mid) / np.polyval(ERFC_Q, mid)
    z = 1 / (far * far)
    tail = np.exp(-far * far) / far * (1 / SQRT_PI - z * np.polyval(TAIL_P, z) / np.polyval(TAIL_Q, z))
    upper = np.where(a <= 4, middle, tail)
    return np.where(a <= 0.46875, inner, np.where(x > 0, upper, 2 - upper))


def normal_cdf(x):
    return 0.5 * erfc(-np.asarray(x) / math.sqrt(2))


def normal_quantile(u):
    """Inverse normal distribution function: a rational start and one step of Halley's method."""
    u = np.clip(np.asarray(u, np.float64), 1e-300, 1 - 2.0**-53)
    low, high, q = np.sqrt(-2 * np.log(u)), np.sqrt(-2 * np.log1p(-u)), u - 0.5
    mid = q * np.polyval(INV_A, q * q) / np.polyval(INV_B, q * q)
    x = np.where(u < 0.02425, np.polyval(INV_C, low) / np.polyval(INV_D, low), np.where(u > 1 - 0.02425, -np.polyval(INV_C, high) / np.polyval(INV_D, high), mid))
    step = (normal_cdf(x) - u) * math.sqrt(2 * math.pi) * np.exp(x * x / 2)
    return x - step / (1 + x * step / 2)


def gamma_pq(nu: float, x):
    """P(nu, x) and Q(nu, x), the regularised incomplete gamma functions of any nu > 0: the lower series
    below nu + 1, else the continued fraction, so that the smaller of the two keeps its digits."""
    x = np.maximum(np.asarray(x, np.float64), 0)
    if nu == 1:
        return -np.expm1(-x), np.exp(-x)
    if nu == 0.5:
        root = np.sqrt(x)
        q = erfc(root)
        # Below 1/2 the difference from 1 would lose digits: the odd series has them.
        small = np.minimum(x, 0.25)
        p = 2 / SQRT_PI * np.sqrt(small) * np.exp(-small) * reduce(lambda a, k: 1 + small / (k + 0.5) * a, range(24, 0, -1), 1.0)
        return np.where(x <= 0.25, p, 1 - q), q
    steps = 40 + int(9 * math.sqrt(nu))
    low, high = np.minimum(x, nu + 1), np.maximum(x, nu + 1)
    total = np.ones_like(low)
    for k in range(steps, 0, -1):
        total = 1 + low / (nu + k) * total
    with np.errstate(divide="ignore"):
        p = np.exp(nu * np.log(low) - low - math.lgamma(nu + 1)) * total
        finite = np.minimum(high, 1e300)
        tail = finite + 1 - nu
        b = tail + 2 * steps
        for k in range(steps, 0, -1):
            b = tail + 2 * (k - 1) - k * (k - nu) / b
        q = np.exp(nu * np.log(finite) - finite - math.lgamma(nu)) / b
    below = x < nu + 1
    return np.where(below, p, 1 - q), np.where(below, 1 - p, q)


def gamma_q(nu: float, x):
    return gamma_pq(nu, x)[1]


def gamma_p(nu: float, x):
    return gamma_pq(nu, x)[0]


def gaussian_delta(eps: float, c: float) -> float:
    return float(max(0.0, normal_cdf(c / 2 - eps / c) - math.exp(eps) * normal_cdf(-c / 2 - eps / c)))


def ratio_delta(eps, rho, r: int):
    """The spectrum of r projections whose variances have the ratio rho; 0 where rho is not above 1."""
    rho = np.asarray(rho, np.float64)
    with np.errstate(divide="ignore", invalid="ignore"):
        t = np.where(rho > 1, 2 * (eps + r / 2 * np.log(rho)) / (rho - 1), np.inf)
        (p1, q1), (p2, q2) = gamma_pq(r / 2, t / 2), gamma_pq(r / 2, np.where(rho > 1, rho * t, np.inf) / 2)
    # Where both tails are near 1 their complements keep the digits.
    value = np.where(rho * t < r, (1 - np.exp(eps)) - p1 + np.exp(eps) * p2, q1 - np.exp(eps) * q2)
    return np.where(rho > 1, np.clip(value, 0, 1), 0.0)


def projection_delta(eps: float, leverage: float, r: int) -> float:
    return float(ratio_delta(eps, 1 / (1 - leverage), r))


def right_kernel(p, q, d: int, r: float, eps):
    """lambda1, lambda2, lambda3, c of the direction from a database to its neighbour, and nu."""
    s = q - p
    return (2 * p - p * p - q) / (1 - q), -s / (1 - q), np.sqrt(r * p * s) * (1 - p) / (1 - q), eps + (d + 1) / 2 * np.log(1 - p) - d / 2 * np.log(1 - q) - r * p / 2 * s / (1 - q), (d - 1) / 2


def left_kernel(p, q, d: int, r: float, eps):
    """The same from the neighbour to the database."""
    s = q - p
    return (q - 2 * p + p * p) / (1 - p) ** 2, s / (1 - p), -np.sqrt(r * p * s) * np.sqrt(1 - q) / (1 - p) ** 2, eps + d / 2 * np.log(1 - q) - (d + 1) / 2 * np.log(1 - p) - r * p / 2 * s / (1 - p) ** 2, (d - 1) / 2


LIMIT, PIECES = 12.0, 8


@lru_cache(maxsize=8)
def legendre(nodes: int) -> tuple[np.ndarray, np.ndarray]:
    return np.polynomial.legendre.leggauss(nodes)


def cut_points(l1, l3, c):
    """Bounds of the three pieces of [-LIMIT, LIMIT] on which c + l1 x^2 / 2 - l3 x keeps its sign."""
    l1, l3, c = np.broadcast_arrays(*(np.atleast_1d(np.asarray(v, np.float64)) for v in (l1, l3, c)))
    root = np.sqrt(np.maximum(l3 * l3 - 2 * l1 * c, 0))
    straight = np.abs(l1) < 1e-14
    with np.errstate(divide="ignore", invalid="ignore"):
        ends = [np.where(straight, np.where(l3 == 0, LIMIT, c / l3), (l3 + sign * root) / np.where(straight, 1, l1)) for sign in (-1, 1)]
    ends = [np.where(l3 * l3 - 2 * l1 * c < 0, LIMIT, np.clip(np.nan_to_num(e, nan=LIMIT), -LIMIT, LIMIT)) for e in ends]
    return np.stack([np.full_like(ends[0], -LIMIT), np.minimum(*ends), np.maximum(*ends), np.full_like(ends[0], LIMIT)], axis=-1)


def integrate(f, l1, l3, c, nodes: int = 64, by_probability: bool = False, below_only: bool = False):
    """Integral of the normal density times f over [-LIMIT, LIMIT], piece by piece.

    f takes x of shape (rows, nodes) and the numbers of those rows. by_probability integrates f
    over u, the normal distribution function of x. below_only: f is 0 but where
    c + l1 x^2 / 2 - l3 x < 0, so other pieces are left out.
    """
    cuts = cut_points(l1, l3, c)
    l1, l3, c = np.broadcast_arrays(*(np.atleast_1d(np.asarray(v, np.float64)) for v in (l1, l3, c)))
    middle = (cuts[:, :-1] + cuts[:, 1:]) / 2
    wanted = (cuts[:, 1:] > cuts[:, :-1]) & ((c[:, None] + l1[:, None] * middle**2 / 2 - l3[:, None] * middle < 0) | (not below_only))
    cuts = normal_cdf(cuts) if by_probability else cuts
    x, w = legendre(nodes)
    total = np.zeros(cuts.shape[0])
    for piece in range(3):
        rows = np.nonzero(wanted[:, piece])[0]
        if not len(rows):
            continue
        lo, width = cuts[rows, piece], (cuts[rows, piece + 1] - cuts[rows, piece]) / PIECES
        for part in range(PIECES):
            at = (lo + (part + 0.5) * width)[:, None] + (width / 2)[:, None] * x
            if by_probability:
                total[rows] += (f(normal_quantile(at), rows) * w).sum(1) * width / 2
            else:
                total[rows] += (f(at, rows) * np.exp(-at * at / 2) * w).sum(1) * width / 2 / math.sqrt(2 * math.pi)
    return total


def _columns(*values):
    return [np.atleast_1d(np.asarray(v, np.float64))[:, None] for v in values]


def delta_right(p, q, d: int, r: float, eps, nodes: int = 64):
    """Least-squares spectrum from the database to its neighbour; 0 < p < q < 1."""
    l1, l2, l3, c, nu = right_kernel(*np.broadcast_arrays(*(np.atleast_1d(np.asarray(v, np.float64)) for v in (p, q))), d, r, np.asarray(eps, np.float64))
    every = _columns(l1, l2, l3, c)

    def f(x, rows):
        m1, m2, m3, mc = (v[rows] for v in every)
        a = mc + m1 * x * x / 2 - m3 * x
        z = np.maximum(0.0, -a / m2)
        grown = np.exp(np.minimum(a, 700) - nu * np.log1p(-m2))
        q2 = gamma_q(nu, (1 - m2) * z) if nu else (z <= 0) * 1.0
        return (gamma_q(nu, z) if nu else (z <= 0) * 1.0) - np.where(q2 > 0, grown * q2, 0.0)

    return np.clip(integrate(f, l1, l3, c, nodes), 0, 1)


def delta_left(p, q, d: int, r: float, eps, nodes: int = 64):
    """Least-squares spectrum from the neighbour to the database; 0 < p < q < 1."""
    l1, l2, l3, c, nu = left_kernel(*np.broadcast_arrays(*(np.atleast_1d(np.asarray(v, np.float64)) for v in (p, q))), d, r, np.asarray(eps, np.float64))
    every = _columns(l1, l2, l3, c)

    def f(x, rows):
        m1, m2, m3, mc = (v[rows] for v in every)
        a = mc + m1 * x * x / 2 - m3 * x
        z = np.maximum(0.0, -a / m2)
        if not nu:
            return np.where(a < 0, 1 - np.exp(np.minimum(a, 0)), 0.0)
        return np.where(a < 0, gamma_p(nu, z) - np.exp(np.minimum(a, 0) - nu * np.log1p(-m2)) * gamma_p(nu, (1 - m2) * z), 0.0)

    return np.clip(integrate(f, l1, l3, c, nodes, below_only=True), 0, 1)


def slope_left(p, s, d: int, r: float, eps, nodes: int = 64, by_probability: bool = False):
    """d/dp of delta_left(p, p + s).

    The integrand vanishes where a = 0, so only its inside counts. With z = -a / l2 and the gamma
    density g, d f = g(z) z l2' / (1 - l2) - e^a (1 - l2)^-nu (a' + nu l2' / (1 - l2)) P(nu, (1 - l2) z);
    the derivatives of l1, l2, l3 and c come from a complex step.
    """
    p, s = np.broadcast_arrays(*(np.atleast_1d(np.asarray(v, np.float64)) for v in (p, s)))
    whole = left_kernel(p + 1e-30j, p + s + 1e-30j, d, r, np.asarray(eps, np.float64))
    nu = whole[4]
    l1, l2, l3, c = (v.real for v in whole[:4])
    every, slopes = _columns(l1, l2, l3, c), _columns(*(v.imag / 1e-30 for v in whole[:4]))

    def f(x, rows):
        (m1, m2, m3, mc), (d1, d2, d3, dc) = ([v[rows] for v in vs] for vs in (every, slopes))
        a, da = mc + m1 * x * x / 2 - m3 * x, dc + d1 * x * x / 2 - d3 * x
        z = np.maximum(-a / m2, 1e-300)
        g = np.exp(nu * np.log(z) - z - math.lgamma(nu)) if nu else 0.0
        p2 = gamma_p(nu, (1 - m2) * z) if nu else 1.0
        return np.where(a < 0, g * d2 / (1 - m2) - np.exp(np.minimum(a, 0) - nu * np.log1p(-m2)) * (da + nu * d2 / (1 - m2)) * p2, 0.0)

    return integrate(f, l1, l3, c, nodes, by_probability, below_only=True)


def bisect(f, low: float, high: float, target: float, tol: float = 1e-6, increasing: bool = True) -> float:
    """x with f(x) = target, f monotone; ValueError unless low and high enclose it."""
    a, b = f(low) - target, f(high) - target
    if a * b > 0:
        raise ValueError(f"no root between {low} and {high}: {a + target}, {b + target}")
    while high - low > tol:
        mid = (low + high) / 2
        if (f(mid) < target) == increasing:
            low = mid
        else:
            high = mid
    return (low + high) / 2


# Kernels (1 - e^(a z^2 / 2 + b z + c))+ of one normal variable.


def kernel_deltas(a: float, b: float, c):
    """E (1 - e^q(Z))+ with q(z) = a z^2 / 2 + b z + c, for each of many c.

    The set q <= 0 is an interval or what is outside of one. For a < 1 the second part is a normal
    integral with another mean and width; for a >= 1, where the set is bounded, it is summed by
    Gauss's rule.
    """
    c = np.atleast_1d(np.asarray(c, np.float64))
    none, whole = np.full_like(c, np.nan), np.full_like(c, np.inf)
    with np.errstate(invalid="ignore", divide="ignore"):
        if abs(a) < 1e-14:
            end = -c / b if b else np.where(c <= 0, np.inf, -np.inf)
            pieces = [(-whole, end) if b >= 0 else (end, whole)]
        else:
            root = np.sqrt(np.where(b * b - 2 * a * c > 0, b * b - 2 * a * c, np.nan))
            lo, hi = np.minimum((-b - root) / a, (-b + root) / a), np.maximum((-b - root) / a, (-b + root) / a)
            pieces = [(lo, hi)] if a > 0 else [(-whole, np.where(np.isnan(root), np.inf, lo)), (np.where(np.isnan(root), none, hi), whole)]
        phi = lambda z: np.where(np.isinf(z), (z > 0) * 1.0, normal_cdf(np.where(np.isinf(z), 0.0, z)))
        out = np.zeros_like(c)
        for lo, hi in pieces:
            if a < 1 - 1e-9:
                scale, middle = math.sqrt(1 - a), b / (1 - a)
                front = np.exp(c + b * b / (2 * (1 - a))) / scale
                part = front * (phi(scale * (hi - middle)) - phi(scale * (lo - middle)))
            else:
                x, w = legendre(64)
                part = np.zeros_like(c)
                for i in range(16):
                    left, right = lo + (hi - lo) * i / 16, lo + (hi - lo) * (i + 1) / 16
                    z = ((left + right) / 2)[:, None] + ((right - left) / 2)[:, None] * x
                    part += (w * np.exp(a * z * z / 2 + b * z + c[:, None] - z * z / 2)).sum(1) * (right - left) / 2 / math.sqrt(2 * math.pi)
            out += np.nan_to_num(phi(hi) - phi(lo) - part, nan=0.0)
    return np.clip(out, 0, 1)


def kernel_delta(a: float, b: float, c: float) -> float:
    return float(kernel_deltas(a, b, c)[0])


def kernel_of_gaussians(mu1, sigma1, mu2, sigma2):
    """a, b, c of N(mu1, sigma1) against N(mu2, sigma2): the log ratio of densities is q + ... in the first's own coordinates."""
    mu1, mu2, sigma1, sigma2 = (np.atleast_1d(np.asarray(v, np.float64)) for v in (mu1, mu2, sigma1, sigma2))
    sigma1, sigma2 = np.atleast_2d(sigma1), np.atleast_2d(sigma2)
    values, axes = np.linalg.eigh(sigma1)
    root = axes @ np.diag(np.sqrt(values)) @ axes.T
    inverse = np.linalg.inv(sigma2)
    a, u = np.linalg.eigh(np.eye(len(mu1)) - root @ inverse @ root)
    shift = mu1 - mu2
    # The normals are symmetric, so an axis may be turned round: b is made positive.
    b = np.abs(u.T @ root @ inverse @ shift)
    c = 0.5 * (np.linalg.slogdet(sigma1)[1] - np.linalg.slogdet(sigma2)[1]) - 0.5 * shift @ inverse @ shift
    # The ratio of the second density to the first is e^(z'az/2 + b'z + c); a hockey stick at e^eps adds eps.
    return a, b, c
