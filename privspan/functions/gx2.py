"""Distribution of quadratic forms of normal vectors: weighted sums of noncentral chi squares, plus a normal.

Weights of one sign have the series of H. Ruben (1962) with the recursion of R. W. Farebrother (1984);
others the inversion integral of J. P. Imhof (1961).
"""

from __future__ import annotations

import math

import numpy as np

from .numeric import gamma_p, legendre


def parameters(mean, covariance, form):
    """weights, degrees of freedom, noncentralities, m and s of x' form x, x normal."""
    mean, covariance, form = (np.asarray(v, np.float64) for v in (mean, covariance, form))
    values, axes = np.linalg.eigh(covariance)
    root = axes @ np.diag(np.sqrt(np.maximum(values, 0))) @ axes.T
    d, r = np.linalg.eigh(root @ form @ root)
    b = 2 * r.T @ root @ form @ mean
    zero = np.abs(d) <= 1e-12 * max(np.abs(d).max(), 1e-300)
    weights, dof, shift = [], [], []
    for i in np.nonzero(~zero)[0]:
        if weights and abs(d[i] - weights[-1]) <= 1e-10 * abs(d[i]):
            dof[-1] += 1
            shift[-1] += b[i] ** 2 / (4 * d[i] ** 2)
        else:
            weights.append(d[i])
            dof.append(1)
            shift.append(b[i] ** 2 / (4 * d[i] ** 2))
    weights, shift = np.array(weights), np.array(shift)
    s = float(np.linalg.norm(b[zero]))
    return weights, np.array(dof), shift, float(mean @ form @ mean - weights @ shift), s if s > 1e-12 * max(np.abs(b).max(), 1e-300) else 0.0


def ruben(x, weights, dof, shift, m=0.0, terms: int = 200):
    """P(sum <= x) for weights of one sign and no normal part."""
    x, w, k, lam = (np.asarray(v, np.float64) for v in (x, weights, dof, shift))
    if (w < 0).all():
        return 1 - ruben(-x, -w, k, lam, -m, terms)
    if not (w > 0).all():
        raise ValueError("weights of both signs")
    beta = 0.9 * w.min()
    g = 1 - beta / w
    a = [math.exp(-lam.sum() / 2) * float(np.prod((beta / w) ** (k / 2)))]
    b = [0.0] + [float((k * g**r).sum() + r * (lam * (g ** (r - 1) - g**r)).sum()) for r in range(1, terms)]
    for n in range(1, terms):
        a.append(sum(b[r] * a[n - r] for r in range(1, n + 1)) / (2 * n))
    y = np.maximum((x - m) / beta, 0) / 2
    return np.clip(sum(c * gamma_p(k.sum() / 2 + i, y) for i, c in enumerate(a)), 0, 1)


def imhof(x, weights, dof, shift, m=0.0, s=0.0, tail: float = 1e9):
    """P(sum + s Z + m <= x) for any weights, by the characteristic function's inversion."""
    w, k, lam = (np.asarray(v, np.float64)[:, None] for v in (weights, dof, shift))
    node, weight = legendre(32)

    def size(u):
        return np.exp((k / 4 * np.log1p((w * u) ** 2)).sum(0) + (lam / 2 * (w * u) ** 2 / (1 + (w * u) ** 2)).sum(0) + (s * u) ** 2 / 8) * u

    top = 1.0
    while size(np.array([top]))[0] < tail and top < 1e5:
        top *= 1.5
    # Panels grow, as the weight is near zero, but none holds more than about ten oscillations.
    panels = int(min(max(400, top * (np.abs(np.atleast_1d(x) - m).max() + np.abs(w).sum()) / 10), 50_000))
    edges = top * (np.linspace(0, 1, panels + 1) ** 2)
    u = ((edges[:-1] + edges[1:]) / 2)[:, None] + ((edges[1:] - edges[:-1]) / 2)[:, None] * node
    flat = u.ravel()
    part = ((edges[1:] - edges[:-1]) / 2)[:, None] * weight
    angle = (k / 2 * np.arctan(w * flat) + lam / 2 * w * flat / (1 + (w * flat) ** 2)).sum(0)
    rho = size(flat)
    out = [0.5 - float((np.sin(angle - (v - m) * flat / 2) / rho * part.ravel()).sum()) / math.pi for v in np.atleast_1d(x)]
    return np.clip(np.array(out), 0, 1)


def cdf(x, weights, dof, shift, m=0.0, s=0.0):
    w = np.asarray(weights, np.float64)
    if s == 0 and len(w) and ((w > 0).all() or (w < 0).all()) and np.abs(w).max() / np.abs(w).min() < 20:
        return ruben(x, w, dof, shift, m)
    return imhof(x, w, dof, shift, m, s)


#: Largest numbers of points of one inversion sum, and of points times rows held at once.
MOST_POINTS, HELD = 1 << 17, 1 << 22


def upper_tails(x, weights, r: int, tol: float = 1e-11):
    """P(sum of weights times chi squares of r degrees > x) for every row of x and weights, with a bound of its error.

    The sum of R. B. Davies (1973): the inversion integral at midpoints is exact but for the probability beyond a distance
    that the step sets, here below tol by Chernoff's bound; what is cut off the end is bounded by the decay of the last
    factors. Rows of like lengths are summed together. Weights may have any sign; without any, the sum is zero.
    """
    x, w = np.asarray(x, np.float64), np.asarray(weights, np.float64)
    scale = np.sqrt((w * w).sum(1))
    out, error = (x < 0).astype(np.float64), np.zeros(len(x))
    rows = np.nonzero(scale > 0)[0]
    if not len(rows):
        return out, error
    w, x = w[rows] / scale[rows][:, None], x[rows] / scale[rows]
    reach = np.full(len(rows), np.inf)
    for power in (0.05, 0.1, 0.2, 0.3, 0.4, 0.45):
        moment = np.maximum(-np.log1p(-2 * power * w).sum(1), -np.log1p(2 * power * w).sum(1)) * r / 2
        reach = np.minimum(reach, (moment - math.log(tol)) / power)
    step = 2 * math.pi / (reach + np.abs(x))
    # The end is where the factors are below tol, or where the points run out.
    size = lambda v: np.exp(-r / 4 * np.log1p((w * v[:, None]) ** 2).sum(1))
    low, high = np.zeros(len(rows)), step * MOST_POINTS
    for _ in range(60):
        mid = (low + high) / 2
        far = size(mid) > tol
        low, high = np.where(far, mid, low), np.where(far, high, mid)
    points = np.minimum(np.ceil(high / step), MOST_POINTS).astype(int)
    # Beyond the end v the integrand is at most size(v) (v / u)^power / u.
    v = points * step
    power = r / 2 * ((w * v[:, None]) ** 2 / (1 + (w * v[:, None]) ** 2)).sum(1)
    bound = size(v) / (math.pi * np.maximum(power, 1e-3)) + tol
    order = np.argsort(points, kind="stable")
    value = np.empty(len(rows))
    at = 0
    while at < len(order):
        # Neighbours in this order have nearly as many points; no more are held than fit.
        few = max(1, HELD // (int(points[order[at]]) + 1))
        take = order[at : at + few]
        take = take[points[take] <= 2 * points[take[0]] + 64]
        k = np.arange(points[take].max()) + 0.5
        u = k[None] * step[take][:, None]
        angle, decay = -u * x[take][:, None] / 2, np.zeros_like(u)
        for j in range(w.shape[1]):
            wu = w[take, j][:, None] * u
            angle += r / 2 * np.arctan(wu)
            decay += np.log1p(wu * wu)
        value[take] = 0.5 + (np.sin(angle) * np.exp(-r / 4 * decay) / k[None]).sum(1) / math.pi
        at += len(take)
    out[rows], error[rows] = np.clip(value, 0, 1), bound
    return out, error


#: Points of a contour, their spacing, and points times rows held at once.
CONTOUR, SPACING, HELD_POINTS = 272, 1 / 24, 1 << 18
#: Points after which a contour ends where the integrand is below LOST times its largest value.
NEAR, LOST = 136, 1e-19
#: Logarithm below that of the smallest double.
SMALLEST = -746.0
#: Slopes that contours bend to, each tried where the one before leaves an error above FINE.
SLOPES, FINE = (0.7, 0.3, 0.1, 0.02), 1e-8


def _turning_point(x, w, r, b):
    """Where M(t) e^(-tx) / t is least over the real t > 0, with the second and third derivatives of its logarithm there.

    x is at least the mean, so there is such a point; it is found by bisection of the slope, in logarithms of t.
    """
    with np.errstate(divide="ignore"):
        end = np.where((w > 0).any(1), 1 / (2 * np.maximum(w.max(1), 1e-300)), np.inf)

    def slope(t):
        u = 1 - 2 * t[:, None] * w
        return (r * w / u + b * b * t[:, None] * (1 - t[:, None] * w) / (u * u)).sum(1) - x - 1 / t

    low, high = np.full(len(x), -60.0), np.minimum(np.log(end), 60.0)
    for _ in range(64):
        middle = (low + high) / 2
        t = np.minimum(np.exp(middle), end * (1 - 1e-15))
        up = slope(t) > 0
        low, high = np.where(up, low, middle), np.where(up, middle, high)
    t = np.minimum(np.exp(low), end * (1 - 1e-12))
    u = 1 - 2 * t[:, None] * w
    second = (2 * r * w * w / u**2 + b * b / u**3).sum(1) + 1 / t**2
    third = (8 * r * w**3 / u**3 + 6 * b * b * w / u**4).sum(1) - 2 / t**3
    return t, second, third


def _along(x, w, r, b, t, width, bend, slope: float):
    """The integral over the contour of one slope through t, and an estimate of its error."""
    slope = slope * np.sign(bend)
    run = slope / (2 * bend)

    def parts(rows, columns):
        v = SPACING * columns
        y = width[rows, None] * np.sinh(v)
        root = np.sqrt(1 + (y / run[rows, None]) ** 2)
        z = t[rows, None] + (slope * run)[rows, None] * (root - 1) + 1j * y
        move = (slope[rows, None] * y / (run[rows, None] * root) + 1j) * width[rows, None] * np.cosh(v)
        power = -z * x[rows, None]
        for j in range(w.shape[1]):
            u = 1 - 2 * z * w[rows, j, None]
            power -= r[rows, j, None] / 2 * np.log(u)
            if b[rows, j].any():
                power += (b[rows, j, None] * z) ** 2 / (2 * u)
        return (np.exp(power) * (move / z)).imag

    part, every = np.zeros((len(x), CONTOUR)), np.arange(len(x))

    def fill(rows, columns):
        if len(rows):
            part[rows[:, None], columns] = parts(rows, columns)

    with np.errstate(over="ignore", invalid="ignore"):
        # Every second point up to NEAR; beyond only where the integrand is not yet lost in rounding.
        fill(every, np.arange(0, NEAR, 2))
        far = ~(np.abs(part[:, NEAR - 16 : NEAR : 2]).max(1) <= LOST * np.abs(part[:, :NEAR:2]).max(1))
        fill(every[far], np.arange(NEAR, CONTOUR, 2))
        part[:, 0] /= 2
        fine, coarse = part[:, ::2].sum(1) * 2 * SPACING, part[:, ::4].sum(1) * 4 * SPACING
        error = np.abs(fine - coarse) + np.abs(part[:, -8:]).max(1)
        # The points between where these leave more than a small share of the value.
        open_ = ~(error <= FINE * np.abs(fine))
        fill(every[open_], np.arange(1, NEAR, 2))
        fill(every[open_ & far], np.arange(NEAR + 1, CONTOUR, 2))
        fine[open_], coarse[open_] = part[open_].sum(1) * SPACING, part[open_, ::2].sum(1) * 2 * SPACING
        error[open_] = np.abs(fine - coarse)[open_] + np.abs(part[open_, -8:]).max(1)
    return fine / math.pi, np.where(np.isfinite(error), error, np.inf) / math.pi


def _contour_tails(x, w, r, b):
    """P(Q > x) for x at least the mean of Q, and an estimate of the error."""
    value, error = np.zeros(len(x)), np.full(len(x), np.inf)
    # Without a positive weight or a normal by itself Q has a largest value.
    bounded = ~((w > 0) | ((w == 0) & (b != 0))).any(1)
    with np.errstate(divide="ignore", invalid="ignore"):
        most = np.where(w < 0, b * b / (-4 * w), 0.0).sum(1)
    beyond = bounded & (x >= most)
    error[beyond] = 0
    left = np.nonzero(~beyond)[0]
    if not len(left):
        return value, error
    t, second, third = _turning_point(x[left], w[left], r[left], b[left])
    # Chernoff's bound M(t) e^(-tx) below the smallest double: the tail is zero.
    u = 1 - 2 * t[:, None] * w[left]
    most = ((b[left] * t[:, None]) ** 2 / (2 * u) - r[left] / 2 * np.log(u)).sum(1) - t * x[left]
    error[left[most < SMALLEST]] = 0
    here = most >= SMALLEST
    left, t, second, third = left[here], t[here], second[here], third[here]
    if not len(left):
        return value, error
    width = 1 / np.sqrt(second)
    # Far from the turning point the integrand falls to the side that x and the linear parts tell; every singularity is real.
    with np.errstate(divide="ignore", invalid="ignore"):
        side = np.where(x[left] + np.where(w != 0, b * b / (4 * w), 0.0).sum(1)[left] >= 0, 1.0, -1.0)
    bend = side * np.maximum(side * third / (6 * second), 0.1 / width)
    for slope in SLOPES:
        at = np.nonzero(error[left] > FINE)[0]
        if not len(at):
            break
        rows = left[at]
        found, off = _along(x[rows], w[rows], r[rows], b[rows], t[at], width[at], bend[at], slope)
        better = off < error[rows]
        value[rows[better]], error[rows[better]] = found[better], off[better]
    return value, error


def tails(x, weights, dof, linear=None):
    """P(Q > x) and P(Q <= x) for every row, with an estimate of the error, by a contour through the turning point.

    Q is the sum over j of weights[:, j] times chi squares of dof[:, j] degrees, plus linear[:, j] times the first normal of
    that chi square; a weight of zero leaves the normal, and a chi square around another point is one with a linear part and
    a constant. Weights have any sign. The smaller of the two tails is integrated and keeps its relative accuracy. The
    contour bends to where the integrand falls, so a few hundred points do for any degrees. The error is the
    difference from every second point, which is far above the true one, as that falls like its square. A row without spread is a step at zero; rows with a NaN or infinity give NaN.
    """
    x, w = np.asarray(x, np.float64), np.asarray(weights, np.float64)
    r = np.broadcast_to(np.asarray(dof, np.float64), w.shape)
    b = np.zeros_like(w) if linear is None else np.broadcast_to(np.asarray(linear, np.float64), w.shape)
    scale = np.sqrt((2 * r * w * w + b * b).sum(1)) if len(x) else np.zeros(0)
    above, below, error = (x < 0) * 1.0, (x >= 0) * 1.0, np.zeros(len(x))
    bad = ~(np.isfinite(x) & np.isfinite(scale))
    above[bad] = below[bad] = error[bad] = np.nan
    live = np.nonzero((scale > 0) & ~bad)[0]
    step = max(1, HELD_POINTS // CONTOUR)
    for at in range(0, len(live), step):
        rows = live[at : at + step]
        s, wr, rr = scale[rows], w[rows] / scale[rows][:, None], r[rows]
        xs, bs = x[rows] / s, b[rows] / s[:, None]
        upper = xs >= (wr * rr).sum(1)
        sign = np.where(upper, 1.0, -1.0)
        value, off = _contour_tails(sign * xs, sign[:, None] * wr, rr, bs)
        value = np.clip(value, 0, 1)
        above[rows], below[rows], error[rows] = np.where(upper, value, 1 - value), np.where(upper, 1 - value, value), off
    return above, below, error
