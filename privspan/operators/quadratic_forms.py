"""Quadratic forms of normal vectors, another form in every row: distributions, and least-squares spectra through them.

A form is a sum of weighted chi squares with linear parts; its tails come from contours of all rows of an Arrow batch at once.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from privspan.functions import gx2, numeric
from privspan.functions.special import col


def diagonal_forms(mean: np.ndarray, covariance: np.ndarray, form: np.ndarray):
    """weights, linear parts and constants of x' form x for every row of mean (n x d), covariance and form (n x d x d)."""
    values, axes = np.linalg.eigh(covariance)
    root = axes * np.sqrt(np.maximum(values, 0))[:, None, :]
    weights, turn = np.linalg.eigh(np.swapaxes(root, 1, 2) @ form @ root)
    pulled = (form @ mean[:, :, None])[:, :, 0]
    linear = 2 * (np.swapaxes(root @ turn, 1, 2) @ pulled[:, :, None])[:, :, 0]
    return weights, linear, (mean * pulled).sum(1)


def _square(series: pd.Series, d: int) -> np.ndarray:
    return np.array(series.tolist(), np.float64).reshape(len(series), d, d)


def _proper(*parts: pd.Series, sizes: tuple[int, ...]) -> np.ndarray:
    """Rows whose arrays have the sizes and hold finite numbers only."""
    fine = np.ones(len(parts[0]), bool)
    for part, size in zip(parts, sizes):
        fine &= np.array([v is not None and len(v) == size and np.isfinite(np.asarray(v, np.float64)).all() for v in part], bool)
    return fine


def distribution(x, mean: str, covariance: str, form: str, d: int) -> Column:
    """A struct: P(v' form v <= x) as `below`, `above`, and `error`, v normal with the row's mean (d) and covariance (d x d by rows).

    form is symmetric, covariance may be singular. Null where x, an array or an entry is null, NaN or infinite, or an array has another size.
    """

    @F.pandas_udf("below double, above double, error double")
    def run(x: pd.Series, mean: pd.Series, covariance: pd.Series, form: pd.Series) -> pd.DataFrame:
        out = np.full((len(x), 3), np.nan)
        numbers = x.astype("float64").to_numpy()
        at = np.nonzero(_proper(mean, covariance, form, sizes=(d, d * d, d * d)) & np.isfinite(numbers))[0]
        if len(at):
            means = np.array(mean.iloc[at].tolist(), np.float64).reshape(len(at), d)
            weights, linear, constant = diagonal_forms(means, _square(covariance.iloc[at], d), _square(form.iloc[at], d))
            above, below, error = gx2.tails(numbers[at] - constant, weights, 1, linear)
            out[at] = np.stack([below, above, error], 1)
        return pd.DataFrame(out, columns=["below", "above", "error"])

    return run(col(x), mean, covariance, form)


def exchange_deltas(l1, l2, l3, c, d: int, eps):
    """E (1 - e^T)+ of T = l1 X^2 / 2 + l2 |Y|^2 / 2 - l3 X + c, X normal and Y of d - 1 normals, and an estimate of the error.

    e^(T - eps) is a ratio of two densities: under the other one, X and Y have other widths, so the value is a difference of
    two distribution functions of quadratic forms. l1 and l2 are below 1.
    """
    l1, l2, l3, c = np.broadcast_arrays(*(np.asarray(v, np.float64) for v in (l1, l2, l3, c)))
    none = np.zeros_like(l1)
    dof = np.array([1.0, d - 1.0])
    _, own, first = gx2.tails(-c, np.stack([l1 / 2, l2 / 2], 1), dof, np.stack([-l3, none], 1))
    middle, width = -l3 / (1 - l1), 1 / np.sqrt(1 - l1)
    weights, linear = np.stack([l1 * width**2 / 2, l2 / (1 - l2) / 2], 1), np.stack([width * (l1 * middle - l3), none], 1)
    _, other, second = gx2.tails(-(c + l1 * middle**2 / 2 - l3 * middle), weights, dof, linear)
    grown = np.exp(eps)
    return np.clip(own - grown * other, 0, 1), first + grown * second


def least_squares(p: str, q: str, d: int, r, eps) -> Column:
    """A struct for each row: the spectra `left` (neighbour to table) and `right`, and `error`; 0 < p < q < 1, d > 1.

    The same values as `quadrature.left` and `right`, whose rule is off by up to 1e-8 where q - p is small. Null outside of these bounds.
    """

    @F.pandas_udf("left double, right double, error double")
    def run(p: pd.Series, q: pd.Series, r: pd.Series, eps: pd.Series) -> pd.DataFrame:
        out = np.full((len(p), 3), np.nan)
        p, q, r, eps = (v.astype("float64").to_numpy() for v in (p, q, r, eps))
        at = np.nonzero((0 < p) & (p < q) & (q < 1) & (r > 0) & np.isfinite(r) & np.isfinite(eps))[0]
        if len(at):
            for k, kernel in enumerate((numeric.left_kernel, numeric.right_kernel)):
                out[at, k], error = exchange_deltas(*kernel(p[at], q[at], d, r[at], eps[at])[:4], d, eps[at])
                out[at, 2] = np.fmax(out[at, 2], error)
        return pd.DataFrame(out, columns=["left", "right", "error"])

    return run(p, q, col(r), col(eps))
