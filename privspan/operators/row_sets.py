"""Neighbours that differ by a set of rows: every group of rows is a set, and all sets are met in one grouped aggregate.

A set enters by its Gram sums S only. With G of the whole table, the shares are the eigenvalues of (G + first)^-1 (S + first -
second); the neighbour's covariance has the ratios 1 - share to the table's, and the determinants differ by their product.
r projections of all columns then have a loss that is a weighted sum of chi squares, whose tails come from contours of every
set at once.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from privspan.functions import gx2

from . import linear

#: A share of so much counts as all of a direction.
WHOLE = 1 - 1e-12


def set_sums(rows: DataFrame, group: str, columns: list[str]) -> DataFrame:
    """group, n and the upper triangle of Gram sums as `sums`; rows with a null or NaN in a column are left out."""
    kept = _whole_rows(rows, columns)
    d = len(columns)
    products = [F.sum(F.col(columns[i]) * F.col(columns[j])) for i in range(d) for j in range(i, d)]
    return kept.groupBy(group).agg(F.count("*").alias("n"), F.array(*products).alias("sums"))


def _whole_rows(rows: DataFrame, columns: list[str]) -> DataFrame:
    whole = F.lit(True)
    for c in columns:
        whole = whole & F.col(c).isNotNull() & ~F.isnan(c)
    return rows.where(whole)


def shares_of(sums: np.ndarray, gram: np.ndarray, first: float, second: float) -> np.ndarray:
    """Shares of every set, falling, from n x d (d + 1) / 2 sums."""
    d = len(gram)
    upper = np.triu_indices(d)
    s = np.zeros((len(sums), d, d))
    s[:, upper[0], upper[1]] = s[:, upper[1], upper[0]] = sums
    s += (first - second) * np.eye(d)
    root = np.linalg.inv(np.linalg.cholesky(gram + first * np.eye(d)))
    return np.linalg.eigvalsh(root @ s @ root.T)[:, ::-1]


def projected_deltas(shares: np.ndarray, r: int, eps: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """delta of the table against its neighbour, of the neighbour against the table, and an estimate of either's error."""
    out, back, error = np.ones(len(shares)), np.ones(len(shares)), np.zeros(len(shares))
    fine = np.nonzero((shares < WHOLE).all(1))[0]
    if len(fine):
        k = shares[fine]
        own, other, shift = k / (1 - k) / 2, k / 2, r / 2 * np.log1p(-k).sum(1)
        (p, _, e1), (q, _, e2) = gx2.tails(eps - shift, own, r), gx2.tails(eps - shift, other, r)
        (_, bp, e3), (_, bq, e4) = gx2.tails(-eps - shift, own, r), gx2.tails(-eps - shift, other, r)
        grown = np.exp(eps)
        out[fine], back[fine] = np.clip(p - grown * q, 0, 1), np.clip(bq - grown * bp, 0, 1)
        error[fine] = np.maximum(e1 + grown * e2, e4 + grown * e3)
    return out, back, error


def set_spectra(rows: DataFrame, group: str, columns: list[str], r: int, eps: float, first: float = 0.0, second: float = 0.0) -> DataFrame:
    """group, n, shares, log_det (ln of the table's over the neighbour's determinant), delta, back and error, a row for each group.

    first and second are added to the diagonals of the table's and of the neighbour's Gram matrix. A set that holds a whole
    direction has log_det null, delta and back 1. A null group is a set too. LinAlgError if the table's columns depend on each other and first is zero.
    """
    _, gram = linear.gram_matrix(_whole_rows(rows, columns), columns)

    @F.pandas_udf("shares array<double>, log_det double, delta double, back double, error double")
    def spectrum(sums: pd.Series) -> pd.DataFrame:
        k = shares_of(np.array(sums.tolist(), np.float64).reshape(len(sums), -1), gram, first, second) if len(sums) else np.zeros((0, len(gram)))
        delta, back, error = projected_deltas(k, r, eps)
        whole = (k >= WHOLE).any(1)
        log_det = -np.log1p(-np.minimum(k, WHOLE)).sum(1)
        frame = pd.DataFrame({"shares": k.tolist(), "delta": delta, "back": back, "error": error})
        frame["log_det"] = pd.Series([None if w else float(v) for w, v in zip(whole, log_det)], dtype="object")
        return frame[["shares", "log_det", "delta", "back", "error"]]

    return set_sums(rows, group, columns).withColumn("_s", spectrum("sums")).select(group, "n", "_s.*")
