"""Least-squares spectra of all rows: Gauss's rule by pieces in Arrow batches, each row by itself.

r and eps are numbers or columns, so a grid of either is a column of the rows.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from privspan.functions import numeric
from privspan.functions.special import col


def _row_function(f, d: int, nodes: int):
    @F.pandas_udf("double")
    def run(p: pd.Series, q: pd.Series, r: pd.Series, eps: pd.Series) -> pd.Series:
        return pd.Series(f(p.to_numpy(), q.to_numpy(), d, r.to_numpy(), eps.to_numpy(), nodes))

    return run


def left(p: str, q: str, d: int, r, eps, nodes: int = 32) -> Column:
    """From the neighbour without the row to the table; 0 < p < q < 1."""
    return _row_function(numeric.delta_left, d, nodes)(p, q, col(r), col(eps))


def right(p: str, q: str, d: int, r, eps, nodes: int = 32) -> Column:
    """From the table to the neighbour without the row."""
    return _row_function(numeric.delta_right, d, nodes)(p, q, col(r), col(eps))


def worse(p: str, q: str, d: int, r, eps, nodes: int = 32) -> Column:
    """The larger of both, in one pass over the rows."""
    both = lambda *x: np.maximum(numeric.delta_left(*x), numeric.delta_right(*x))
    return _row_function(both, d, nodes)(p, q, col(r), col(eps))


def left_slope(p: str, share: str, d: int, r, eps, nodes: int = 32, by_probability: bool = False) -> Column:
    """Derivative of left(p, p + share) in p; by_probability integrates over the distribution function instead."""
    slope = lambda *x: numeric.slope_left(*x, by_probability=by_probability)
    return _row_function(slope, d, nodes)(p, share, col(r), col(eps))
