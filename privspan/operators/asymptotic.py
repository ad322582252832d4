"""Constants of the asymptotic least-squares mechanism for every row: its outputs with and without the row.

rows are Fit.rows(): features, p (leverage) and w (residual). Quantities without a value (a row with
residual zero has no ratio of constants) are null.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from privspan.functions.special import normal_cdf

from .linear import Fit, dot


def constants(fit: Fit) -> tuple[Column, Column]:
    """c1 = 1 / rss' and c2 = (rss' - rss) / (rss rss'), rss' without the row."""
    rest = fit.neighbor_rss()
    return 1 / rest, (rest - fit.rss) / (fit.rss * rest)


def ratio(fit: Fit) -> Column:
    """c1 / c2."""
    return F.try_divide(F.lit(fit.rss), fit.neighbor_rss() - fit.rss)


def quadratic_form(fit: Fit) -> list[list[Column]]:
    """c1 v v' + c2 B'B, v the row's features."""
    c1, c2 = constants(fit)
    d = range(fit.d)
    return [[c1 * F.col(fit.features[i]) * F.col(fit.features[j]) + c2 * float(fit.gram[i, j]) for j in d] for i in d]


def threshold(fit: Fit, r: float) -> Column:
    """The constant a of the log ratio of the two densities: linear in r."""
    p, square, rss = F.col("p"), F.col("w") * F.col("w"), F.lit(fit.rss)
    logs = fit.d * F.ln(1 - square / ((1 - p) * rss)) - F.ln(1 - p)
    linear = r * square / (rss * (1 - p) - square)
    below = square * rss * (1 - p * p) - square * square - rss * rss * p * (1 - p) * (1 - p)
    return 0.5 * (logs + linear - F.try_divide(r * square * square * (1 - p), below))


def means(fit: Fit, r: float) -> tuple[list[Column], list[Column]]:
    """Means of the two outputs, moved and scaled by sqrt r, with the row and without."""
    c, p, w = ratio(fit), F.col("p"), F.col("w")
    at = -(float(r) ** 0.5) * w / (1 + c * p)
    along = [dot(fit.features, fit.m[j]) for j in range(fit.d)]
    return [at * c * x for x in along], [at * (1 + c) / (1 - p) * x for x in along]


def neighbor_inverse(fit: Fit) -> list[list[Column]]:
    """(B'B)^-1 without the row."""
    along = [dot(fit.features, fit.m[j]) for j in range(fit.d)]
    return [[F.lit(float(fit.m[i, j])) + along[i] * along[j] / (1 - F.col("p")) for j in range(fit.d)] for i in range(fit.d)]


def covariances(fit: Fit) -> tuple[list[list[Column]], list[list[Column]]]:
    """Covariances of the same: rss (B'B)^-1 with the row and without. Over r they are those of the mechanism."""
    rest = fit.neighbor_rss()
    own = [[F.lit(fit.rss * float(fit.m[i, j])) for j in range(fit.d)] for i in range(fit.d)]
    return own, [[rest * x for x in line] for line in neighbor_inverse(fit)]


def spectrum_1d(rows: DataFrame, fit: Fit, r: float, eps: str) -> DataFrame:
    """rows with delta, for one feature. Where the ratio passes e^eps is an interval, or what is outside of one
    if the form is negative; no such set gives 0."""
    if fit.d != 1:
        raise ValueError("one feature is needed")
    (own,), (other,) = means(fit, r)
    ((own_var,),), ((other_var,),) = covariances(fit)
    rows = rows.withColumns({"_a": threshold(fit, r), "_q": quadratic_form(fit)[0][0], "_m": own, "_n": other, "_s": F.sqrt(own_var), "_t": F.sqrt(other_var)})
    point = F.try_divide(2 * (F.col("_a") - F.col(eps)), F.col("_q"))
    rows = rows.withColumn("_x", F.when(point > 0, F.sqrt(F.greatest(point, F.lit(0.0)))))
    inside = lambda m, s: normal_cdf((F.col("_x") - F.col(m)) / F.col(s)) - normal_cdf((-F.col("_x") - F.col(m)) / F.col(s))
    rows = rows.withColumns({"_i": inside("_m", "_s"), "_j": inside("_n", "_t")})
    value = F.when(F.col("_q") > 0, F.col("_i") - F.exp(eps) * F.col("_j")).otherwise(1 - F.col("_i") - F.exp(eps) * (1 - F.col("_j")))
    delta = F.coalesce(F.least(F.lit(1.0), F.greatest(F.lit(0.0), value)), F.lit(0.0))
    return rows.withColumn("delta", delta).drop("_a", "_q", "_m", "_n", "_s", "_t", "_x", "_i", "_j")
