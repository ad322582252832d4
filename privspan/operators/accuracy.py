"""Bootstrap bounds and accuracy of projections and least squares."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import linear, mechanisms, resampling
from .relational import union_sources


def bootstrap_bounds(df: DataFrame, key_column: str, value: str, confidence: float, resamples: int, key: str) -> DataFrame:
    """One row: one- and two-sided empirical bootstrap bounds of the mean.

    key_column numbers the rows 0 .. n-1 (relational.numbered does so; anything else is a ValueError).
    How often each row comes in a resample is found where it lies (resampling.counts), so that
    one pass with partial sums does. Lower bounds take the percentile's next higher value, upper
    bounds the next lower. Null values don't count; without any, and for an empty table, there are no bounds.
    """
    rows = df.select(F.col(key_column).cast("long").alias("i"), F.col(value).cast("double").alias("v"))
    n, low, high, keys, center = rows.agg(F.count("*"), F.min("i"), F.max("i"), F.count("i"), F.avg("v")).first()
    if n and (low, high, keys) != (0, n - 1, n):
        raise ValueError(f"{key_column} does not number the rows from 0 to {n - 1}")
    means = resampling.resampled_means(rows, "i", "v", n, resamples, key) if n else df.sparkSession.createDataFrame([], "m double")
    deltas = means.agg(F.sort_array(F.collect_list("m")).alias("ms")).where(F.size("ms") > 0).withColumn("center", F.lit(center).cast("double"))
    ms, mid = F.col("ms"), F.col("center")
    alpha = 1 - confidence

    def at(q: float, higher: bool) -> Column:
        place = q * (resamples - 1)
        return F.try_element_at(ms, F.lit(int(np.ceil(round(place, 9)) if higher else np.floor(round(place, 9))) + 1)) - mid

    return deltas.select(
        (mid - at(confidence, True)).alias("lb_one_sided"), (mid - at(1 - alpha / 2, True)).alias("lb_two_sided"),
        (mid - at(alpha, False)).alias("ub_one_sided"), (mid - at(alpha / 2, False)).alias("ub_two_sided"),
    )


def column_distances(df: DataFrame, columns: list[str]) -> DataFrame:
    """j, k, distance of every two columns j > k, from the Gram sums."""
    g = linear.gram(df, columns)
    pairs = [F.struct(F.lit(j).alias("j"), F.lit(k).alias("k"), F.sqrt(F.greatest(F.col(f"g_{j}_{j}") + F.col(f"g_{k}_{k}") - 2 * F.col(f"g_{k}_{j}"), F.lit(0.0))).alias("distance")) for j in range(len(columns)) for k in range(j)]
    return g.select(F.explode(F.array(*pairs)).alias("p")).select("p.j", "p.k", "p.distance")


def distance_ratios(df: DataFrame, sketch: DataFrame, columns: list[str], r: int) -> DataFrame:
    """draw, ratio: mean over column pairs of projected distance (over sqrt r) to distance."""
    sums = [F.sum((F.col(a) - F.col(b)) * (F.col(a) - F.col(b))) for i, a in enumerate(columns) for b in columns[:i]]
    names = [(i, j) for i in range(len(columns)) for j in range(i)]
    per = sketch.groupBy("draw").agg(F.array(*[F.struct(F.lit(i).alias("j"), F.lit(j).alias("k"), F.sqrt(s / r).alias("projected")) for (i, j), s in zip(names, sums)]).alias("ps"))
    per = per.select("draw", F.explode("ps").alias("p")).select("draw", "p.*")
    return per.join(F.broadcast(column_distances(df, columns)), ["j", "k"]).groupBy("draw").agg(F.avg(F.col("projected") / F.col("distance")).alias("ratio"))


def product_correlation(df: DataFrame, sketch: DataFrame, columns: list[str], r: int) -> DataFrame:
    """draw, correlation of all d^2 dot products of columns with their projections.

    The covariance has n - 1, the deviations n below: it is larger than a correlation by d^2 / (d^2 - 1).
    """
    d = len(columns)
    exact = linear.gram(df, columns)
    exact = exact.select(F.explode(F.array(*[F.struct(F.lit(i * d + j).alias("c"), F.col(f"g_{min(i, j)}_{max(i, j)}").alias("x")) for i in range(d) for j in range(d)])).alias("p")).select("p.*")
    per = sketch.groupBy("draw").agg(F.array(*[F.struct(F.lit(i * d + j).alias("c"), (F.sum(F.col(columns[i]) * F.col(columns[j])) / r).alias("y")) for i in range(d) for j in range(d)]).alias("ps"))
    per = per.select("draw", F.explode("ps").alias("p")).select("draw", "p.*").join(F.broadcast(exact), "c")
    return per.groupBy("draw").agg((F.covar_samp("x", "y") / (F.stddev_pop("x") * F.stddev_pop("y"))).alias("correlation"))


def error_ratios(draws: DataFrame, beta: np.ndarray) -> DataFrame:
    """draw, |b - beta| / |beta| and |beta| / |b| of drawn coefficients beta_0 .. ."""
    names = [f"beta_{i}" for i in range(len(beta))]
    size = float(np.linalg.norm(beta))
    error = F.sqrt(linear.total((F.col(c) - float(b)) * (F.col(c) - float(b)) for c, b in zip(names, beta)))
    return draws.select("draw", (error / size).alias("relative_error"), (size / F.sqrt(linear.total(F.col(c) * F.col(c) for c in names))).alias("size_ratio"))


def asymptotic_errors(df: DataFrame, fit: linear.Fit, r_values: list[int], draws: int, key: str) -> DataFrame:
    """r, mean squared error of draws from the limiting distribution of a sketch of r rows."""
    names = [f"beta_{i}" for i in range(fit.d)]
    error = linear.total((F.col(c) - float(b)) * (F.col(c) - float(b)) for c, b in zip(names, fit.beta))
    parts = [mechanisms.asymptotic_least_squares(df, fit, r, draws, key).agg(F.avg(error).alias("error")).select(F.lit(r).alias("r"), "error") for r in r_values]
    return union_sources(parts)


def squared_errors(solved: DataFrame, beta: np.ndarray) -> DataFrame:
    """draw, squared error of sketched coefficients in the array beta."""
    return solved.select("draw", linear.total((F.element_at("beta", i + 1) - float(b)) * (F.element_at("beta", i + 1) - float(b)) for i, b in enumerate(beta)).alias("error"))
