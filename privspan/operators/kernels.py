"""Spectra of two Gaussians in many dimensions, by Monte Carlo over keyed draws and by shifted lattices.

E (1 - exp(sum a z^2 / 2 + b z + c))+ over independent normals z: the coordinate with the largest
|a| (then |b|) is integrated in closed form, the others are drawn.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from privspan.functions.numeric import gamma_q, kernel_delta, kernel_deltas, kernel_of_gaussians
from privspan.functions.numeric import normal_quantile as quantile
from privspan.functions.special import normal_quantile

from . import linear, rng, sobol


def innermost(a: np.ndarray, b: np.ndarray) -> int:
    """Coordinate with the largest (|a|, |b|), the first of equal ones."""
    return max(range(len(a)), key=lambda i: (abs(a[i]), abs(b[i]), -i))


def innermost_column(a: str, b: str) -> Column:
    """The same of array columns, counted from 0."""
    ranked = F.transform(F.arrays_zip(F.col(a).alias("a"), F.col(b).alias("b")), lambda s, i: F.struct(F.abs(s["a"]).alias("x"), F.abs(s["b"]).alias("y"), (-i).alias("m"), i.alias("i")))
    return F.array_max(ranked)["i"]


def _exponent(a, b, c: float, zs: list[Column]) -> Column:
    terms = [float(x) / 2 * z * z + float(y) * z for x, y, z in zip(a, b, zs)]
    return linear.total([F.lit(float(c)), *terms])


def monte_carlo(draws: DataFrame, counter: str, a, b, c: float, key: str) -> DataFrame:
    """One row: delta and its standard error over one draw a row of `draws`, by its counter."""
    zs = {f"_z{j}": rng.normal(key, "mc", F.col(counter), F.lit(j)) for j in range(len(a))}
    rows = draws.select(counter).withColumns(zs)
    value = F.greatest(F.lit(0.0), 1 - F.exp(_exponent(a, b, c, [F.col(z) for z in zs])))
    return rows.agg(F.avg(value).alias("delta"), (F.stddev_samp(value) / F.sqrt(F.count("*"))).alias("stderr"))


def _steps(d: int) -> list[float]:
    """Powers of the root of x^(d+1) = x + 1: a lattice that fills the cube evenly."""
    g = 1.5
    for _ in range(64):
        g = (1 + g) ** (1 / (d + 1))
    return [g ** -(j + 1) % 1 for j in range(d)]


def lattice(draws: DataFrame, counter: str, a, b, c: float, shifts: int, key: str) -> DataFrame:
    """One row: delta and its standard error over random shifts of a lattice, one point a row and shift.

    counter numbers the rows. The innermost coordinate is integrated in closed form.
    """
    us = lambda count: [F.pmod(F.col("i") * s + rng.uniform(key, "shift", F.col("shift"), F.lit(j)), F.lit(1.0)) for j, s in enumerate(_steps(max(count, 1))[:count])]
    points = draws.select(F.col(counter).cast("long").alias("i")).withColumn("shift", F.explode(F.sequence(F.lit(0), F.lit(shifts - 1))))
    return _nested(points, "shift", us(len(a) - 1), a, b, c)


def _nested(points: DataFrame, repeat: str, us: list[Column], a, b, c: float) -> DataFrame:
    """One row: delta and its standard error over repetitions, each the mean over its points; us are the outer coordinates, the one that counts most first."""
    a, b = np.asarray(a, float), np.asarray(b, float)
    inner = innermost(a, b)
    outer = [i for i in sorted(range(len(a)), key=lambda i: -abs(a[i])) if i != inner]

    @F.pandas_udf("double")
    def inside(*us: pd.Series) -> pd.Series:
        at = np.full(len(us[0]), float(c))
        for u, k in zip(us, outer):
            z = quantile(u.to_numpy())
            at += a[k] / 2 * z * z + b[k] * z
        return pd.Series(kernel_deltas(float(a[inner]), float(b[inner]), at))

    # Points reach Python as they are: the quantiles of many coordinates as Columns take seconds to plan.
    means = points.withColumn("value", inside(*us)).groupBy(repeat).agg(F.avg("value").alias("m"))
    return means.agg(F.avg("m").alias("delta"), (F.stddev_samp("m") / F.sqrt(F.count("*"))).alias("stderr"))


def sobol_points(spark, count: int, a, b, c: float, scrambles: int, key: str) -> DataFrame:
    """The same over scrambled Sobol points, count of them (a power of two) for each scramble; one coordinate is integrated in closed form."""
    points = sobol.points(spark, count, max(len(a) - 1, 1), scrambles, key)
    return _nested(points, "scramble", [F.col(f"u{j}") for j in range(len(a) - 1)], a, b, c)


def estimate(draws: DataFrame, counter: str, a, b, c: float, key: str, method: str = "lattice", shifts: int = 8) -> DataFrame:
    """One row, delta and stderr: in closed form for one coordinate, else by `monte_carlo`, `lattice` or `sobol`.

    `sobol` takes the next power of two of the number of draws as its number of points for each of `shifts` scrambles.
    """
    if method not in ("monte_carlo", "lattice", "sobol"):
        raise ValueError(f"unknown method {method!r}")
    if len(a) == 1:
        value = kernel_delta(float(a[0]), float(b[0]), float(c))
        return draws.agg(F.max(F.lit(value)).alias("delta"), F.max(F.lit(0.0)).alias("stderr"))
    if method == "sobol":
        return sobol_points(draws.sparkSession, 1 << max(draws.count() - 1, 0).bit_length(), a, b, c, shifts, key)
    return monte_carlo(draws, counter, a, b, c, key) if method == "monte_carlo" else lattice(draws, counter, a, b, c, shifts, key)


def _batched(points: DataFrame, value: Column, batch: Column) -> DataFrame:
    """One row: the mean of the values and the standard error of the means of batches."""
    means = points.withColumn("_batch", batch).withColumn("_value", value).groupBy("_batch").agg(F.avg("_value").alias("m"))
    return means.agg(F.avg("m").alias("delta"), (F.stddev_samp("m") / F.sqrt(F.count("*"))).alias("stderr"))


def _kept(t: Column) -> Column:
    return F.when(t < 0, 1 - F.exp(F.least(t, F.lit(0.0)))).otherwise(0.0)


def radial_monte_carlo(draws: DataFrame, counter: str, l1: float, l2: float, l3: float, c: float, d: int, key: str) -> DataFrame:
    """One row: E (1 - e^t)+ of t = l1 X^2 / 2 + l2 |Y|^2 / 2 - l3 X + c over d normals (X, Y).

    Each row of draws gives one draw and its opposite, which differ in X only; the error is that of the pairs.
    """
    zs = {f"_z{j}": rng.normal(key, "radial", F.col(counter), F.lit(j)) for j in range(d)}
    rows = draws.select(counter).withColumns(zs)
    fixed = linear.total([F.col("_z0") * F.col("_z0") * (l1 / 2) + c, *[F.col(z) * F.col(z) * (l2 / 2) for z in list(zs)[1:]]])
    rows = rows.withColumn("_fixed", fixed)
    value = (_kept(F.col("_fixed") - l3 * F.col("_z0")) + _kept(F.col("_fixed") + l3 * F.col("_z0"))) / 2
    return rows.agg(F.avg(value).alias("delta"), (F.stddev_samp(value) / F.sqrt(F.count("*"))).alias("stderr"))


def radial_lattice(draws: DataFrame, counter: str, l1: float, l2: float, l3: float, c: float, d: int, key: str, batches: int = 16) -> DataFrame:
    """The same over a lattice of d dimensions, with a shift for each batch of points."""
    batch = F.pmod(F.col(counter), F.lit(batches))
    us = [F.pmod(F.col(counter) * s + rng.uniform(key, "radial.shift", batch, F.lit(j)), F.lit(1.0)) for j, s in enumerate(_steps(d))]
    rows = draws.select(counter).withColumns({f"_z{j}": normal_quantile(u) for j, u in enumerate(us)})
    fixed = linear.total([F.col("_z0") * F.col("_z0") * (l1 / 2) + c, *[F.col(f"_z{j}") * F.col(f"_z{j}") * (l2 / 2) for j in range(1, d)]])
    rows = rows.withColumn("_fixed", fixed)
    value = (_kept(F.col("_fixed") - l3 * F.col("_z0")) + _kept(F.col("_fixed") + l3 * F.col("_z0"))) / 2
    return _batched(rows, value, batch)


def radial_reduced(draws: DataFrame, counter: str, l1: float, l2: float, l3: float, c: float, d: int, key: str, batches: int = 16) -> DataFrame:
    """The same for l2 < 0 over X only: |Y|^2 is integrated by the incomplete gamma function."""
    if l2 >= 0 or d < 2:
        raise ValueError("l2 < 0 and d > 1 are needed")
    nu = (d - 1) / 2
    batch = F.pmod(F.col(counter), F.lit(batches))
    u = F.pmod(F.col(counter) * _steps(1)[0] + rng.uniform(key, "radial.shift", batch, F.lit(0)), F.lit(1.0))

    @F.pandas_udf("double")
    def inside(u: pd.Series) -> pd.Series:
        x = quantile(u.to_numpy())
        out = 0.0
        for sign in (1, -1):
            a = c + l1 * x * x / 2 - sign * l3 * x
            z = np.maximum(0.0, -a / l2)
            out = out + gamma_q(nu, z) - np.exp(np.minimum(a, 700) - nu * np.log1p(-l2)) * gamma_q(nu, (1 - l2) * z)
        return pd.Series(np.maximum(out / 2, 0.0))

    return _batched(draws.select(counter).withColumn("_u", u), inside("_u"), batch)


def moments(df: DataFrame, columns: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Mean and covariance (n - 1) of the columns, from one aggregate."""
    d = len(columns)
    row = df.agg(*[F.avg(c) for c in columns], *[F.covar_samp(columns[i], columns[j]) for i in range(d) for j in range(d)]).first()
    return np.array(row[:d], float), np.array(row[d:], float).reshape(d, d)


def between(x: DataFrame, y: DataFrame, columns: list[str]):
    """a, b, c of the Gaussians fitted to two tables; with eps added to c the kernel is delta(eps) of x against y."""
    return kernel_of_gaussians(*moments(x, columns), *moments(y, columns))
