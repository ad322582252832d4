"""Private projections and least squares: samplers over keyed draws, independent of partitioning.

A sketch multiplies the table by a Gaussian matrix whose entry for (draw, k, row) comes from the
counter generator, block by block, so it is one pass with partial sums: rows meet only as r x d
sums a draw.
Rows of sigma times the identity added below the table give the same sums as sigma times one
more normal draw a coordinate, which is what is done.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import linear, rng
from .relational import SENTINEL, union_sources


#: Normals of one block of rows (8 bytes each), and sums that a task holds.
BLOCK_NORMALS, MOST_SUMS = 1 << 20, 1 << 22
#: Normals a row from which rows are dealt to all cores: their time is far above that of moving a row.
DEALT_FROM = 32


def _partial_sums(df: DataFrame, key_column: str, columns: list[str], r: int, first: int, draws: int, key: str) -> DataFrame:
    """draw, k and sums over the rows of each task, for draws first .. first + draws - 1."""

    def run(batches):
        draw, k = np.divmod(np.arange(draws * r), r)
        draw += first
        sums = np.zeros((draws * r, len(columns)))
        step = max(BLOCK_NORMALS // (draws * r), 1)
        for batch in batches:
            rows = batch.column(0).fill_null(0).to_numpy(zero_copy_only=False)
            x = np.stack([c.fill_null(0.0).to_numpy(zero_copy_only=False) for c in batch.columns[1:]], axis=1)
            for at in range(0, len(rows), step):
                sums += rng.grid_normals(key, "row", rows[at : at + step], draw, k).T @ x[at : at + step]
        yield pa.RecordBatch.from_pydict({"draw": pa.array(draw, pa.int32()), "k": pa.array(k, pa.int32()), **{f"s{j}": sums[:, j] for j in range(len(columns))}})

    wanted = [F.col(key_column).cast("long"), *[F.col(c).cast("double").alias(f"c{j}") for j, c in enumerate(columns)]]
    rows = df.select(wanted)
    if draws * r >= DEALT_FROM:
        rows = rows.repartition(max(df.sparkSession.sparkContext.defaultParallelism, 1))
    return rows.mapInArrow(run, "draw int, k int, " + ", ".join(f"s{j} double" for j in range(len(columns))))


def project(df: DataFrame, key_column: str, columns: list[str], r: int, draws: int, key: str, noise: float = 0.0) -> DataFrame:
    """draw, k, and per column the sum over rows of g(draw, k, row) x, plus noise times g(draw, k, column).

    Each task multiplies blocks of normals with blocks of rows and gives its sums, so no row is
    repeated and only r x draws rows a task are shuffled. With many draws the rows are dealt to as many tasks as
    there are cores first, as a file of few bytes is one task however many rows it holds. Draws whose sums would not fit in a
    task are left to further passes. Nulls count as zero.
    """
    at_once = max(MOST_SUMS // (r * len(columns)), 1)
    parts = [_partial_sums(df, key_column, columns, r, first, min(at_once, draws - first), key) for first in range(0, draws, at_once)]
    sums = union_sources(parts).groupBy("draw", "k").agg(*[F.sum(f"s{j}").alias(c) for j, c in enumerate(columns)])
    if noise:
        sums = sums.withColumns({c: F.col(c) + noise * rng.normal(key, "noise", F.col("draw"), F.col("k"), F.lit(j)) for j, c in enumerate(columns)})
    return sums


def project_by_distribution(df: DataFrame, columns: list[str], r: int, draws: int, key: str, noise: float = 0.0) -> DataFrame:
    """The same distribution without the rows: r x d normals a draw through a root of the Gram matrix."""
    _, g = linear.gram_matrix(df, columns)
    root = np.linalg.cholesky(g + noise * noise * np.eye(len(columns)))
    cells = df.sparkSession.range(draws * r).select((F.col("id") / r).cast("long").alias("draw"), (F.col("id") % r).alias("k"))
    cells = cells.withColumns({f"_z{j}": rng.normal(key, "cell", F.col("draw"), F.col("k"), F.lit(j)) for j in range(len(columns))})
    return cells.select("draw", "k", *[linear.total(F.col(f"_z{j}") * float(root[i, j]) for j in range(i + 1)).alias(c) for i, c in enumerate(columns)])


def solve_sketch(sketch: DataFrame, features: list[str], target: str) -> DataFrame:
    """draw, beta: least squares on each draw's sketched rows, from their Gram sums."""
    columns = [*features, target]
    d = len(columns)
    sums = [F.sum(F.col(columns[i]) * F.col(columns[j])) for i in range(d) for j in range(d)]
    grams = sketch.groupBy("draw").agg(F.array(*sums).alias("gram"))

    @F.pandas_udf("array<double>")
    def solve(gram: pd.Series) -> pd.Series:
        g = np.array(gram.tolist()).reshape(-1, d, d)
        return pd.Series(list(np.linalg.solve(g[:, :-1, :-1], g[:, :-1, -1:])[:, :, 0]))

    return grams.select("draw", solve("gram").alias("beta"))


def sketch_least_squares(df: DataFrame, key_column: str, features: list[str], target: str, r: int, draws: int, key: str, noise: float = 0.0) -> DataFrame:
    """Sketch and solve: draw, beta."""
    return solve_sketch(project(df, key_column, [*features, target], r, draws, key, noise), features, target)


def gaussian_draws(df: DataFrame, mean: np.ndarray, covariance: np.ndarray, draws: int, key: str, stream: str = "beta") -> DataFrame:
    """draw, beta_0 .. : draws from N(mean, covariance)."""
    root, d = np.linalg.cholesky(covariance), len(mean)
    out = df.sparkSession.range(draws).select(F.col("id").alias("draw"))
    out = out.withColumns({f"_z{j}": rng.normal(key, stream, F.col("draw"), F.lit(j)) for j in range(d)})
    return out.select("draw", *[(F.lit(float(mean[i])) + linear.total(F.col(f"_z{j}") * float(root[i, j]) for j in range(i + 1))).alias(f"beta_{i}") for i in range(d)])


def regularised(fit: linear.Fit, sigma: float, rho: float = 0.0) -> linear.Fit:
    """The fit with sigma times the identity below features and target, and a row of zeros with target rho."""
    h = fit.gram @ fit.beta
    gram = fit.gram + sigma * sigma * np.eye(fit.d)
    m = linear.inverse(gram)
    beta = m @ h
    yy = fit.rss + float(h @ fit.beta) + sigma * sigma + rho * rho
    return linear.Fit(fit.features, fit.target, fit.n, gram, m, beta, yy - float(h @ beta))


def asymptotic_least_squares(df: DataFrame, fit: linear.Fit, r: int, draws: int, key: str, sigma: float = 0.0, rho: float = 0.0) -> DataFrame:
    """Draws of what a sketch of r rows gives in the limit: N(beta, rss / r (B'B)^-1), after noise rows if sigma or rho is given."""
    fit = regularised(fit, sigma, rho) if sigma or rho else fit
    return gaussian_draws(df, fit.beta, fit.covariance(r), draws, key)


def output_noise(df: DataFrame, fit: linear.Fit, sigma: float, draws: int, key: str) -> DataFrame:
    return gaussian_draws(df, fit.beta, sigma * sigma * np.eye(fit.d), draws, key, "output")


def information_noise(least_rest: float, r: int, eps: float) -> float:
    """Noise of the projection that bounds mutual information by eps bits a row, given least_column_rest()."""
    return math.sqrt(max(r / (2 ** (2 * eps) - 1) - least_rest * least_rest, 0.0))


def labelled_samples(df: DataFrame, key_column: str, columns: list[str], left_out, eps: float, draws: int, key: str, r: int = 1, noise: float = 0.0) -> DataFrame:
    """sample_id, y, x: projections of the table (y = 1) and of its neighbour without one row (y = 0).

    Samples of the table are replaced by sentinels with probability 1 - e^-eps.
    """
    parts = []
    for y, rows in ((1, df), (0, linear.neighbor_matrix(df, key_column, left_out, columns))):
        sums = project(rows, key_column, columns, r, draws, f"{key}.{y}", noise)
        parts.append(sums.groupBy("draw").agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("k", F.array(*columns).alias("x")))), lambda s: s["x"])).alias("x")).withColumn("y", F.lit(float(y))))
    return _with_sentinels(union_sources(parts), eps, key)


def _with_sentinels(rows: DataFrame, eps: float, key: str) -> DataFrame:
    """sample_id, y, x of rows (draw, y, x), with sentinels in place of some samples of the table."""
    drop = (F.col("y") == 1) & (rng.uniform(key, "dummy", F.col("draw")) < 1 - math.exp(-eps))
    dummy: Column = F.transform("x", lambda _: F.lit(SENTINEL))
    return rows.select((F.col("draw") * 2 + F.col("y").cast("long")).alias("sample_id"), "y", F.when(drop, dummy).otherwise(F.col("x")).alias("x"))


def neighbor_samples(df: DataFrame, key_column: str, columns: list[str], left_out: Column, eps: float, draws: int, key: str, r: int = 1, noise: float = 0.0) -> tuple[DataFrame, DataFrame]:
    """labelled_samples() for every neighbour at once: (sample_id, y, x) of the table, and (left_out, sample_id, y, x).

    left_out is a condition: each key of its rows is one neighbour. The sketch of a neighbour is
    that of the table less g(draw, k, row) x_row, so two passes over the table serve all of
    them, and a neighbour costs r x draws normals. Rows of one key are left out together; null
    keys are no neighbours. The table's samples are the same for all neighbours.
    """
    d = len(columns)
    flat = F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("k", F.array(*columns).alias("x")))), lambda s: s["x"]))
    table, whole = (project(df, key_column, columns, r, draws, f"{key}.{y}", noise).groupBy("draw").agg(flat.alias("x")) for y in (1, 0))
    named = [F.col(c).cast("double").alias(f"c{j}") for j, c in enumerate(columns)]
    rows = df.where(left_out).where(F.col(key_column).isNotNull()).select(F.col(key_column).cast("long").alias("left_out"), *named)
    rows = rows.groupBy("left_out").agg(*[F.coalesce(F.sum(f"c{j}"), F.lit(0.0)).alias(f"c{j}") for j in range(d)])

    def run(batches):
        draw, k = np.divmod(np.arange(draws * r), r)
        step = max(BLOCK_NORMALS // (draws * r * d), 1)
        for batch in batches:
            keys, x = batch.column(0).to_numpy(), np.stack([c.to_numpy() for c in batch.columns[1:]], axis=1)
            for at in range(0, len(keys), step):
                own = keys[at : at + step]
                part = rng.grid_normals(f"{key}.0", "row", own, draw, k)[:, :, None] * x[at : at + step, None]
                lists = pa.ListArray.from_arrays(pa.array(np.arange(0, part.size + 1, r * d), pa.int32()), pa.array(part.ravel()))
                yield pa.RecordBatch.from_pydict({"left_out": pa.array(np.repeat(own, draws)), "draw": pa.array(np.tile(np.arange(draws, dtype=np.int32), len(own))), "own": lists})

    parts = rows.mapInArrow(run, "left_out long, draw int, own array<double>").join(whole, "draw")
    parts = parts.select("left_out", (F.col("draw").cast("long") * 2).alias("sample_id"), F.lit(0.0).alias("y"), F.zip_with("x", "own", lambda a, b: a - b).alias("x"))
    return _with_sentinels(table.withColumn("y", F.lit(1.0)), eps, key), parts


def labelled_least_squares(df: DataFrame, key_column: str, features: list[str], target: str, left_out, eps: float, draws: int, key: str, r: int) -> DataFrame:
    """The same of coefficients by sketch and solve."""
    parts = []
    for y, rows in ((1, df), (0, linear.neighbor_matrix(df, key_column, left_out, [*features, target]))):
        solved = sketch_least_squares(rows, key_column, features, target, r, draws, f"{key}.{y}")
        parts.append(solved.select("draw", F.col("beta").alias("x"), F.lit(float(y)).alias("y")))
    return _with_sentinels(union_sources(parts), eps, key)


def labelled_asymptotic(df: DataFrame, fit: linear.Fit, other: linear.Fit, eps: float, draws: int, key: str, r: int) -> DataFrame:
    """The same of draws from the limiting distributions of two fits, the second without a row."""
    parts = []
    for y, own in ((1, fit), (0, other)):
        drawn = asymptotic_least_squares(df, own, r, draws, f"{key}.{y}")
        parts.append(drawn.select("draw", F.array(*[f"beta_{i}" for i in range(own.d)]).alias("x"), F.lit(float(y)).alias("y")))
    return _with_sentinels(union_sources(parts), eps, key)
