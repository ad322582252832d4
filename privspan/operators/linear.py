"""A table as a matrix: Gram sums, least squares, residuals, leverages and closed forms of neighbours.

Two scans answer every question about all rows: one aggregate of products, whose small square
matrix is inverted on the driver, and one projection in which that inverse is a literal.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def total(columns) -> Column:
    return reduce(lambda a, b: a + b, columns)


def gram(df: DataFrame, columns: list[str]) -> DataFrame:
    """One row: n and the sums g_i_j (i <= j) of products of the columns. Nulls leave a product out."""
    pairs = [(i, j) for i in range(len(columns)) for j in range(i, len(columns))]
    return df.agg(F.count("*").alias("n"), *[F.sum(F.col(columns[i]) * F.col(columns[j])).alias(f"g_{i}_{j}") for i, j in pairs])


def gram_matrix(df: DataFrame, columns: list[str]) -> tuple[int, np.ndarray]:
    row = gram(df, columns).first().asDict()
    d = len(columns)
    out = np.zeros((d, d))
    for i in range(d):
        for j in range(i, d):
            out[i, j] = out[j, i] = row[f"g_{i}_{j}"] or 0.0
    return row["n"], out


def gram_of_arrays(df: DataFrame, column: str, d: int) -> np.ndarray:
    """Gram matrix of an array column: one partial d x d matrix a task, added up by Spark."""

    def partial(batches):
        out = np.zeros((d, d))
        for batch in batches:
            x = batch.column(0).flatten().to_numpy(zero_copy_only=False).reshape(-1, d)
            out += x.T @ x
        yield pa.RecordBatch.from_pydict({"i": pa.array(range(d * d), pa.int32()), "v": pa.array(out.ravel())})

    whole = F.col(column).isNotNull() & ~F.coalesce(F.exists(column, F.isnull), F.lit(True)) & (F.size(column) == d)
    rows = df.where(whole).select(F.col(column).cast("array<double>")).mapInArrow(partial, "i int, v double").groupBy("i").agg(F.sum("v").alias("v")).orderBy("i").collect()
    return np.array([r.v for r in rows]).reshape(d, d) if rows else np.zeros((d, d))


def inverse(g: np.ndarray) -> np.ndarray:
    """Inverse with columns brought to one scale first; LinAlgError if the columns depend on each other."""
    scale = np.sqrt(np.diag(g))
    if (scale <= 0).any():
        raise np.linalg.LinAlgError("a column is zero")
    unit = g / np.outer(scale, scale)
    if np.linalg.cond(unit) > 1e14:
        raise np.linalg.LinAlgError("columns depend on each other")
    return np.linalg.inv(unit) / np.outer(scale, scale)


def quadratic(columns: list[str], m: np.ndarray) -> Column:
    """x' M x as a Column, with M as literals."""
    d = len(columns)
    terms = [F.col(columns[i]) * F.col(columns[i]) * float(m[i, i]) for i in range(d)]
    terms += [F.col(columns[i]) * F.col(columns[j]) * float(m[i, j] + m[j, i]) for i in range(d) for j in range(i)]
    return total(terms)


def dot(columns: list[str], v) -> Column:
    return total(F.col(c) * float(x) for c, x in zip(columns, v))


@dataclass(frozen=True)
class Fit:
    """Least squares of target on features: everything that neighbours' closed forms need."""

    features: list[str]
    target: str
    n: int
    gram: np.ndarray
    m: np.ndarray
    beta: np.ndarray
    rss: float

    @property
    def d(self) -> int:
        return len(self.features)

    def residual(self) -> Column:
        return F.col(self.target) - dot(self.features, self.beta)

    def leverage(self) -> Column:
        return quadratic(self.features, self.m)

    def rows(self, df: DataFrame) -> DataFrame:
        """df with p (leverage), w (residual) and q (leverage of features and target together)."""
        df = df.withColumn("p", self.leverage()).withColumn("w", self.residual())
        return df.withColumn("q", F.col("p") + F.col("w") * F.col("w") / self.rss)

    def neighbor_beta(self) -> list[Column]:
        """Coefficients without the row; needs p and w."""
        return [F.lit(float(b)) - F.col("w") / (1 - F.col("p")) * dot(self.features, self.m[j]) for j, b in enumerate(self.beta)]

    def neighbor_rss(self) -> Column:
        return F.lit(self.rss) - F.col("w") * F.col("w") / (1 - F.col("p"))

    def log_det_ratio(self) -> Column:
        """ln |Q'| / |Q| of the asymptotic covariances without and with the row."""
        return -F.ln(1 - F.col("p")) + self.d * F.ln(1 - F.col("w") * F.col("w") / ((1 - F.col("p")) * self.rss))

    def covariance(self, r: int) -> np.ndarray:
        return self.rss / r * self.m

    def without(self, x, y: float) -> Fit:
        """The fit without one row (x, y); LinAlgError if the others' columns then depend on each other."""
        x = np.asarray(x, np.float64)
        if 1 - float(x @ self.m @ x) < 1e-10:
            raise np.linalg.LinAlgError("columns depend on each other without the row")
        gram, h = self.gram - np.outer(x, x), self.gram @ self.beta - x * y
        m = inverse(gram)
        beta = m @ h
        yy = self.rss + float(self.beta @ self.gram @ self.beta) - y * y
        return Fit(self.features, self.target, self.n - 1, gram, m, beta, float(max(yy - h @ beta, 0.0)))


def fit(df: DataFrame, features: list[str], target: str) -> Fit:
    n, g = gram_matrix(df, [*features, target])
    b, h, yy = g[:-1, :-1], g[:-1, -1], g[-1, -1]
    m = inverse(b)
    beta = m @ h
    return Fit(features, target, n, b, m, beta, float(max(yy - h @ beta, 0.0)))


def normalize_features(df: DataFrame, columns: list[str], clip: float | None = None) -> DataFrame:
    """Each column over its norm, zero columns as they are; with clip, the whole matrix then over its spectral norm, times clip."""
    _, g = gram_matrix(df, columns)
    norms = np.sqrt(np.diag(g))
    norms = np.where(norms > 0, norms, 1.0)
    scale = 1.0
    if clip is not None:
        scale = clip / math.sqrt(float(np.linalg.eigvalsh(g / np.outer(norms, norms)).max()))
    return df.withColumns({c: F.col(c) * (scale / float(x)) for c, x in zip(columns, norms)})


def normalize_rows(df: DataFrame, features: list[str], target: str) -> DataFrame:
    """Each row's features to norm one (zero rows as they are) and the target to its sign."""
    norm = F.sqrt(total(F.col(c) * F.col(c) for c in features))
    df = df.withColumn("_norm", F.when(norm > 0, norm).otherwise(1.0))
    return df.withColumns({c: F.col(c) / F.col("_norm") for c in features}).withColumn(target, F.signum(target)).drop("_norm")


def row_norm(columns: list[str]) -> Column:
    return F.sqrt(total(F.col(c) * F.col(c) for c in columns))


def largest_norm(df: DataFrame, columns: list[str]) -> DataFrame:
    return df.agg(F.max(row_norm(columns)).alias("largest_l2"))


def largest_leverage(df: DataFrame, fit_: Fit, key: str, augmented: bool = True) -> DataFrame:
    """One row: key of the largest (augmented) leverage, the first key of equal ones; p, q and the residual's share q - p."""
    rows = fit_.rows(df)
    by = F.col("q" if augmented else "p")
    best = rows.agg(F.max(F.struct(by.alias("by"), (-F.col(key)).alias("minus"), "p", "q")).alias("m"))
    return best.select((-F.col("m.minus")).alias(key), "m.p", "m.q", (F.col("m.q") - F.col("m.p")).alias("residual_share"))


def sensitivity(df: DataFrame, fit_: Fit, key: str) -> DataFrame:
    """One row: the largest change of the coefficients by leaving a row out, |w| |M x| / (1 - p), and its key."""
    change = F.abs("w") * F.sqrt(quadratic(fit_.features, fit_.m @ fit_.m)) / (1 - F.col("p"))
    best = fit_.rows(df).agg(F.max(F.struct(change.alias("s"), (-F.col(key)).alias("minus"))).alias("m"))
    return best.select((-F.col("m.minus")).alias(key), F.col("m.s").alias("sensitivity"))


def least_column_rest(df: DataFrame, columns: list[str]) -> DataFrame:
    """One row: the least over columns of sqrt(|column|^2 - its largest square)."""
    rests = [F.sqrt(F.sum(F.col(c) * F.col(c)) - F.max(F.col(c) * F.col(c))) for c in columns]
    return df.agg((F.least(*rests) if len(rests) > 1 else rests[0]).alias("c"))


def added_rows_constant(df: DataFrame, columns: list[str], r: int, eps: float, delta: float, bound: float | None = None) -> DataFrame:
    """One row: the size of the identity rows added before projection, from the largest row norm or a public bound."""
    log = math.log(4 / delta)
    factor = 4 * (math.sqrt(2 * r * log) + log) / eps
    if bound is not None:
        return df.limit(1).agg(F.lit(math.sqrt(factor * bound * bound)).alias("c"))
    return df.agg(F.sqrt(factor * F.max(total(F.col(c) * F.col(c) for c in columns))).alias("c"))


def asymptotic_error(df: DataFrame, fit_: Fit, r_values: list[int]) -> DataFrame:
    """r, expected squared error of a sketch of r rows: trace(M) rss / r."""
    rows = gram(df, [*fit_.features, fit_.target]).select(F.explode(F.array(*map(F.lit, r_values))).alias("r"))
    return rows.select("r", (F.lit(float(np.trace(fit_.m)) * fit_.rss) / F.col("r")).alias("error"))


def smooth_leverage_bound(df: DataFrame, fit_: Fit, ell: float, b: float) -> DataFrame:
    """One row: an upper bound of the b-smooth leverage, if no row is longer than ell.

    k rows of change cost b^-k and bring the least eigenvalue down by k ell^2; from the k at
    which it may reach zero a leverage can be 1.
    """
    least = float(np.linalg.eigvalsh(fit_.gram).min())
    if ell <= 0 or b <= 1 or least <= 0:
        raise ValueError("ell > 0, b > 1 and columns of full rank are needed")
    steps = math.ceil(least / ell**2)
    own = df.agg(F.max(fit_.leverage()).alias("own"))
    k = F.sequence(F.lit(1), F.lit(max(steps - 1, 1)))
    rest = lambda k: F.lit(least) - k * F.lit(ell**2)
    step = lambda k: F.pow(F.lit(float(b)), -k) * F.when(rest(k) > ell**2, F.lit(ell**2) / rest(k)).otherwise(1.0)
    near = F.array_max(F.transform(k, step)) if steps > 1 else F.lit(0.0)
    return own.select(F.greatest("own", near, F.lit(float(b) ** -steps)).alias("bound"))


def gram_entries(g: np.ndarray) -> list[Column]:
    """The upper triangle of a small matrix as structs i, j, value."""
    return [F.struct(F.lit(i).alias("i"), F.lit(j).alias("j"), F.lit(float(g[i, j])).alias("value")) for i in range(len(g)) for j in range(i, len(g))]


def row_of(df: DataFrame, key: str, value, columns: list[str]) -> np.ndarray:
    """The values of one row by its key; KeyError if there is none."""
    row = df.where(F.col(key) == value).select(*columns).first()
    if row is None:
        raise KeyError(value)
    return np.array(row, np.float64)


def kronecker_covariance(g: np.ndarray, r: int) -> np.ndarray:
    """Covariance of all entries of r projections, column after column: one block G for each."""
    return np.kron(np.eye(r), g)


def neighbor_matrix(df: DataFrame, key: str, value, columns: list[str]) -> DataFrame:
    """The neighbour that has one row's columns zeroed."""
    return df.withColumns({c: F.when(F.col(key) == value, 0.0).otherwise(F.col(c)) for c in columns})
