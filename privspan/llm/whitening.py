"""Embedding whitening by bit-sliced scatter.

Components become integers. Over the distinct vectors, blocks of rows are shifted to non-negative
integers and cut into bit planes, 64 rows packed to a word. The cross-product of two dimensions is
the sum over pairs of planes of 2^(a+b) times the popcount of their AND: an exact integer, whatever
the order of rows and blocks. Spark adds up what the blocks give; the driver centres the totals as
integers and only then turns them into doubles for eigh.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._shared import scratch

UNIT, SHIFT = 64, 1_000_000
COMPONENTS = 16
#: Rows of a block: planes of 64 words.
BLOCK = 4096
#: A vector with a component beyond this is left out, as its squares would leave 38 digits.
LARGEST = float(1 << 34)


def quantised(table: DataFrame, id_column: str, column: str, dimensions: int | None = None) -> DataFrame:
    """id, x (longs floor(UNIT c) + SHIFT) of the rows whose vector can be used.

    Left out: null and empty vectors, vectors with a null, NaN, infinite or larger than LARGEST
    component, and vectors of another length than `dimensions`; without it the commonest length
    counts, of equally common ones the longest.
    """
    rows = table.select(F.col(id_column).alias("id"), F.transform(column, lambda c: c.cast("double")).alias("v")).where(F.size("v") > 0)
    rows = rows.where(F.forall("v", lambda c: F.coalesce(c.between(-LARGEST, LARGEST), F.lit(False))))
    if dimensions is None:
        commonest = rows.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
        dimensions = commonest.d if commonest else 1
    return rows.where(F.size("v") == dimensions).select("id", F.transform("v", lambda c: F.floor(c * float(UNIT)).cast("long") + SHIFT).alias("x"))


def blocks_of(column: pa.Array) -> Iterator[np.ndarray]:
    """Rows of a column of lists that are equally long, BLOCK at a time."""
    for at in range(0, len(column), BLOCK):
        part = column.slice(at, BLOCK)
        yield part.flatten().to_numpy(zero_copy_only=False).reshape(len(part), -1)


def bit_planes(y: np.ndarray) -> np.ndarray:
    """(bits, columns, words) of non-negative integers: 64 rows to a word, absent rows are zeros."""
    full = np.zeros((-(-len(y) // 64) * 64, y.shape[1]), np.int64)
    full[: len(y)] = y
    bits = range(max(int(y.max(initial=0)).bit_length(), 1))
    return np.stack([np.ascontiguousarray(np.packbits((full >> a & 1).astype(bool), axis=0).T).view(np.uint64) for a in bits])


def cross_products(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sums over rows of x_i x_j and of x_i, as Python integers, from bit planes of x less its least rows."""
    n, d = x.shape
    low = x.min(0)
    planes = bit_planes(x - low)
    counts = np.zeros((2 * len(planes), d, d), np.int64)
    for a, plane in enumerate(planes):
        for b in range(a, len(planes)):
            for i in range(0, d, 64):  # 64 dimensions against all, so that their ANDs stay in the cache
                both = np.bitwise_count(plane[i : i + 64, None] & planes[b][None]).sum(2, dtype=np.int64)
                counts[a + b, i : i + 64] += both
                if a != b:
                    counts[a + b, :, i : i + 64] += both.T
    cross = sum(c.astype(object) << s for s, c in enumerate(counts))
    own = np.bitwise_count(planes).sum(2, dtype=np.int64)
    total = sum(c.astype(object) << s for s, c in enumerate(own))
    low = low.astype(object)
    return cross + np.multiply.outer(low, total) + np.multiply.outer(total, low) + n * np.multiply.outer(low, low), total + n * low


def scatter(fit: DataFrame) -> tuple[int, np.ndarray, np.ndarray]:
    """n, S and C of a table of distinct x: rows, sums and cross-products, exact. C is None for an empty table.

    A task gives one row for each pair of dimensions, which Spark adds up as decimals of 38 digits.
    """

    def run(batches):
        n, cross, total = 0, 0, 0
        for batch in batches:
            for x in blocks_of(batch.column(0)):
                c, s = cross_products(x)
                n, cross, total = n + len(x), cross + c, total + s
        if n:
            i, j = np.triu_indices(len(total))
            values = [n, *total, *cross[i, j]]
            at = [-1, *[-1] * len(total), *i.tolist()], [-1, *range(len(total)), *j.tolist()]
            yield pa.RecordBatch.from_pydict({"i": pa.array(at[0], pa.int32()), "j": pa.array(at[1], pa.int32()), "s": pa.array([Decimal(v) for v in values], pa.decimal128(38, 0))})

    parts = fit.select("x").mapInArrow(run, "i int, j int, s decimal(38,0)")
    sums = {(r.i, r.j): int(r.s) for r in parts.groupBy("i", "j").agg(F.sum("s").cast("decimal(38,0)").alias("s")).collect()}
    d = sum(i == -1 and j >= 0 for i, j in sums)
    total, cross = np.zeros(d, object), np.zeros((d, d), object)
    for (i, j), s in sums.items():
        if i >= 0:
            cross[i, j] = cross[j, i] = s
        elif j >= 0:
            total[j] = s
    return sums.get((-1, -1), 0), total, cross


@dataclass(frozen=True)
class Whitening:
    """n and S of the fit list; variances e and unit components (columns), by falling e; trace of V."""

    n: int
    total: np.ndarray
    variances: np.ndarray
    components: np.ndarray
    trace: float

    @classmethod
    def of(cls, n: int, total: np.ndarray, cross: np.ndarray, components: int = COMPONENTS) -> Whitening:
        """V = (n C - S S') / n^2: integers until one division for each entry. The largest entry of a component is positive."""
        v = ((n * cross - np.multiply.outer(total, total)) / (n * n)).astype(float)
        e, w = np.linalg.eigh(v)
        e, w = e[::-1][:components], w[:, ::-1][:, :components]
        w = w * np.where(w[np.abs(w).argmax(0), np.arange(w.shape[1])] < 0, -1.0, 1.0)
        return cls(n, total, np.maximum(e, 0.0), w, float(np.trace(v)))

    @property
    def spread(self) -> np.ndarray:
        """Whether a component has any variance beyond rounding."""
        return self.variances > self.trace * len(self.total) * np.finfo(float).eps

    def whiten(self, x: np.ndarray) -> np.ndarray:
        """Projections of x - S/n over sqrt(e); NaN for components without variance."""
        whole = np.array([s // self.n for s in self.total], np.int64)
        rest = np.array([s % self.n / self.n for s in self.total])
        centred = (x - whole).astype(float) - rest
        return centred @ (self.components / np.where(self.spread, np.sqrt(self.variances), np.nan))

    def deviation(self, x: np.ndarray) -> list[int]:
        """Sum over dimensions of (n x - S)^2, exact; as integers of 64 bits where they suffice."""
        whole = np.array([s // self.n for s in self.total], np.int64)
        rest = self.total - self.n * whole.astype(object)
        off = x - whole
        most = self.n * (int(np.abs(off).max(initial=0)) + 1)
        if most * most * x.shape[1] < 1 << 62:
            return ((self.n * off - rest.astype(np.int64)) ** 2).sum(1).tolist()
        return ((self.n * off.astype(object) - rest) ** 2).sum(1).tolist()


def identity_error(fit: DataFrame, found: Whitening) -> float | None:
    """Largest absolute entry of the covariance of what whitening makes of the fit list, minus the identity.

    Measured over the rows, not derived from V. Components without variance don't count; None if
    there are no others.
    """
    use = np.flatnonzero(found.spread)
    if not len(use):
        return None

    def run(batches):
        sums, n = 0.0, 0
        for batch in batches:
            for x in blocks_of(batch.column(0)):
                w = found.whiten(x)[:, use]
                sums, n = sums + np.vstack([w.T @ w, w.sum(0)]), n + len(x)
        if n:
            i, j = np.indices(sums.shape).reshape(2, -1)
            yield pa.RecordBatch.from_pydict({"i": pa.array(i, pa.int32()), "j": pa.array(j, pa.int32()), "s": pa.array(sums.ravel(), pa.float64())})

    got = np.zeros((len(use) + 1, len(use)))
    for r in fit.select("x").mapInArrow(run, "i int, j int, s double").groupBy("i", "j").agg(F.sum("s").alias("s")).collect():
        got[r.i, r.j] = r.s / found.n
    return float(np.abs(got[:-1] - np.multiply.outer(got[-1], got[-1]) - np.eye(len(use))).max())


def whitened(table: DataFrame, id_column: str = "vec_id", column: str = "embedding", components: int = COMPONENTS, dimensions: int | None = None) -> DataFrame:
    """id_column, component, n, deviation (decimal), whitened, explained, identity_error: one row a vector and component.

    The fit list is each distinct vector once, so that a third of all rows may be copies of one.
    quantised() says which vectors are left out; other columns are ignored, whatever their names.
    Rows are kept as often as they come, with null ids too. A component without variance (equal
    vectors, a single one, fewer vectors than dimensions) has whitened null and explained 0; a
    deviation beyond 38 digits is null. An empty table gives no rows. d^2 numbers reach the driver.
    """
    schema = f"id {dict(table.dtypes)[id_column]}, n_x decimal(38,0), w array<double>"
    rows = quantised(table, id_column, column, dimensions)
    with scratch() as keep:
        fit = keep(rows.select("x").distinct(), "distinct-vectors")
        n, total, cross = scatter(fit)
        found = Whitening.of(n, total, cross, components) if n else None
        error = identity_error(fit, found) if n else None

    def run(batches):
        for batch in batches:
            at = 0
            for x in blocks_of(batch.column(1)) if found else ():
                far = [Decimal(v) if v < 10**38 else None for v in found.deviation(x)]
                w = np.where(found.spread, found.whiten(x), np.nan)
                w = pa.ListArray.from_arrays(pa.array(np.arange(0, w.size + 1, w.shape[1]), pa.int32()), pa.array(w.ravel(), pa.float64(), from_pandas=True))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, len(x)), pa.array(far, pa.decimal128(38, 0)), w], ["id", "n_x", "w"])
                at += len(x)

    shares = (found.variances / found.trace if found and found.trace else np.zeros(len(found.variances) if found else 1)).tolist()
    out = rows.mapInArrow(run, schema).select("id", "n_x", F.posexplode("w").alias("at", "value"))
    return out.select(
        F.col("id").alias(id_column), (F.col("at") + 1).alias("component"), F.lit(n).cast("long").alias("n"), F.col("n_x").alias("deviation"),
        F.col("value").alias("whitened"), F.element_at(F.array(*map(F.lit, shares)), F.col("at") + 1).alias("explained"), F.lit(error).cast("double").alias("identity_error"),
    )


def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 16 components of every vector; a deviation beyond a long is null."""
    out = whitened(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
    return out.withColumn("deviation", F.expr("try_cast(deviation as bigint)"))
