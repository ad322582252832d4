"""Feature preparation: keys, unions, joins, cleaning, imputing, indicators, filters and set operations."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .linear import total


def padded_key(*parts: tuple[Column, int]) -> Column:
    """Numbers padded with zeros to their widths and put together; null if any is."""
    return F.concat(*[F.lpad(c.cast("bigint").cast("string"), width, "0") for c, width in parts])


def union_sources(sources: list[DataFrame]) -> DataFrame:
    """All rows of sources with the same columns, in any order of columns."""
    return reduce(DataFrame.unionByName, sources)


def join_chain(tables: list[DataFrame], on: str | list[str]) -> DataFrame:
    return reduce(lambda a, b: a.join(b, on, "inner"), tables)


def row_sum(columns: list[str], name: str) -> Column:
    return total(F.col(c) for c in columns).alias(name)


def coerce(df: DataFrame, columns: list[str]) -> DataFrame:
    """Text to numbers; what is no number is null."""
    return df.withColumns({c: F.expr(f"try_cast(`{c}` AS DOUBLE)") for c in columns})


#: Cells of one round of exact_median(), a power of two, and values that it may bring to the driver.
CELLS, FEW = 1 << 13, 10_000


def _ordered(x: np.ndarray) -> np.ndarray:
    """64-bit words in the order of the doubles, both zeros being one."""
    bits = (x + 0.0).view(np.uint64)
    top = np.uint64(1 << 63)
    return np.where(bits & top, ~bits, bits | top)


def _unordered(word: int) -> float:
    word = word ^ (1 << 63) if word >> 63 else ~word & (1 << 64) - 1
    return float(np.array([word], np.uint64).view(np.float64)[0])


def exact_median(df: DataFrame, column: str) -> float | None:
    """The median by rounds over the bits of the doubles, in their order, some at a time.

    A round counts by the next bits the values that share the bits found before, for both middle
    ranks at once; each task gives as many rows as there are such bits. There are five rounds at
    most, whatever the values: infinities count as numbers, nulls and NaN not at all. As soon as
    FEW values are left they are sorted. The middle of both infinities is NaN.
    """
    x, most = df.select(F.col(column).cast("double").alias("x")).where("x is not null and not isnan(x)"), CELLS.bit_length() - 1

    def counts(known: dict[int, int], bits: int) -> dict[int, int]:
        """Values by their first bits + most bits, of those whose first `bits` are known."""
        shift, before = np.uint64(max(64 - bits - most, 0)), np.array(sorted(known), np.uint64)

        def run(batches):
            found: dict[int, int] = {}
            for batch in batches:
                word = _ordered(batch.column(0).to_numpy(zero_copy_only=False))
                if bits:
                    word = word[np.isin(word >> np.uint64(64 - bits), before)]
                for cell, n in zip(*(a.tolist() for a in np.unique(word >> shift, return_counts=True))):
                    found[cell] = found.get(cell, 0) + n
            yield pa.RecordBatch.from_pydict({"cell": pa.array([str(c) for c in found], pa.string()), "n": pa.array(found.values(), pa.int64())})

        return {int(c): n for c, n in x.mapInArrow(run, "cell string, n long").groupBy("cell").agg(F.sum("n")).collect()}

    found = counts({}, 0)
    n, bits, step = sum(found.values()), most, most
    if not n:
        return None
    below = {rank: rank for rank in {(n - 1) // 2, n // 2}}
    cell = dict.fromkeys(below, 0)
    while True:
        for rank in below:  # the cell of each rank, and its rank within
            for c in sorted(c for c in found if c >> step == cell[rank]):
                if below[rank] < found[c]:
                    cell[rank] = c
                    break
                below[rank] -= found[c]
        wanted = set(cell.values())
        if bits >= 64:
            values = {rank: _unordered(c) for rank, c in cell.items()}
            break
        if sum(found[c] for c in wanted) <= FEW:
            ends = [(_unordered(c << 64 - bits), _unordered((c + 1 << 64 - bits) - 1)) for c in wanted]
            values = {}
            for c, (low, high) in zip(wanted, ends):
                # The last words on either side are NaN, which never occur.
                low, high = (-np.inf if np.isnan(low) else low), (np.inf if np.isnan(high) else high)
                here = sorted(r.x + 0.0 for r in x.where(F.col("x").between(low, high)).collect())
                values |= {rank: here[below[rank]] for rank in below if cell[rank] == c}
            break
        step = min(most, 64 - bits)
        found, bits = counts(wanted, bits), bits + step
    low, high = min(values.values()), max(values.values())
    return low if low == high else low / 2 + high / 2


def fill_median(df: DataFrame, columns: list[str]) -> DataFrame:
    """Nulls become the column's median; a column without any value stays null."""
    found = {c: exact_median(df, c) for c in columns}
    return df.withColumns({c: F.coalesce(c, F.lit(x)) for c, x in found.items() if x is not None})


def numbered(df: DataFrame, key: str, name: str = "i", parts: int | None = None) -> DataFrame:
    """df with the rows' numbers 0 .. n-1 in the order of a key, whatever its gaps.

    Quantiles of the key, as literals, divide the rows into parts; a part's rows are numbered by
    themselves, from the number of rows in the parts before.
    """
    parts = parts or max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), 1)
    shares = [i / parts for i in range(1, parts)]
    bounds = sorted(set(df.agg(F.percentile_approx(key, shares, 10_000)).first()[0] or [])) if shares else []
    part = F.size(F.filter(F.array(*map(F.lit, bounds)), lambda b: b < F.col(key))) if bounds else F.lit(0)
    rows = df.withColumn("_part", part)
    sizes = dict(rows.groupBy("_part").count().collect())
    starts = [sum(n for p, n in sizes.items() if p < i) for i in range(len(bounds) + 1)]
    own = F.row_number().over(Window.partitionBy("_part").orderBy(key))
    return rows.withColumn(name, own - 1 + F.element_at(F.array(*[F.lit(x).cast("long") for x in starts]), F.col("_part") + 1)).drop("_part")


def indicators(df: DataFrame, column: str, values: dict[str, str]) -> DataFrame:
    """A 0/1 column of each name for its value; null is 0."""
    return df.withColumns({name: F.when(F.col(column) == v, 1.0).otherwise(0.0) for name, v in values.items()})


def per_capita(df: DataFrame, columns: list[str], population: str, by: float = 1e5) -> DataFrame:
    return df.withColumns({f"{c}_pc": F.try_divide(F.col(c), F.col(population)) * by for c in columns})


def common_values(a: DataFrame, b: DataFrame) -> DataFrame:
    """One row: how many distinct values the two one-column tables share."""
    return a.intersect(b).agg(F.count("*").alias("cardinality"))


def county_features(parts: list[DataFrame], on: str, population: str, rate: str, trend: str, counts: list[str], others: list[str], target: str) -> DataFrame:
    """The whole feature preparation: tables joined by their key, features and target of each complete county.

    parts hold text or numbers. Rows whose target is `*` go; a missing rate becomes the median; a trend
    of `*` counts as stable; counts also come per 100,000 of the population; `constant` is 1.
    """
    joined = join_chain(parts, on).where(F.col(target).cast("string") != "*")
    joined = coerce(joined, [*others, population, rate, *counts, target])
    joined = indicators(joined.withColumn(trend, F.when(F.col(trend) == "*", "stable").otherwise(F.col(trend))), trend, {"falling": "falling", "rising": "rising"})
    joined = per_capita(fill_median(joined, [rate]), counts, population)
    return joined.select(on, *[f"{c}_pc" for c in counts], *others, rate, population, "falling", "rising", *counts, F.lit(1.0).alias("constant"), target)


def within_norm(df: DataFrame, column: str, threshold: float) -> DataFrame:
    """Rows whose array has no value of threshold or more, up or down."""
    return df.where(F.array_max(F.transform(column, F.abs)) < threshold)


SENTINEL, SENTINEL_FROM = 1e9, 1e7


def without_dummies(df: DataFrame, column: str) -> DataFrame:
    """Rows whose first coordinate is below the sentinels'."""
    return df.where(F.element_at(column, 1) < SENTINEL_FROM)


def standard_vector(d: int, index: Column) -> Column:
    return F.transform(F.sequence(F.lit(0), F.lit(d - 1)), lambda i: F.when(i == index, 1.0).otherwise(0.0))


def joined_text(columns: list[Column]) -> Column:
    return F.concat_ws(",", *[c.cast("string") for c in columns])


def geometric(step: float, first: float, length: int, index: Column) -> Column:
    """index of 0..length-1: first times step to the index."""
    return F.when(index < length, F.lit(first) * F.pow(F.lit(step), index))


def multiples(step: float, first: float, index: Column) -> Column:
    return F.lit(first) * (index + 1) * step


def sorted_rows(df: DataFrame, keys: list[str], payload: str) -> DataFrame:
    """Sorted by the keys and the payload: Spark's range partitions and spilling sort in place of merged runs."""
    return df.select(*keys, payload).orderBy(*keys, payload)
