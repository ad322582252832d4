"""Gram sums over event time: the same state for a stream and for a table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def windowed_gram(df: DataFrame, time: str, columns: list[str], width: str, late: str = "10 minutes") -> DataFrame:
    """window start, n and the sums g_i_j by tumbling window of event time.

    The sums add up, so a stream keeps one row a window; rows later than `late` are dropped there.
    """
    df = df.withColumn(time, F.col(time).cast("timestamp"))
    df = df.withWatermark(time, late) if df.isStreaming else df
    pairs = [(i, j) for i in range(len(columns)) for j in range(i, len(columns))]
    sums = [F.sum(F.col(columns[i]) * F.col(columns[j])).alias(f"g_{i}_{j}") for i, j in pairs]
    return df.groupBy(F.window(time, width)).agg(F.count("*").alias("n"), *sums).select(F.col("window.start").alias("start"), "n", *[f"g_{i}_{j}" for i, j in pairs])
