"""A joint histogram that is updated batch by batch: the same state for a stream and for a table.

The state is a folder with the counts of each batch in a folder of its own. A batch that comes again
replaces its counts, so each counts once however often it is delivered.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from privspan.operators.relational import union_sources


def label_counts(df: DataFrame, y: str, x: str) -> DataFrame:
    """x, n0, n1: rows by outcome and label; labels other than 0 and 1, null among them, don't count. Null is an outcome."""
    n0, n1 = (F.count_if(F.col(y) == label).alias(f"n{label}") for label in (0, 1))
    return df.where(F.col(y).isin(0, 1)).groupBy(F.col(x).alias("x")).agg(n0, n1)


def shares(counts: DataFrame) -> DataFrame:
    """x, p0, p1 of counts that may name an outcome several times."""
    whole = counts.agg((F.sum("n0") + F.sum("n1")).alias("n"))
    merged = counts.groupBy("x").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1"))
    return merged.crossJoin(F.broadcast(whole)).select("x", (F.col("n0") / F.col("n")).alias("p0"), (F.col("n1") / F.col("n")).alias("p1"))


class HistogramState:
    """Counts by batch in a folder that driver and executors share. x_type is the type of the outcomes."""

    def __init__(self, spark: SparkSession, folder: str, x_type: str = "string"):
        self.spark, self.folder, self.x_type = spark, folder.rstrip("/"), x_type
        path = self._path()
        path.getFileSystem(spark._jsc.hadoopConfiguration()).mkdirs(path)

    def _path(self):
        return self.spark._jvm.org.apache.hadoop.fs.Path(self.folder)

    def update(self, df: DataFrame, batch: int, y: str, x: str) -> None:
        """Puts the counts of one batch in place of what the state has of it."""
        counts = label_counts(df, y, x).select(F.col("x").cast(self.x_type).alias("x"), "n0", "n1")
        counts.write.mode("overwrite").parquet(f"{self.folder}/batch={int(batch)}")

    def each_batch(self, y: str, x: str) -> Callable[[DataFrame, int], None]:
        """For writeStream.foreachBatch: a stream's batch has the same number when it comes again."""
        return lambda df, batch: self.update(df, batch, y, x)

    def counts(self) -> DataFrame:
        """batch, x, n0, n1; no rows before the first batch."""
        return self.spark.read.schema(f"x {self.x_type}, n0 long, n1 long, batch long").parquet(self.folder).select("batch", "x", "n0", "n1")

    def histogram(self) -> DataFrame:
        """x, p0, p1 over all batches so far."""
        return shares(self.counts())

    def drop(self) -> None:
        path = self._path()
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)


def combined(states: list[HistogramState]) -> DataFrame:
    """x, p0, p1 over the batches of several states, each state once."""
    apart = {s.folder: s for s in states}
    return shares(union_sources([s.counts() for s in apart.values()]))
