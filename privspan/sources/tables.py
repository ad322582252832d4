"""Typed readers and writers. Columns and predicates are pushed to the files by Spark."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from privspan.operators.relational import padded_key


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def new_folder(spark: SparkSession, name: str) -> str:
    """A new folder in the shared place that the session names, else in the warehouse."""
    return f"{(spark.conf.get('spark.checkpoint.dir', None) or spark.conf.get('spark.sql.warehouse.dir')).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """df written once as Parquet and read back, for results that several jobs read."""
    folder = new_folder(df.sparkSession, name)
    df.write.parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder)


def matrix_schema(columns: list[str]) -> StructType:
    return StructType([StructField(c, DoubleType()) for c in columns])


def read_matrix(spark: SparkSession, path: str, columns: list[str], header: bool = False) -> DataFrame:
    """A comma-separated file of numbers."""
    return spark.read.csv(path, schema=matrix_schema(columns), header=header)


def write_matrix(df: DataFrame, path: str, columns: list[str]) -> None:
    df.select(*[F.col(c).cast("double") for c in columns]).write.mode("overwrite").csv(path)


def read_targeted(spark: SparkSession, path: str, features: list[str], target: str) -> DataFrame:
    """A file without header whose first column is the target; a constant is added to the features."""
    return read_matrix(spark, path, [target, *features]).select(*features, F.lit(1.0).alias("constant"), target)


def complete_rows(df: DataFrame, feature: str, target: str) -> DataFrame:
    """One feature, a constant and the target, of rows where neither is null or NaN."""
    return df.select(F.col(feature).cast("double").alias(feature), F.lit(1.0).alias("constant"), F.col(target).cast("double").alias(target)).dropna("any")


#: Folders of batches under each label; with more batches, a folder holds several.
MOST_FOLDERS = 256


def write_batches(df: DataFrame, path: str, key: str, rows_per_batch: int, label: str) -> None:
    """Files by label and batch of the key, so that a range of keys opens its own batches only.

    Beyond MOST_FOLDERS batches a folder (batch_from, batch_to) holds as many successive ones as keep to that number,
    in the order of the key, so that files grow with the table, not their number; batches are told by the statistics of
    the files' parts then. df is read twice.
    """
    rows = df.withColumn("batch_id", F.expr(f"{key} div {int(rows_per_batch)}"))
    ends = rows.agg(F.min("batch_id").alias("low"), F.max("batch_id").alias("high")).first()
    each = -(-(ends.high - ends.low + 1) // MOST_FOLDERS) if ends.low is not None else 1
    folders = ["batch_id"]
    if each > 1:
        folders, start = ["batch_from", "batch_to"], F.col("batch_id") - F.pmod("batch_id", F.lit(each))
        rows = rows.withColumns({"batch_from": start, "batch_to": start + (each - 1)})
    dealt = rows.repartition(label, *folders).sortWithinPartitions(label, *folders, key)
    dealt.write.partitionBy(label, *folders).mode("overwrite").parquet(path)


def read_range(df: DataFrame, key: str, rows_per_batch: int, first: int, count: int) -> DataFrame:
    """Rows first .. first + count - 1 by the key of a table with batch_id."""
    last = first + count - 1
    low, high = first // rows_per_batch, last // rows_per_batch
    if "batch_from" in df.columns:
        df = df.where((F.col("batch_from") <= high) & (F.col("batch_to") >= low)).drop("batch_from", "batch_to")
    return df.where(F.col("batch_id").between(low, high)).where(F.col(key).between(first, last))


def keyed_counties(df: DataFrame, state: str, county: str) -> DataFrame:
    """fips, the five-digit key of state and county, in front of the other columns."""
    return df.where(F.col(state).isNotNull() & F.col(county).isNotNull()).select(padded_key((F.col(state), 2), (F.col(county), 3)).alias("fips"), "*").drop(state, county)
