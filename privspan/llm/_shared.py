"""Tables in the cluster's shared folder, and connected components over link tables."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """The folder named in spark.checkpoint.dir; a temporary one only where none is named and Spark is local (tests)."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("name a folder that driver and executors share in spark.checkpoint.dir")
        folder = tempfile.mkdtemp(prefix="spark-shared-")
        spark.sparkContext.setCheckpointDir(folder)
    return folder.rstrip("/")


class SharedTable:
    """A Parquet table in the shared folder: it cuts lineage and outlives lost executors."""

    def __init__(self, df: DataFrame, name: str):
        self.spark = df.sparkSession
        self.path = f"{shared_folder(self.spark)}/{name}-{uuid.uuid4().hex}"
        df.write.parquet(self.path)
        self.df = self.spark.read.schema(df.schema).parquet(self.path)

    def drop(self) -> None:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)


def materialize(df: DataFrame, name: str) -> DataFrame:
    return SharedTable(df, name).df


@contextmanager
def scratch() -> Iterator[Callable[[DataFrame, str], DataFrame]]:
    """materialize() for tables that nothing reads after the block: its end deletes them."""
    held: list[SharedTable] = []

    def table(df: DataFrame, name: str) -> DataFrame:
        held.append(SharedTable(df, name))
        return held[-1].df

    try:
        yield table
    finally:
        for x in held:
            x.drop()


def with_text_key(docs: DataFrame) -> DataFrame:
    """Adds _text, the whole text with null as empty."""
    return docs.withColumn("_text", F.coalesce(F.col("text"), F.lit("")))


def held_out() -> F.Column:
    """True for the fifth of documents that no model learns from."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, F.lit(False))


def _all_rooted(edges: DataFrame) -> bool:
    """If each u has one edge (u, v), v < u, and no v has one of its own: then v is the smallest node that u reaches."""
    ends = edges.select(F.col("u").alias("node"), F.lit(1).alias("out"), F.lit(0).alias("into"))
    ends = ends.unionByName(edges.select(F.col("v").alias("node"), F.lit(0).alias("out"), F.lit(1).alias("into")))
    ends = ends.groupBy("node").agg(F.sum("out").alias("out"), F.max("into").alias("into"))
    return not ends.where("out > 1 or (out > 0 and into > 0)").agg(F.count("*")).first()[0]


def connected_components(edges: DataFrame, name: str = "components") -> DataFrame:
    """(node, root) for every node of edges(a, b): root is the smallest node reachable.

    Alternates large and small stars until all edges lead from a node straight to its root. Each star is one
    partial aggregate per node and one join, and every round is written to the shared folder. Loops and repeated
    edges are allowed; no edges give no rows.
    """
    now = SharedTable(
        edges.where("a <> b and a is not null and b is not null")
        .select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
        .distinct(),
        name,
    )
    while not _all_rooted(now.df):
        both = now.df.unionByName(now.df.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.unionByName(least.where("m < u").select("u", F.col("m").alias("v"))).distinct()
        floor = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(floor, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        after = SharedTable(small.unionByName(floor.select("u", F.col("m").alias("v"))).distinct(), name)
        now.drop()
        now = after
    roots = now.df.select("v").distinct().select(F.col("v").alias("node"), F.col("v").alias("root"))
    return now.df.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(roots)
