"""Exact dedup with a heavy-hitter split.

Misra-Gries summaries of digests, one per task and merged, name every digest that may hold more
than 1/(counters + 1) of the rows. Their exact counts verify them; the winners are broadcast, so
rows of a very frequent text get their group's figures on the map side and never meet in one
task. All other digests shuffle as usual, and none of their groups can be large.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import MapType

from ._shared import materialize

COUNTERS = 2048


def misra_gries(digests: DataFrame, counters: int = COUNTERS) -> DataFrame:
    """One summary (digest, low) a task: every digest above 1/(counters + 1) of the task's rows is in it."""

    def summarise(batches):
        kept: dict[str, int] = {}
        for batch in batches:
            for value, n in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if value in kept:
                    kept[value] += n
                elif len(kept) < counters:
                    kept[value] = n
                else:
                    cut = min(n, min(kept.values()))
                    kept = {k: v - cut for k, v in kept.items() if v > cut}
                    if n > cut:
                        kept[value] = n - cut
        yield pa.RecordBatch.from_pydict(
            {"digest": pa.array(list(kept), pa.string()), "low": pa.array(list(kept.values()), pa.int64())}
        )

    return digests.select("digest", F.lit(1).cast("long").alias("n")).mapInArrow(summarise, "digest string, low long")


def heavy_split(docs: DataFrame, counters: int) -> tuple[DataFrame, DataFrame]:
    """(doc_id, digest) of every row, and the verified winners (digest, keep_id, group_size).

    There are at most `counters` winners. A digest that is no candidate has at most about
    2/counters of the rows: that much can be lost by the summaries and by the cut among them.
    """
    rows = materialize(docs.select("doc_id", digest().alias("digest")), "digests")
    named = misra_gries(rows, counters).groupBy("digest").agg(F.sum("low").alias("low"))
    named = F.broadcast(named.orderBy(F.desc("low"), "digest").limit(counters).select("digest"))
    exact = rows.join(named, "digest").groupBy("digest").agg(F.max("doc_id").alias("keep_id"), F.count("*").alias("group_size"))
    return rows, materialize(exact.where("group_size > 1"), "heavy")


def digest() -> F.Column:
    return F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256)


def exact_groups(docs: DataFrame, counters: int = COUNTERS) -> DataFrame:
    """A row for every row of docs: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal when identical after no change; null counts as empty. Of equal texts the row
    with the largest doc_id stays (a null id is the smallest). Rows that repeat a doc_id and its
    text are all marked kept if that id stays; deduplicate() leaves one of them. Texts of any
    length are compared by SHA-256. An empty table gives no rows; columns other than doc_id and text are not looked at.
    """
    rows, winners = heavy_split(docs, counters)
    marked = rows.join(F.broadcast(winners), "digest", "left")
    whole = Window.partitionBy("digest")
    light = marked.where("group_size is null").select(
        "digest", "doc_id", F.max("doc_id").over(whole).alias("keep_id"), F.count("*").over(whole).alias("group_size")
    )
    heavy = marked.where("group_size is not null").select(light.columns)
    kept = F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept")
    return heavy.unionByName(light).select("doc_id", "keep_id", "group_size", kept, F.col("digest").alias("text_sha256"))


def deduplicate(docs: DataFrame, counters: int = COUNTERS) -> DataFrame:
    """docs with one row of each text, that with the largest doc_id (null is the smallest); all columns stay.

    Null counts as empty. Of rows with one id and text but other columns, that with the smallest
    hash of all columns stays. Texts of any length are compared by SHA-256; an empty table gives none.
    """
    rows, winners = heavy_split(docs, counters)
    heavy = F.broadcast(winners.select("digest", F.col("keep_id").alias("heavy_id"), F.lit(True).alias("heavy")))
    # The row travels as one column, so that no column of docs can clash with these.
    texts = docs.select(F.struct(*docs.columns).alias("row"), "doc_id", digest().alias("digest")).join(heavy, "digest", "left")
    texts = texts.where(F.col("heavy").isNull() | F.col("doc_id").eqNullSafe(F.col("heavy_id")))
    light = rows.join(heavy, "digest", "left_anti").groupBy("digest").agg(F.max("doc_id").alias("light_id"))
    texts = texts.join(light, "digest", "left").where(F.col("doc_id").eqNullSafe(F.coalesce("heavy_id", "light_id")))
    hashed = [F.col("row")[f.name] for f in docs.schema.fields if not isinstance(f.dataType, MapType)]
    one = Window.partitionBy("digest").orderBy(F.xxhash64(*hashed))
    return texts.withColumn("n", F.row_number().over(one)).where("n = 1").select("row.*")


def op10_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_groups(spark.read.parquet(f"{sf_dir}/documents.parquet"))


SQL = """
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
       doc_id = max(doc_id) OVER w AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW w AS (PARTITION BY coalesce(text, ''))
"""
