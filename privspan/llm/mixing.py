"""Mixing sources to target weights by hash-threshold histograms, in DataFrame operations only.

Every document has a 52-bit hash of its id and text. A source that gives its words r times gives every
document floor(r) times, and once more those whose hash lies at or under a threshold. To find
it, words are summed by source and hash bucket; the bucket where the budget ends is divided
into the buckets of the next bits, and only its documents are summed again, until the hash is
used up. The thresholds are nested: a larger budget never takes a document less often. Nothing
is sorted but the short histograms. Only rows that repeat an id and its text share a hash; where
a budget ends among such rows, they are numbered, and so many of them are taken as it asks for.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ._shared import materialize, scratch

WEIGHTS = (5, 2, 1)
MOST = 3
LEVEL_BITS = 13
LEVELS = 4
#: Sources up to this many are broadcast to the documents; more are joined by shuffle.
BROADCAST_SOURCES = 100_000


def row_hash() -> F.Column:
    """52 bits of an MD5 of id and text, nulls as empty."""
    text = F.md5(F.coalesce("text", F.lit("")).cast("binary"))
    digest = F.md5(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit("|"), text).cast("binary"))
    return F.conv(F.substring(digest, 1, 13), 16, 10).cast("long")


def with_sizes(docs: DataFrame) -> DataFrame:
    """doc_id, source, size in words, and h, the row's hash."""
    size = F.regexp_count(F.coalesce(F.col("text"), F.lit("")), F.lit(r"[^\x20\x09-\x0D]+")).cast("long")
    return docs.select("doc_id", "source", size.alias("size"), row_hash().alias("h"))


def targets(sized: DataFrame, weights=WEIGHTS, most: int = MOST) -> DataFrame:
    """source, source_size, target: one row a source.

    Sources in order of code points, null last, weigh `weights`, repeating. Targets are level
    times weight, but `most` times the source's size where that is less, and sum to all sizes.
    The level comes from one pass over the sources by their ratio of limit to weight: those
    with the smaller ratios stop at their limits.
    """
    by = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    order = Window.orderBy(F.col("source").isNull(), F.col("source"))
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), ((F.row_number().over(order) - 1) % len(weights) + 1).cast("int"))
    by = by.withColumn("w", weight).withColumn("most", F.col("source_size") * F.lit(float(most)))
    rank = Window.orderBy(F.col("most") / F.col("w"), F.col("source").isNull(), F.col("source"))
    done = rank.rowsBetween(Window.unboundedPreceding, -1)
    all_of = Window.orderBy(F.lit(0)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    by = by.withColumn("rest", F.sum("source_size").over(all_of) - F.coalesce(F.sum("most").over(done), F.lit(0.0)))
    by = by.withColumn("rest_w", F.sum("w").over(all_of) - F.coalesce(F.sum("w").over(done), F.lit(0.0)))
    # The level if this source and all later ones share what is left; it holds at the first that it doesn't fill.
    by = by.withColumn("level", F.col("rest") / F.col("rest_w")).withColumn("turn", F.row_number().over(rank))
    unfilled = F.when(F.col("level") * F.col("w") <= F.col("most"), F.struct("turn", "level"))
    by = by.withColumn("at", F.min(unfilled).over(all_of)["level"])
    target = F.least(F.col("most"), F.coalesce(F.col("at") * F.col("w"), F.col("most")))
    return by.select("source", "source_size", target.alias("target"))


def _by_source(df: DataFrame, small: DataFrame, few: bool) -> DataFrame:
    small = small.withColumnRenamed("source", "_source")
    return df.join(F.broadcast(small) if few else small, F.col("source").eqNullSafe(F.col("_source"))).drop("_source")


def thresholds(sized: DataFrame, weights=WEIGHTS, most: int = MOST) -> tuple[DataFrame, bool]:
    """source, source_size, target, times, cut, copies, extra, a row a source; and if they are few enough to broadcast.

    A document is taken `times` times, and once more if its hash is below `cut` (null: never); of
    the `copies` rows whose hash is `cut`, `extra` are taken once more.
    """
    with scratch() as table:
        plan = targets(sized, weights, most).withColumn("ratio", F.coalesce(F.try_divide("target", "source_size"), F.lit(0.0)))
        plan = plan.withColumn("times", F.least(F.floor(F.col("ratio") + 1e-12), F.lit(most)).cast("long"))
        plan = plan.withColumn("budget", F.greatest(F.col("target") - F.col("times") * F.col("source_size"), F.lit(0.0)))
        plan = table(plan.drop("ratio"), "targets")
        few = plan.count() <= BROADCAST_SOURCES
        at = plan.select("source", "budget", F.lit(0).cast("long").alias("prefix"), F.lit(0).cast("long").alias("below"))
        for level in range(LEVELS):
            left = LEVEL_BITS * (LEVELS - level)
            inside = _by_source(sized, at, few).where(F.shiftright("h", left) == F.col("prefix"))
            cells = inside.groupBy("source", F.shiftright("h", left - LEVEL_BITS).alias("cell")).agg(
                F.sum("size").alias("words"), F.count("*").alias("copies"), F.first("budget").alias("budget"), F.first("below").alias("below")
            )
            run = Window.partitionBy("source").orderBy("cell")
            cells = cells.withColumn("upto", F.col("below") + F.sum("words").over(run))
            # The first cell at which the words pass the budget; a source that never passes it has none.
            over = cells.where("upto > budget").groupBy("source").agg(
                F.min_by(F.struct("cell", "budget", (F.col("upto") - F.col("words")).alias("below"), "words", "copies"), "cell").alias("c")
            )
            at = table(over.select("source", "c.budget", F.col("c.cell").alias("prefix"), "c.below", "c.words", "c.copies"), f"cells{level}")
        # So many rows of the last cell, which are alike, as come nearest to the budget.
        each = (F.col("budget") - F.col("below")) / (F.col("words") / F.col("copies"))
        extra = F.least(F.greatest(F.ceil(each - 0.5), F.lit(0)), F.col("copies")).cast("long")
        cut = at.select(F.col("source").alias("_s"), F.col("prefix").alias("cut"), "copies", extra.alias("extra"))
        plan = plan.join(cut, F.col("source").eqNullSafe(F.col("_s")), "left").drop("_s")
        wanted = (F.col("budget") > 0) & (F.col("times") < most)
        plan = plan.withColumn("cut", F.when(wanted, F.coalesce("cut", F.lit(2**52))))
        return materialize(plan.select("source", "source_size", "target", "times", "cut", "copies", "extra"), "thresholds"), few


def _with_times(rows: DataFrame, plan: DataFrame, few: bool) -> DataFrame:
    """rows (source, h, ...) with the plan's columns and _times, how often the mix takes each.

    Rows that share the hash of a cut of which only some are taken are numbered: within each
    partition that they lie in, and on from the partitions before it.
    """
    rows = _by_source(rows, plan, few)
    more = (F.col("h") < F.col("cut")) | ((F.col("h") == F.col("cut")) & (F.col("extra") == F.col("copies")))
    plain = rows.withColumn("_times", F.col("times") + F.when(more, 1).otherwise(0))
    divided = F.col("cut").isNotNull() & (F.col("extra") > 0) & (F.col("extra") < F.col("copies"))
    if not plan.where(divided).limit(1).count():
        return plain
    shared = F.coalesce(divided & (F.col("h") == F.col("cut")), F.lit(False))
    parted = materialize(rows.where(shared).withColumn("_part", F.spark_partition_id()), "divided")
    before = Window.partitionBy("source").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = parted.groupBy("source", "_part").agg(F.count("*").alias("_n")).withColumn("_start", F.coalesce(F.sum("_n").over(before), F.lit(0)))
    starts = materialize(starts.select(F.col("source").alias("_s"), F.col("_part").alias("_p"), "_start"), "starts")
    own = F.row_number().over(Window.partitionBy("source", "_part").orderBy(F.lit(0)))
    numbered = parted.withColumn("_own", own).join(starts, F.col("source").eqNullSafe(F.col("_s")) & (F.col("_part") == F.col("_p")))
    numbered = numbered.withColumn("_times", F.col("times") + F.when(F.col("_own") + F.col("_start") <= F.col("extra"), 1).otherwise(0))
    return plain.where(~shared).unionByName(numbered.drop("_part", "_own", "_s", "_p", "_start"))


def mix(docs: DataFrame, weights=WEIGHTS, most: int = MOST) -> DataFrame:
    """A row for every row of docs: doc_id, size, source_size, target, taken, times.

    times is how often the mix takes the document (0 to `most`), taken its words with repeats.
    Null and empty texts count no words; a source without words has target 0 and takes nothing;
    rows without a source are a source of their own. A source misses its target by at most half
    a document, also where ids are null, equal or repeat with their texts: such rows are taken
    by number. Texts of any length are counted whole. Reruns agree; an empty table gives no rows.
    """
    sized = materialize(with_sizes(docs), "sizes")
    plan, few = thresholds(sized, weights, most)
    out = _with_times(sized, plan, few)
    return out.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("_times")).alias("taken"), F.col("_times").alias("times"))


def mixed_documents(docs: DataFrame, weights=WEIGHTS, most: int = MOST) -> DataFrame:
    """Each row of docs as often as the mix takes it; the columns stay as they are. Texts are not shuffled.

    Of rows that agree in id, text and source, but not in other columns, any may be those taken once more.
    """
    with scratch() as table:
        plan, few = thresholds(table(with_sizes(docs), "sizes"), weights, most)
    # The row travels as one column, so that no column of docs can clash with these.
    rows = docs.select(F.struct(*docs.columns).alias("row"), "source", row_hash().alias("h"))
    rows = _with_times(rows, plan.drop("source_size", "target"), few).select("row", F.col("_times").cast("int").alias("times"))
    return rows.where("times > 0").select("row", F.explode(F.sequence(F.lit(1), F.col("times")))).select("row.*")


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return mix(docs).select("doc_id", "size", "source_size", F.round("target", 3).alias("target"), "taken")


SQL = r"""
WITH sized AS (
  SELECT doc_id, source, ('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '') || '|' || md5(coalesce(text, ''))), 1, 13))::BIGINT AS h,
         len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size
  FROM documents),
by_source AS (
  SELECT source, sum(size)::BIGINT AS source_size,
         CASE (row_number() OVER (ORDER BY source IS NULL, encode(source)) - 1) % 3 WHEN 0 THEN 5.0::DOUBLE WHEN 1 THEN 2.0 ELSE 1.0 END AS w
  FROM sized GROUP BY source),
ranked AS (
  SELECT *, 3.0::DOUBLE * source_size AS most,
         (sum(source_size) OVER ())::DOUBLE - coalesce(sum(3.0::DOUBLE * source_size) OVER (r ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS rest,
         sum(w) OVER () - coalesce(sum(w) OVER (r ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS rest_w
  FROM by_source WINDOW r AS (ORDER BY 3.0::DOUBLE * source_size / w, source IS NULL, encode(source))),
levelled AS (
  SELECT *, arg_min(rest / rest_w, turn) FILTER (WHERE rest / rest_w * w <= most) OVER () AS lev
  FROM (SELECT *, row_number() OVER (ORDER BY most / w, source IS NULL, encode(source)) AS turn FROM ranked)),
plan AS (
  SELECT source, source_size, least(most, coalesce(lev * w, most)) AS target,
         CASE WHEN source_size = 0 THEN 0 ELSE least(floor(least(most, coalesce(lev * w, most)) / source_size + 1e-12), 3) END::BIGINT AS times
  FROM levelled),
budgets AS (SELECT *, greatest(target - times * source_size, 0) AS budget FROM plan),
hashes AS (SELECT source, h, sum(size) AS words, count(*) AS copies FROM sized GROUP BY source, h),
summed AS (SELECT *, sum(words) OVER (PARTITION BY source ORDER BY h) AS upto FROM hashes),
crossing AS (
  SELECT s.source, min(h) AS h, arg_min(upto, h) AS upto, arg_min(words, h) AS words, arg_min(copies, h) AS copies
  FROM summed s JOIN budgets b ON s.source IS NOT DISTINCT FROM b.source WHERE upto > budget GROUP BY s.source),
cuts AS (
  SELECT b.*, coalesce(c.h, 4503599627370496) AS cut, ceil((budget - (c.upto - c.words)) / (c.words / c.copies) - 0.5) AS extra
  FROM budgets b LEFT JOIN crossing c ON b.source IS NOT DISTINCT FROM c.source),
numbered AS (SELECT *, row_number() OVER (PARTITION BY source, h) AS turn FROM sized)
SELECT doc_id, size, source_size, round(target, 3) AS target,
       (size * (times + CASE WHEN budget > 0 AND times < 3 AND (s.h < cut OR s.h = cut AND turn <= extra) THEN 1 ELSE 0 END))::BIGINT AS taken
FROM numbered s JOIN cuts c ON s.source IS NOT DISTINCT FROM c.source
"""
