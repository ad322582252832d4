"""Centroid clustering by dimension-sharded Lloyd rounds.

The components of a vector are cut into shards, a column of the table each, so that a shard's tasks
read its own components and hold its own slice of the centroids, and nothing else. They give exact
partial distances; adding these up by vector and taking the least assigns it. Each shard then sums
its own components by cluster and moves its own slice. All numbers are integers.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._shared import materialize, scratch
from .whitening import blocks_of

UNIT, DIMENSIONS, CLUSTERS, ROUNDS = 64, 64, 16, 3
#: Components of a shard, and centroids that one row of partial distances covers.
WIDTH, GROUP = 16, 64
#: Partial distance from a centroid that does not exist: over any sum of real ones, far from a long's end.
FAR = 1 << 62 - 8
#: A vector with floor(UNIT c) beyond this is left out: distances of 64 components then fit in a long.
LARGEST = 1 << 27


def shards(dimensions: int) -> list[range]:
    return [range(i, min(i + WIDTH, dimensions)) for i in range(0, dimensions, WIDTH)]


def sharded(table: DataFrame, id_column: str, column: str, dimensions: int) -> DataFrame:
    """uid, id, b0, b1 ..: the vectors that are kept, floor(UNIT c) of each shard's components as a column.

    Kept are vectors of exactly `dimensions` components, none null, NaN, infinite or beyond
    LARGEST. uid tells rows apart that share an id; it holds once the table is written.
    """
    low, high = -LARGEST / UNIT, LARGEST / UNIT
    v = F.transform(column, lambda c: c.cast("double"))
    rows = table.select(F.col(id_column).alias("id"), v.alias("v")).where(F.size("v") == dimensions)
    rows = rows.where(F.forall("v", lambda c: F.coalesce(c.between(low, high), F.lit(False))))
    blocks = [F.transform(F.slice("v", s.start + 1, len(s)), lambda c: F.floor(c * float(UNIT)).cast("long")).alias(f"b{i}") for i, s in enumerate(shards(dimensions))]
    return rows.select(F.monotonically_increasing_id().alias("uid"), "id", *blocks)


def starts(base: DataFrame, dimensions: int, clusters: int) -> np.ndarray:
    """The vectors with the smallest sha256 of `1:<id>`, in that order; null ids come last, equal hashes by their components."""
    blocks = [f"b{i}" for i in range(len(shards(dimensions)))]
    digest = F.sha2(F.concat(F.lit("1:"), F.col("id").cast("string")), 256)
    first = base.select(digest.alias("h"), F.concat(*blocks).alias("x")).orderBy(F.asc_nulls_last("h"), "x").limit(clusters).collect()
    return np.array([r.x for r in first], np.int64).reshape(len(first), dimensions)


def partial_distances(base: DataFrame, shard: int, centroids: np.ndarray, group: int) -> DataFrame:
    """uid, g, d: squared distances of one shard's components from its slice of the centroids, `group` centroids a row."""

    def run(batches):
        for batch in batches:
            at = 0
            for x in blocks_of(batch.column(1)):
                uid, at = batch.column(0).slice(at, len(x)), at + len(x)
                for g in range(0, len(centroids), group):
                    own = centroids[g : g + group]
                    d = np.zeros((len(x), group), np.int64)
                    d[:, len(own) :] = FAR
                    for j in range(x.shape[1]):  # one component at a time, so that a block stays small
                        d[:, : len(own)] += (x[:, j, None] - own[None, :, j]) ** 2
                    lists = pa.ListArray.from_arrays(pa.array(np.arange(0, d.size + 1, group), pa.int32()), pa.array(d.ravel()))
                    yield pa.RecordBatch.from_arrays([uid, pa.array(np.full(len(x), g // group, np.int32)), lists], ["uid", "g", "d"])

    return base.select("uid", f"b{shard}").mapInArrow(run, "uid long, g int, d array<long>")


def assigned(base: DataFrame, centroids: np.ndarray) -> DataFrame:
    """uid, best (distance, cluster): partial distances of all shards added up by vector, then the least; ties go to the smaller number."""
    k, d = centroids.shape
    group = min(k, GROUP)
    parts = [partial_distances(base, i, centroids[:, s.start : s.stop], group) for i, s in enumerate(shards(d))]
    sums = union_all(parts).groupBy("uid", "g").agg(*[F.sum(F.col("d")[i]).alias(f"d{i}") for i in range(group)])
    best = F.array_min(F.array(*[F.struct(F.col(f"d{i}").alias("distance"), (F.col("g") * group + i).alias("cluster")) for i in range(group)])).alias("best")
    return sums.select("uid", best) if k <= group else sums.select("uid", best).groupBy("uid").agg(F.min("best").alias("best"))


def moved(base: DataFrame, clusters: DataFrame, centroids: np.ndarray) -> np.ndarray:
    """Each shard's slice of the centroids, moved to floor(sum / count) of its own components; empty clusters stay.

    Sums are partial before the shuffle, so that a cluster may hold any share of the vectors.
    clusters x components numbers reach the driver, as do the centroids.
    """
    parts = []
    for i, s in enumerate(shards(centroids.shape[1])):
        own = base.select("uid", F.col(f"b{i}").alias("b")).join(clusters.select("uid", "best.cluster"), "uid").groupBy("cluster")
        sums = own.agg(F.count("*").alias("n"), F.array(*[F.sum(F.col("b")[j]) for j in range(len(s))]).alias("sums"))
        parts.append(sums.withColumn("shard", F.lit(i)))
    out = centroids.copy()
    for r in union_all(parts).collect():
        s = shards(centroids.shape[1])[r.shard]
        out[r.cluster, s.start : s.stop] = [x // r.n for x in r.sums]
    return out


def union_all(parts: list[DataFrame]) -> DataFrame:
    whole = parts[0]
    for p in parts[1:]:
        whole = whole.unionByName(p)
    return whole


def clustered(table: DataFrame, id_column: str = "vec_id", column: str = "embedding", dimensions: int = DIMENSIONS, clusters: int = CLUSTERS, rounds: int = ROUNDS) -> DataFrame:
    """id_column, cluster, distance, cluster_inertia, inertia, centroid_sha256: one row a kept vector.

    sharded() says which vectors are kept; other columns are ignored, whatever their names. Rows
    are kept as often as they come, null ids too (these start no cluster before all others).
    Fewer vectors than clusters give as many clusters as vectors; equal starts leave all but the
    first empty, and an empty cluster keeps its centroid. An empty table gives no rows.
    """
    with scratch() as keep:
        base = keep(sharded(table, id_column, column, dimensions), "shards")
        centroids = starts(base, dimensions, clusters)
        if not len(centroids):
            none = "cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string"
            return table.sparkSession.createDataFrame([], f"`{id_column}` {dict(table.dtypes)[id_column]}, {none}")
        for _ in range(rounds):
            with scratch() as once:
                centroids = moved(base, once(assigned(base, centroids), "clusters"), centroids)
        last = materialize(base.select("uid", "id").join(assigned(base, centroids), "uid").select("id", "best.cluster", "best.distance"), "clustered")
    inertia = dict(last.groupBy("cluster").agg(F.sum("distance")).collect())
    digests = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids.tolist()]
    sums = F.array(*[F.lit(inertia.get(i)).cast("long") for i in range(len(centroids))])
    return last.select(
        F.col("id").alias(id_column), F.col("cluster").cast("int").alias("cluster"), "distance", F.element_at(sums, F.col("cluster") + 1).alias("cluster_inertia"),
        F.lit(sum(inertia.values())).cast("long").alias("inertia"), F.element_at(F.array(*map(F.lit, digests)), F.col("cluster") + 1).alias("centroid_sha256"),
    )


def op12_lloyd(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clustered(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def _sql() -> str:
    """The same rounds over rows of single components."""
    finite = "list_count(embedding) = 64 and not list_bool_or(list_transform(embedding, lambda c: isnan(c) or isinf(c)))"
    steps = [
        f"kept as materialized (select row_number() over () as uid, vec_id, list_transform(embedding, lambda c: cast(floor(64 * cast(c as double)) as bigint)) as x from embeddings where len(embedding) = 64 and {finite})",
        "c0 as materialized (select row_number() over (order by h nulls last, x) - 1 as cluster, x from (select sha256('1:' || vec_id) as h, x from kept order by h nulls last, x limit 16))",
    ]
    for i in range(ROUNDS + 1):
        apart = "list_sum(list_transform(range(1, 65), lambda i: (k.x[i] - c.x[i]) * (k.x[i] - c.x[i])))"
        steps.append(f"d{i} as (select uid, vec_id, k.x, cluster, cast({apart} as bigint) as distance from kept k, c{i} c)")
        steps.append(f"a{i} as materialized (select uid, any_value(vec_id) as vec_id, any_value(x) as x, min(distance) as distance, arg_min(cluster, distance * 16 + cluster) as cluster from d{i} group by uid)")
        if i < ROUNDS:
            steps.append(f"s{i} as (select cluster, i, sum(x[i]) as s, count(*) as n from (select cluster, x, unnest(range(1, 65)) as i from a{i}) group by cluster, i)")
            steps.append(f"m{i} as (select cluster, list(cast((s - ((s % n) + n) % n) // n as bigint) order by i) as x from s{i} group by cluster)")
            steps.append(f"c{i + 1} as materialized (select cluster, coalesce(m{i}.x, c{i}.x) as x from c{i} left join m{i} using (cluster))")
    return f"""with {", ".join(steps)}
select vec_id, cast(cluster as int) as cluster, distance, cast(sum(distance) over (partition by cluster) as bigint) as cluster_inertia, cast(sum(distance) over () as bigint) as inertia,
  sha256(array_to_string(c{ROUNDS}.x, ',')) as centroid_sha256
from a{ROUNDS} join c{ROUNDS} using (cluster)"""


SQL = _sql()
