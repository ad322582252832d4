"""Black-box estimates: histograms, nearest neighbours, a small network, and accuracies to spectra."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from privspan.sources.tables import stored

from .calibrate import odd_neighbours, tight_bound
from .neighbors import nearest
from .relational import SENTINEL_FROM, union_sources, without_dummies

def joint_histogram(df: DataFrame, y: str, x: str) -> DataFrame:
    """x, p0, p1: shares of all rows by outcome and label; the label is 0 or 1."""
    counts = df.groupBy(F.col(x).alias("x")).agg(F.sum(F.when(F.col(y) == 0, 1).otherwise(0)).alias("n0"), F.sum(F.when(F.col(y) == 1, 1).otherwise(0)).alias("n1"))
    whole = counts.agg(F.sum(F.col("n0") + F.col("n1")).alias("n"))
    return counts.crossJoin(F.broadcast(whole)).select("x", (F.col("n0") / F.col("n")).alias("p0"), (F.col("n1") / F.col("n")).alias("p1"))


def histogram_accuracy(histogram: DataFrame) -> DataFrame:
    """One row: the accuracy of the best guess from x."""
    return histogram.agg(F.sum(F.greatest("p0", "p1")).alias("accuracy"))


def vote(found: DataFrame) -> DataFrame:
    """test_id, predicted: the rounded mean label, halves to even."""
    return found.groupBy("test_id").agg(F.rint(F.avg("y")).alias("predicted"))


def nearest_on_line(train: DataFrame, test: DataFrame, k: int, rows_per_part: int = 200_000) -> DataFrame:
    """test_id, predicted, for points on a line (v): each one's k nearest lie among the k before and the k after it.

    Quantiles of the training points, as literals, divide the line into parts; each part gets the k
    last points before it and the k first after it, sorts once, and looks its test points up. Of
    equal points only the k with the smallest train_id can count, and each value is looked up
    once, so that no value makes a part large. Ties go by train_id; without training points there are no rows.
    """
    own = train.select(F.col("v").cast("double").alias("v"), F.col("train_id").cast("long").alias("id"), F.col("y").cast("double").alias("y")).where("v is not null")
    few = own.withColumn("_n", F.row_number().over(Window.partitionBy("v").orderBy("id"))).where(F.col("_n") <= k).drop("_n")
    n = few.count()
    if not n:
        return test.limit(0).select("test_id", F.lit(0.0).alias("predicted"))
    parts = max(math.ceil(n / max(rows_per_part, k)), 1)
    shares = [i / parts for i in range(1, parts)]
    bounds = sorted(set(few.agg(F.percentile_approx("v", shares, 10_000)).first()[0])) if shares else []
    part = F.size(F.filter(F.array(*map(F.lit, bounds)), lambda b: b < F.col("v"))) if bounds else F.lit(0)
    few = few.withColumn("part", part)
    sizes = dict(few.groupBy("part").count().collect())
    # For each part, the parts next to it that hold k points together on either side.
    wanted = []
    for p in range(len(bounds) + 1):
        for step, last in ((-1, -1), (1, len(bounds) + 1)):
            need, q = k, p + step
            while need > 0 and q != last:
                wanted.append((q, p, step))
                need, q = need - sizes.get(q, 0), q + step
    ends = [(1, F.asc("v")), (-1, F.desc("v"))]
    halos = [few.withColumn("step", F.lit(step)).withColumn("_n", F.row_number().over(Window.partitionBy("part").orderBy(order, "id"))).where(F.col("_n") <= k).drop("_n") for step, order in ends]
    pairs = train.sparkSession.createDataFrame(wanted or [(-1, -1, 0)], "part int, target int, step int")
    near = halos[0].unionByName(halos[1]).join(F.broadcast(pairs), ["part", "step"]).select(F.col("target").alias("part"), "v", "id", "y")
    asked = test.select(F.col("v").cast("double").alias("v")).where("v is not null").distinct().select(part.alias("part"), "v", F.lit(None).cast("long").alias("id"), F.lit(None).cast("double").alias("y"))

    def look_up(table: pa.Table) -> pa.Table:
        v, y = (table[c].to_numpy() for c in ("v", "y"))
        is_test = table["id"].is_null().to_numpy()
        ids = table["id"].fill_null(0).to_numpy()
        at = np.nonzero(~is_test)[0]
        before, after = at[np.lexsort((ids[at], -v[at]))], at[np.lexsort((ids[at], v[at]))]
        values, predicted = v[is_test], np.empty(is_test.sum())
        left, right = len(at) - np.searchsorted(v[after], values, "right"), np.searchsorted(v[after], values, "right")
        for i, x in enumerate(values):
            found = np.concatenate([before[left[i] : left[i] + k], after[right[i] : right[i] + k]])
            order = np.lexsort((ids[found], np.abs(v[found] - x)))[:k]
            predicted[i] = np.rint(y[found[order]].mean())
        return pa.table({"v": values, "predicted": predicted})

    rows = few.select("part", "v", "id", "y").unionByName(near).unionByName(asked)
    found = rows.groupBy("part").applyInArrow(look_up, "v double, predicted double")
    return test.select("test_id", F.col("v").cast("double").alias("v")).join(found, "v").select("test_id", "predicted")


def accuracy_with_dummies(predicted: DataFrame, dropped: int) -> Column:
    """Share of right predictions when each of `dropped` sentinels counts as right."""
    return (F.sum((F.col("predicted") == F.col("y")).cast("double")) + dropped) / (F.count("*") + dropped)


def estimate(train: DataFrame, test: DataFrame, eps: float, gamma: float = 0.01) -> DataFrame:
    """One row: delta, accuracy and range estimated by nearest neighbours from labelled samples with sentinels.

    train and test: sample_id, y, x. Some ten jobs read them, so they are stored first: what made them runs once.
    """
    return _estimate(*(stored(df.select("sample_id", "y", "x"), "samples") for df in (train, test)), eps, gamma)


def estimate_halves(samples: DataFrame, eps: float, gamma: float = 0.01) -> DataFrame:
    """estimate() from samples 0 and 1 of every four, tested on 2 and 3; the samples are made once for both."""
    return _estimate(*halves(stored(samples.select("sample_id", "y", "x"), "samples")), eps, gamma)


def estimate_halves_of(samples: DataFrame, group: str, values: list, eps: float, gamma: float = 0.01) -> DataFrame:
    """The group's column before estimate_halves() of each of the values, from samples that are made once for all."""
    kept = stored(samples.select(group, "sample_id", "y", "x"), "samples")
    kind = kept.schema[group].dataType
    parts = [_estimate(*halves(kept.where(F.col(group) == v).drop(group)), eps, gamma).select(F.lit(v).cast(kind).alias(group), "*") for v in values]
    return union_sources(parts)


def halves(samples: DataFrame) -> tuple[DataFrame, DataFrame]:
    return samples.where("sample_id % 4 < 2"), samples.where("sample_id % 4 >= 2")


def _estimate(train: DataFrame, test: DataFrame, eps: float, gamma: float) -> DataFrame:
    n_train, n_test = train.count(), test.count()
    kept = without_dummies(train, "x").select(F.col("sample_id").alias("train_id"), "x", "y")
    tested = without_dummies(test, "x").select(F.col("sample_id").alias("test_id"), "x", "y")
    n_kept, n_tested = kept.count(), tested.count()
    k = min(10 * odd_neighbours(n_kept, 1), n_kept)
    scored = vote(nearest(kept, tested.select("test_id", "x"), k)).join(tested.select("test_id", "y"), "test_id")
    out = scored.agg(accuracy_with_dummies(scored, n_test - n_tested).alias("accuracy"))
    d = len(kept.first()["x"]) if n_kept else 1
    delta = F.greatest(F.lit(0.0), 1 - 2 * math.exp(eps) * (1 - F.col("accuracy")))
    radius = tight_bound(gamma, max(n_train, 1), max(n_test, 1), d, eps)
    return out.select(delta.alias("estimated_delta"), "accuracy", F.greatest(F.lit(0.0), delta - radius).alias("low"), F.least(F.lit(1.0), delta + radius).alias("high"), F.lit(gamma).alias("gamma"), F.lit(n_train).alias("training_size"), F.lit(n_test).alias("validation_size"))


#: Numbers of the table's own samples that estimate_each() hands to every task.
MOST_SHARED = 1 << 22


def estimate_each(table: DataFrame, neighbors: DataFrame, eps: float, gamma: float = 0.01) -> DataFrame:
    """left_out and estimate()'s columns, for every neighbour in one job.

    table: sample_id, y, x; neighbors: left_out, sample_id, y, x, as mechanisms.neighbor_samples
    gives them. Samples 0 and 1 of every four are for training, 2 and 3 for testing. The table's samples
    are handed to all tasks: MOST_SHARED numbers at most, or a ValueError. A task holds one neighbour's
    samples, as many as there are draws.
    """
    shared = table.select("sample_id", "y", "x").limit(MOST_SHARED + 1).collect()
    if sum(len(r.x) for r in shared) > MOST_SHARED:
        raise ValueError(f"the table's samples hold over {MOST_SHARED} numbers; use estimate() for one neighbour at a time")
    own = np.array([r.sample_id for r in shared], np.int64), np.array([r.y for r in shared], np.float64), np.array([r.x for r in shared], np.float64)

    def one(group: pa.Table) -> pa.Table:
        x = group["x"].combine_chunks()
        x = x.flatten().to_numpy(zero_copy_only=False).reshape(len(group), -1)
        ids, y, x = (np.concatenate(z) for z in zip(own, (group["sample_id"].to_numpy(), group["y"].to_numpy(), x))) if len(shared) else (group["sample_id"].to_numpy(), group["y"].to_numpy(), x)
        order = np.argsort(ids, kind="stable")
        ids, y, x = ids[order], y[order], x[order]
        real, training = x[:, 0] < SENTINEL_FROM, ids % 4 < 2
        n_train, n_test = int(training.sum()), int((~training).sum())
        a, b = np.flatnonzero(training & real), np.flatnonzero(~training & real)
        k, right = min(10 * odd_neighbours(len(a), 1), len(a)), 0
        for at in range(0, len(b), max((1 << 20) // max(len(a), 1), 1)) if k else ():
            q = b[at : at + max((1 << 20) // len(a), 1)]
            d = np.zeros((len(q), len(a)))
            for j in range(x.shape[1]):
                d += (x[q, j, None] - x[None, a, j]) ** 2
            near = np.argsort(d, axis=1, kind="stable")[:, :k]
            right += int((np.rint(y[a][near].mean(1)) == y[q]).sum())
        accuracy = (right + n_test - len(b)) / n_test if n_test else None
        delta = None if accuracy is None else max(0.0, 1 - 2 * math.exp(eps) * (1 - accuracy))
        radius = tight_bound(gamma, max(n_train, 1), max(n_test, 1), x.shape[1], eps)
        low, high = (None, None) if delta is None else (max(0.0, delta - radius), min(1.0, delta + radius))
        return pa.table({"left_out": group["left_out"][:1], "estimated_delta": pa.array([delta], pa.float64()), "accuracy": pa.array([accuracy], pa.float64()), "low": pa.array([low], pa.float64()), "high": pa.array([high], pa.float64()), "training_size": [n_train], "validation_size": [n_test]})

    return neighbors.groupBy("left_out").applyInArrow(one, "left_out long, estimated_delta double, accuracy double, low double, high double, training_size long, validation_size long")


def network_accuracy(train: DataFrame, test: DataFrame, d: int, epochs: int = 30, seed: int = 0) -> DataFrame:
    """One row: accuracy of a network of two hidden layers, trained by Spark's own distributed optimiser."""
    from pyspark.ml.classification import MultilayerPerceptronClassifier
    from pyspark.ml.functions import array_to_vector

    as_vectors = lambda df: df.select(array_to_vector(F.col("x")).alias("features"), F.col("y").cast("double").alias("label"))
    model = MultilayerPerceptronClassifier(layers=[d, 16, 8, 2], maxIter=epochs, seed=seed, blockSize=256).fit(as_vectors(train))
    return model.transform(as_vectors(test)).agg(F.avg((F.col("prediction") == F.col("label")).cast("double")).alias("accuracy"))
