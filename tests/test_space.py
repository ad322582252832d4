"""Nearest neighbours by cells against all pairs."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from privspan.operators import neighbors


def table(spark, x, name="train_id", first=0):
    rows = [(first + i, [float(v) for v in p], float(i % 3)) for i, p in enumerate(x)]
    df = spark.createDataFrame(rows, f"{name} long, x array<double>, y double")
    return df if name == "train_id" else df.drop("y")


def plain(train, test, k):
    out = {}
    for i, q in enumerate(test):
        d = ((train - q) ** 2).sum(1)
        out[i] = [(j, math.sqrt(d[j])) for j in sorted(range(len(train)), key=lambda j: (d[j], j))[:k]]
    return out


def check(spark, x, q, k):
    got = {}
    for r in neighbors.nearest(table(spark, x).repartition(3), table(spark, q, "test_id"), k).collect():
        got.setdefault(r.test_id, []).append((r.train_id, r.distance, r.y))
    want = plain(x, q, k)
    assert set(got) == set(want)
    for i, near in want.items():
        own = sorted(got[i], key=lambda t: (t[1], t[0]))
        assert [j for j, _, _ in own] == [j for j, _ in near]
        assert [d for _, d, _ in own] == pytest.approx([d for _, d in near]) and all(y == j % 3 for j, _, y in own)


@pytest.fixture
def small_blocks(monkeypatch):
    monkeypatch.setattr(neighbors, "BLOCK", 64)
    monkeypatch.setattr(neighbors, "SALTED", 200)


def test_ties_and_equal_points(spark, small_blocks):
    g = np.random.default_rng(1)
    x = g.integers(0, 6, (900, 2)).astype(float)
    x[:400] = 3.0  # nearly half of all points are one
    check(spark, x, g.integers(0, 6, (60, 2)).astype(float), 7)


def test_clusters_meet_few_points(spark, small_blocks):
    g = np.random.default_rng(2)
    centers = g.normal(0, 50, (40, 3))
    x, q = centers[g.integers(0, 40, 3000)] + g.normal(0, 1, (3000, 3)), centers[g.integers(0, 40, 200)] + g.normal(0, 1, (200, 3))
    check(spark, x, q[:40], 5)
    train, test = table(spark, x), table(spark, q, "test_id")
    assert neighbors.pairs_met(train, test, 5) < len(x) * len(q) / 5
    plan = neighbors.nearest(train, test, 5)._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan


def test_far_test_points_few_points_and_odd_rows(spark, small_blocks):
    g = np.random.default_rng(3)
    x = g.normal(0, 1, (300, 12))
    check(spark, x, np.concatenate([x[:5], g.normal(0, 30, (10, 12))]), 4)
    check(spark, x[:3], g.normal(0, 1, (4, 12)), 9)
    none = spark.createDataFrame([], "train_id long, x array<double>, y double")
    assert neighbors.nearest(none, table(spark, x, "test_id"), 3).collect() == [] and neighbors.pairs_met(none, table(spark, x, "test_id"), 3) == 0
    odd = spark.createDataFrame([(1, [0.0, 0.0], None), (2, None, 1.0), (3, [math.nan, 0.0], 1.0), (None, [0.0, 0.0], 1.0), (4, [None, 1.0], 1.0), (5, [3.0, 4.0], 2.0)], "train_id long, x array<double>, y double")
    tests = spark.createDataFrame([(1, [0.0, 0.0]), (2, None), (3, [math.nan, 1.0])], "test_id long, x array<double>")
    assert sorted(tuple(r) for r in neighbors.nearest(odd, tests, 5).collect()) == [(1, 1, None, 0.0), (1, 5, 2.0, 5.0)]


def test_cells_hold_all_points(spark):
    g = np.random.default_rng(4)
    for x in (g.normal(0, 1, (500, 3)), np.zeros((50, 2)), g.integers(0, 2, (300, 1)).astype(float), np.array([[1.0], [2.0]])):
        tree = neighbors.Tree.of(x, 16)
        cell = tree.cell(x)
        assert cell.min() >= 0 and cell.max() < 16
        sizes = np.bincount(cell)
        assert len(np.unique(x, axis=0)) < 16 or sizes.max() < len(x) / 4
        equal = {}
        for p, c in zip(map(tuple, x), cell):
            assert equal.setdefault(p, c) == c
