"""Composed releases: the closed form of Gaussians is always enclosed, and states add up in any order."""

import math

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from privspan.functions.numeric import gaussian_delta
from privspan.operators import composition

SCHEMA = "g long, mu double"


def of(spark, rows, grid, eps):
    got = composition.enclosure(composition.state(spark.createDataFrame(rows, SCHEMA), "g", "mu", grid), grid, eps)
    return {(r.g, r.eps): (r.low, r.high, r.n) for r in got.collect()}


@settings(max_examples=40, deadline=None)
@given(st.floats(0.02, 2.0), st.floats(-4, 4), st.sampled_from([64, 256, 4096]))
def test_one_release_is_between_its_discrete_ones(mu, eps, size):
    grid = composition.Grid(size, 12.0)
    found = composition.masses(mu, grid)
    spectrum = lambda mass: float((mass * np.maximum(0, -np.expm1(np.minimum(eps - grid.losses, 0)))).sum())
    above, missing = found["above"]
    below, given_up = found["below"]
    assert (above >= 0).all() and (below >= 0).all()
    assert spectrum(below) - given_up <= gaussian_delta(eps, mu) + 1e-13
    assert spectrum(above) + missing >= gaussian_delta(eps, mu) - 1e-13


def test_different_releases_are_enclosed_closely(spark):
    grid = composition.Grid(1 << 16, 9.0)
    groups = {1: [0.05] * 100, 2: [0.13] * 30 + [0.11] * 30, 3: [1.0], 4: [0.0625] * 50 + [0.3, 0.2, 0.7], 5: [0.2, 0.0, 0.0]}
    found = of(spark, [(g, m) for g, mus in groups.items() for m in mus], grid, [0.0, 0.5, 2.0])
    for (g, eps), (low, high, n) in found.items():
        closed = gaussian_delta(eps, math.sqrt(sum(m * m for m in groups[g])))
        assert low <= closed <= high and high - low < 2e-6 and n == len(groups[g])
        assert g == 1 or high - low < 1e-6
    assert len(found) == 15


def test_a_finer_grid_is_closer_by_the_square(spark):
    rows = [(1, 0.4)] * 5
    widths = [high - low for low, high, _ in (of(spark, rows, composition.Grid(s, 9.0), [0.5])[(1, 0.5)] for s in (1 << 10, 1 << 12))]
    assert widths[1] == pytest.approx(widths[0] / 16, rel=0.2)


def test_batches_add_up(spark):
    grid = composition.Grid(2048, 9.0)
    rows = spark.createDataFrame([(i % 3, 0.05 + 0.01 * (i % 7)) for i in range(60)], SCHEMA).withColumn("i", F.monotonically_increasing_id() % 4)
    whole = composition.enclosure(composition.state(rows, "g", "mu", grid), grid, [0.3])
    parts = [composition.state(rows.where(F.col("i") == i), "g", "mu", grid) for i in range(4)]
    stored = parts[0]
    for p in parts[1:]:
        stored = composition.merged(stored.unionByName(p))
    again = composition.enclosure(stored, grid, [0.3])
    a, b = ({r.g: r for r in x.collect()} for x in (whole, again))
    assert a.keys() == b.keys() == {0, 1, 2}
    for g in a:
        assert a[g].n == b[g].n and a[g].low == pytest.approx(b[g].low, abs=1e-11) and a[g].high == pytest.approx(b[g].high, abs=1e-11)


def test_unknown_and_empty_releases(spark):
    grid = composition.Grid(256, 9.0)
    found = of(spark, [(1, None), (1, 0.1), (2, float("nan")), (3, -0.1), (None, 0.5), (2**60 + 1, 0.5), (6, 0.0), (7, float("inf"))], grid, [0.1])
    for g in (1, 2, 3, 7):
        assert found[(g, 0.1)][:2] == (0.0, 1.0)
    assert found[(None, 0.1)][:2] == found[(2**60 + 1, 0.1)][:2] and found[(None, 0.1)][1] < 0.25
    assert found[(6, 0.1)][0] == 0.0 and found[(6, 0.1)][1] < 1e-9
    assert of(spark, [], grid, [0.1]) == {}
    assert of(spark, [(1, 100.0)], grid, [0.1])[(1, 0.1)][1] > 0.999
    with pytest.raises(ValueError):
        composition.Grid(100, 1.0)
