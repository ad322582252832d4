"""The grid generator does not repeat itself, root finders say where there is no root, and medians hold for any doubles."""

import math

import numpy as np
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from privspan.operators import mechanisms, relational, rng, spectra


def test_cells_and_rows_do_not_repeat():
    draw, k = np.divmod(np.arange(2_000_000), 10)
    a, b = rng.cells("key", "row", draw, k)
    assert len(np.unique(a.astype(np.uint64) << np.uint64(32) | b)) == len(draw)
    a, b = rng.row_words("key", "row", np.arange(2_000_000) * 4_294_967_296 + 7)
    assert len(np.unique(a.astype(np.uint64) << np.uint64(32) | b)) == len(draw)


def test_words_that_agree_by_half_do_not_make_equal_normals():
    """Pairs of draw and k whose first words agree, as do their radius and angle if these hang on it alone."""
    draw, k = np.divmod(np.arange(2_000_000), 10)
    a, b = rng.cells("key", "row", draw, k)
    for word in (a, b):
        order = np.argsort(word, kind="stable")
        twins = np.flatnonzero(word[order][1:] == word[order][:-1])[:200]
        assert len(twins) > 50
        x, y = order[twins], order[twins + 1]
        z = rng.grid_normals("key", "row", np.arange(400), draw[np.r_[x, y]], k[np.r_[x, y]])
        one, two = z[:, : len(twins)], z[:, len(twins) :]
        assert (one == two).mean() < 1e-4
        assert abs(np.mean(one * two)) < 0.03 and abs(np.mean((one**2 - 1) * (two**2 - 1))) < 0.06


def test_normals_of_the_grid_are_normal_and_independent():
    z = rng.grid_normals("key", "row", np.arange(1000), np.repeat(np.arange(100), 10), np.tile(np.arange(10), 100))
    assert abs(z.mean()) < 4e-3 and abs(z.var() - 1) < 6e-3 and abs((z**4).mean() - 3) < 0.03
    across = np.corrcoef(z, rowvar=False)[np.triu_indices(1000, 1)]
    assert abs(across).max() < 0.2 and abs(across.std() - 1000**-0.5) < 1e-3
    down = np.corrcoef(z)[np.triu_indices(1000, 1)]
    assert abs(down).max() < 0.2 and abs(down.std() - 1000**-0.5) < 1e-3
    for p in (1e-4, 1e-5):
        cut = -math.sqrt(2) * _erfinv(2 * p - 1)
        assert (abs(z) > cut).mean() == pytest.approx(2 * p, rel=0.6)


def _erfinv(x):
    lo, hi = -6.0, 6.0
    for _ in range(80):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if math.erf(mid) < x else (lo, mid)
    return lo


def test_sketches_of_many_draws_are_uncorrelated(spark):
    """20,000 draws of two projections of one table: squares too, which repeated radii would tie together."""
    df = spark.range(40).select("id", F.lit(1.0).alias("x"))
    z = np.array(mechanisms.project(df, "id", ["x"], 2, 20_000, "key").orderBy("draw", "k").select("x").collect()).reshape(-1, 2) / math.sqrt(40)
    assert len(np.unique(z)) == z.size
    assert abs(np.corrcoef(z, rowvar=False)[0, 1]) < 0.03 and abs(np.corrcoef(z**2, rowvar=False)[0, 1]) < 0.03
    assert abs(np.corrcoef(z[1:, 0], z[:-1, 0])[0, 1]) < 0.03 and abs(z.var() - 1) < 0.03


ANY = st.lists(st.floats(allow_nan=False), max_size=60)


@settings(max_examples=12, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(ANY)
def test_median_of_any_doubles(spark, values):
    df = spark.createDataFrame([(v,) for v in [*values, None, math.nan]], "v double")
    values, got = sorted(values), relational.exact_median(df, "v")
    if not values:
        assert got is None
        return
    a, b = values[(len(values) - 1) // 2], values[len(values) // 2]
    want = a if a == b else a / 2 + b / 2
    assert got == want or (math.isnan(got) and math.isnan(want))


@pytest.mark.parametrize("few", [0, 10_000])
def test_median_ends_with_infinities_and_wide_ranges(spark, monkeypatch, few):
    monkeypatch.setattr(relational, "FEW", few)
    rows = spark.range(20_001).select(F.when(F.col("id") == 20_000, math.inf).otherwise(F.col("id").cast("double")).alias("v"))
    assert relational.exact_median(rows, "v") == 10_000.0
    assert relational.exact_median(rows.where("v < 20000 or v is null"), "v") == 9_999.5
    assert relational.exact_median(rows.where("v <= 4"), "v") == 2.0
    wide = spark.createDataFrame([(-1.7e308,), (1.7e308,), (5e-324,), (-5e-324,), (-0.0,), (math.inf,), (-math.inf,)], "v double")
    assert relational.exact_median(wide, "v") == 0.0
    same = spark.range(30_000).select(F.lit(-2.5).alias("v"))
    assert relational.exact_median(same, "v") == -2.5


def test_no_root_is_null(spark):
    df = spark.createDataFrame([(0.9,), (1e-4,), (1e-300,), (0.0,), (1.5,), (None,)], "delta double")
    got = [r[0] for r in df.select(spectra.ratio_for_delta("delta", 0.1, 10)).collect()]
    assert got[0] is None and 1 < got[1] < 2 and got[3:] == [None, None, None]
    back = df.limit(2).select(spectra.projection_by_ratio(0.1, spectra.ratio_for_delta("delta", 0.1, 10), 10)).collect()
    assert back[1][0] == pytest.approx(1e-4, rel=1e-6)
    got = [r[0] for r in df.select(spectra.minimal_c(1.0, "delta")).collect()]
    assert got[1] > 0 and got[3] is None and got[4] is None and got[5] is None
    assert spark.range(1).select(spectra.minimal_c(1.0, 0.5, low=1e-6, high=1e-3)).first()[0] is None
