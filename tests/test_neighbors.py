"""Reports over many neighbours in one job equal the loop over them."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from privspan.operators import blackbox, mechanisms


@pytest.fixture(scope="module")
def people(spark):
    g = np.random.default_rng(6)
    rows = [(i, float(g.normal()), float(g.normal() + 1)) for i in range(40)] + [(39, 2.0, -1.0), (None, 1.0, 1.0), (50, None, 3.0), (51, 40.0, 0.0)]
    return spark.createDataFrame(rows, "id long, a double, b double")


@pytest.mark.parametrize(("r", "noise"), [(1, 0.0), (3, 1.5)])
def test_samples_of_all_neighbours_equal_each_ones_own(people, r, noise):
    chosen = F.col("id").isin(0, 7, 39, 50, 51) | F.col("id").isNull()
    table, neighbors = mechanisms.neighbor_samples(people, "id", ["a", "b"], chosen, 0.1, 30, "k", r, noise)
    found = {(x.left_out, x.sample_id): x.x for x in neighbors.collect()}
    assert len(found) == 5 * 30
    known = {x.sample_id: x.x for x in table.collect()}
    for o in (0, 7, 39, 50, 51):
        for x in mechanisms.labelled_samples(people, "id", ["a", "b"], o, 0.1, 30, "k", r, noise).collect():
            if x.y:
                assert known[x.sample_id] == pytest.approx(x.x)
            else:
                assert found[o, x.sample_id] == pytest.approx(x.x, abs=1e-9)


def test_estimates_of_all_neighbours_equal_the_loop(people):
    table, neighbors = mechanisms.neighbor_samples(people, "id", ["a"], F.col("id").isin(3, 50, 51), 0.1, 60, "k")
    got = {x.left_out: x for x in blackbox.estimate_each(table, neighbors, 0.1).collect()}
    assert set(got) == {3, 50, 51}
    for o, x in got.items():
        samples = mechanisms.labelled_samples(people, "id", ["a"], o, 0.1, 60, "k")
        want = blackbox.estimate(samples.where("sample_id % 4 < 2"), samples.where("sample_id % 4 >= 2"), 0.1).first()
        assert [x[c] for c in ("estimated_delta", "accuracy", "low", "high", "training_size", "validation_size")] == pytest.approx([want[c] for c in ("estimated_delta", "accuracy", "low", "high", "training_size", "validation_size")])


def test_neighbours_are_one_job_and_none_give_none(people, monkeypatch):
    table, neighbors = mechanisms.neighbor_samples(people, "id", ["a"], F.lit(False), 0.1, 20, "k")
    assert blackbox.estimate_each(table, neighbors, 0.1).collect() == []
    monkeypatch.setattr(blackbox, "MOST_SHARED", 5)
    with pytest.raises(ValueError, match="at a time"):
        blackbox.estimate_each(table, neighbors, 0.1)
