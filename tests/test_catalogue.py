import pytest
from conftest import same_rows

from privspan.plans import catalogue


@pytest.mark.parametrize("name", sorted(catalogue.SQL))
def test_query_equals_sql(spark, duck, small, name):
    same_rows(catalogue.QUERIES[name](spark, small).toPandas(), duck.sql(catalogue.SQL[name]).df())


@pytest.mark.parametrize("name, grid", [("delta_pq_left", 1), ("delta_pq_right", 1), ("delta_kd_rlc_eps_grid", 3)])
def test_every_record_has_its_spectrum(spark, small, name, grid):
    whole = catalogue.QUERIES[name](spark, small).toPandas()
    assert sorted(whole.row_id) == sorted(grid * [r.row_id for r in catalogue.matrix(spark, small).select("row_id").collect()])
    same_rows(whole, catalogue.QUERIES[f"{name}_all_rows"](spark, small).toPandas())


def test_quadratic_forms_of_all_rows(spark, small):
    """Against a sum over one coordinate, the other by the normal distribution function."""
    import numpy as np

    from privspan.functions import gx2, numeric

    weights, dof, shift, m, s = gx2.parameters([0.5, -1.0], [[2.0, 0.3], [0.3, 1.0]], [[1.0, 0.2], [0.2, -1.5]])
    assert list(dof) == [1, 1] and s == 0
    z, step = np.linspace(-9, 9, 400_001, retstep=True)
    low, high = (0, 1) if weights[0] < 0 else (1, 0)
    first = weights[high] * (z + np.sqrt(shift[high])) ** 2
    for r in catalogue.QUERIES["quadratic_form_cdf"](spark, small).collect():
        x = [q.s_acctbal for q in spark.read.parquet(f"{small}/supplier.parquet").where(f"s_suppkey = {r.s_suppkey}").collect()][0] / 1000
        # first + w (y + c)^2 <= x with w < 0: |y + c| at least the root of what is over.
        root, c = np.sqrt(np.maximum((first + m - x) / -weights[low], 0)), np.sqrt(shift[low])
        outside = 1 - (numeric.normal_cdf(root - c) - numeric.normal_cdf(-root - c))
        assert r.p == pytest.approx(float((outside * np.exp(-z * z / 2)).sum() * step / np.sqrt(2 * np.pi)), abs=1e-5)


def test_network_learns_something(spark):
    """Two clouds apart: nearly all points of the other half are told."""
    import numpy as np

    from privspan.operators import blackbox

    g = np.random.default_rng(4)
    rows = [(i, [float(v) for v in g.normal(2.0 * (i % 2), 0.5, 4)], float(i % 2)) for i in range(400)]
    df = spark.createDataFrame(rows, "i long, x array<double>, y double")
    assert blackbox.network_accuracy(df.where("i < 200"), df.where("i >= 200"), 4).first().accuracy > 0.95
