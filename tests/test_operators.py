import numpy as np
import pytest
from pyspark.sql import functions as F

from privspan.operators import accuracy, blackbox, linear, mechanisms, relational, rng
from privspan.sources import tables
from privspan.streaming.gram import windowed_gram


@pytest.fixture(scope="module")
def points(spark):
    x = np.random.default_rng(5).normal(size=(60, 3))
    x[:, 1] = 1
    rows = [(i, *map(float, r)) for i, r in enumerate(x)]
    return x, spark.createDataFrame(rows, "id long, a double, b double, y double")


def test_fit_and_closed_forms_of_every_neighbour(points):
    x, df = points
    fit = linear.fit(df, ["a", "b"], "y")
    b, y = x[:, :2], x[:, 2]
    assert fit.beta == pytest.approx(np.linalg.lstsq(b, y, rcond=None)[0])
    h = b @ np.linalg.inv(b.T @ b) @ b.T
    full = x @ np.linalg.inv(x.T @ x) @ x.T
    beta = fit.neighbor_beta()
    rows = fit.rows(df).select("id", "p", "w", "q", beta[0].alias("b0"), beta[1].alias("b1"), fit.neighbor_rss().alias("rss"), fit.log_det_ratio().alias("ld")).orderBy("id").collect()
    for i, r in enumerate(rows):
        c, t = b.copy(), y.copy()
        c[i], t[i] = 0, 0
        m = np.linalg.inv(c.T @ c)
        near = m @ c.T @ t
        rss = ((t - c @ near) ** 2).sum()
        assert r.p == pytest.approx(h[i, i]) and r.q == pytest.approx(full[i, i])
        assert [r.b0, r.b1] == pytest.approx(near) and r.rss == pytest.approx(rss)
        ratio = np.linalg.slogdet(m * rss)[1] - np.linalg.slogdet(fit.m * fit.rss)[1]
        assert r.ld == pytest.approx(ratio, abs=1e-10)


def test_sensitivity_is_the_largest_change(points):
    x, df = points
    fit = linear.fit(df, ["a", "b"], "y")
    best = linear.sensitivity(df, fit, "id").first()
    changes = []
    for i in range(len(x)):
        c, t = x[:, :2].copy(), x[:, 2].copy()
        c[i], t[i] = 0, 0
        changes.append(np.linalg.norm(np.linalg.lstsq(c, t, rcond=None)[0] - fit.beta))
    assert best.sensitivity == pytest.approx(max(changes)) and best.id == int(np.argmax(changes))


def test_dependent_columns_are_refused(spark):
    df = spark.createDataFrame([(1.0, 2.0, 1.0), (2.0, 4.0, 0.0)], "a double, b double, y double")
    with pytest.raises(np.linalg.LinAlgError):
        linear.fit(df, ["a", "b"], "y")


def test_normalising(points):
    x, df = points
    out = np.array(linear.normalize_features(df, ["a", "b", "y"], clip=2.0).select("a", "b", "y").collect())
    assert np.linalg.norm(out, 2) == pytest.approx(2.0)
    rows = np.array(linear.normalize_rows(df, ["a", "b"], "y").select("a", "b", "y").collect())
    assert np.linalg.norm(rows[:, :2], axis=1) == pytest.approx(np.ones(60)) and set(rows[:, 2]) <= {-1.0, 0.0, 1.0}


def test_gram_of_arrays(spark):
    x = np.random.default_rng(1).normal(size=(40, 5))
    df = spark.createDataFrame([(list(map(float, r)),) for r in x] + [(None,)], "v array<double>")
    assert linear.gram_of_arrays(df, "v", 5) == pytest.approx(x.T @ x)


def test_draws_are_normal_and_do_not_depend_on_partitions(spark):
    rows = spark.range(20000).select("id", rng.normal("k", "s", F.col("id")).alias("z"), rng.laplace("k", "l", 2.0, F.col("id")).alias("l"))
    m = rows.agg(F.avg("z"), F.stddev("z"), F.kurtosis("z"), F.avg(F.abs("l"))).first()
    assert abs(m[0]) < 0.03 and abs(m[1] - 1) < 0.03 and abs(m[2]) < 0.15 and abs(m[3] - 2) < 0.1
    again = spark.range(20000).repartition(7).select("id", rng.normal("k", "s", F.col("id")).alias("z"))
    assert rows.select("id", "z").exceptAll(again).count() == 0
    assert rng.new_key() != rng.new_key()


def test_projection_moments(spark, points):
    x, df = points
    out = mechanisms.project(df, "id", ["a", "y"], 1, 300, "k", noise=2.0)
    z = np.array(out.select("a", "y").collect())
    want = x[:, [0, 2]].T @ x[:, [0, 2]] + 4 * np.eye(2)
    assert z.T @ z / len(z) == pytest.approx(want, abs=0.35 * np.trace(want))
    by = np.array(mechanisms.project_by_distribution(df, ["a", "y"], 1, 4000, "k", noise=2.0).select("a", "y").collect())
    assert by.T @ by / len(by) == pytest.approx(want, abs=0.1 * np.trace(want))


def test_noise_rows_equal_a_stacked_fit(points):
    x, df = points
    fit = mechanisms.regularised(linear.fit(df, ["a", "b"], "y"), 3.0, 2.0)
    stacked = np.concatenate([x, 3.0 * np.eye(3), [[0, 0, 2.0]]])
    beta, rss = np.linalg.lstsq(stacked[:, :2], stacked[:, 2], rcond=None)[:2]
    assert fit.beta == pytest.approx(beta) and fit.rss == pytest.approx(rss[0])


def test_labelled_samples_have_sentinels(spark, points):
    _, df = points
    s = mechanisms.labelled_samples(df, "id", ["a", "y"], 3, 1.0, 200, "k", r=2).collect()
    assert len(s) == 400 and all(len(r.x) == 4 for r in s)
    share = np.mean([r.x[0] == relational.SENTINEL for r in s if r.y == 1])
    assert abs(share - (1 - np.exp(-1))) < 0.12 and not any(r.x[0] == relational.SENTINEL for r in s if r.y == 0)


def test_bootstrap_encloses_the_mean(spark):
    v = np.random.default_rng(2).normal(3, 1, 200)
    df = spark.createDataFrame([(i, float(x)) for i, x in enumerate(v)], "i long, v double")
    r = accuracy.bootstrap_bounds(df, "i", "v", 0.95, 60, "k").first()
    assert r.lb_two_sided <= r.lb_one_sided <= v.mean() <= r.ub_one_sided <= r.ub_two_sided
    assert r.ub_two_sided - r.lb_two_sided == pytest.approx(4 / np.sqrt(200), rel=0.5)


def test_distances_and_products(spark, points):
    x, df = points
    d = {(r.j, r.k): r.distance for r in accuracy.column_distances(df, ["a", "b", "y"]).collect()}
    assert d[2, 0] == pytest.approx(np.linalg.norm(x[:, 2] - x[:, 0]))
    sketch = mechanisms.project(df, "id", ["a", "b", "y"], 40, 2, "k")
    assert all(0.6 < r.ratio < 1.4 for r in accuracy.distance_ratios(df, sketch, ["a", "b", "y"], 40).collect())
    assert all(r.correlation > 0.8 for r in accuracy.product_correlation(df, sketch, ["a", "b", "y"], 40).collect())


@pytest.mark.parametrize("d", [2, 12])
def test_nearest_equals_brute_force(spark, d):
    x = np.random.default_rng(3).integers(0, 5, size=(200, d)).astype(float)
    train = spark.createDataFrame([(i, list(map(float, r)), float(i % 2)) for i, r in enumerate(x[:150])], "train_id long, x array<double>, y double")
    test = spark.createDataFrame([(i, list(map(float, r))) for i, r in enumerate(x[150:])], "test_id long, x array<double>")
    found = {}
    for r in blackbox.nearest(train, test, 5).collect():
        found.setdefault(r.test_id, set()).add(r.train_id)
    for i, q in enumerate(x[150:]):
        order = sorted(range(150), key=lambda j: (((x[j] - q) ** 2).sum(), j))
        assert found[i] == set(order[:5])


def test_estimate_tells_different_samples_apart(spark):
    g = np.random.default_rng(4)
    rows = [(i, float(i % 2), [float(g.normal() + 6 * (i % 2))]) for i in range(400)]
    s = spark.createDataFrame(rows, "sample_id long, y double, x array<double>")
    r = blackbox.estimate(s.where("sample_id % 4 < 2"), s.where("sample_id % 4 >= 2"), 0.1).first()
    assert r.accuracy > 0.95 and r.estimated_delta > 0.8 and r.low <= r.estimated_delta <= r.high


def test_cleaning(spark):
    df = spark.createDataFrame([(1, "1.5", "a"), (2, "*", None), (3, None, "b"), (4, "4.5", "a")], "k int, v string, t string")
    out = relational.fill_median(relational.coerce(df, ["v"]), ["v"]).orderBy("k").collect()
    assert [r.v for r in out] == [1.5, 3.0, 3.0, 4.5]
    assert [r.is_a for r in relational.indicators(df, "t", {"is_a": "a"}).orderBy("k").collect()] == [1.0, 0.0, 0.0, 1.0]
    assert tables.complete_rows(df.select(F.expr("try_cast(v as double)").alias("f"), F.col("k").alias("y")), "f", "y").count() == 2


def test_files(spark, tmp_path, points):
    x, df = points
    tables.write_matrix(df, f"{tmp_path}/m", ["y", "a"])
    back = tables.read_targeted(spark, f"{tmp_path}/m", ["a"], "y")
    assert back.columns == ["a", "constant", "y"] and back.agg(F.sum("a")).first()[0] == pytest.approx(x[:, 0].sum())
    tables.write_batches(df.withColumn("label", F.col("id") % 2), f"{tmp_path}/b", "id", 10, "label")
    part = tables.read_range(spark.read.parquet(f"{tmp_path}/b"), "id", 10, 15, 20)
    assert sorted(r.id for r in part.collect()) == list(range(15, 35))
    assert "batch_id" in part._jdf.queryExecution().toString() and "PartitionFilters: [isnotnull(batch_id" in part._jdf.queryExecution().toString()


def test_streamed_gram_equals_the_table(spark, tmp_path, small):
    events = spark.read.parquet(f"{small}/events.parquet")
    table = windowed_gram(events, "ts", ["value"], "1 day")
    events.repartition(2).write.parquet(f"{tmp_path}/in")
    stream = windowed_gram(spark.readStream.schema(events.schema).parquet(f"{tmp_path}/in"), "ts", ["value"], "1 day")
    q = stream.writeStream.outputMode("complete").format("memory").queryName("streamed_gram").start()
    q.processAllAvailable()
    q.stop()
    a = {r.start: (r.n, round(r.g_0_0, 4)) for r in table.collect()}
    assert a == {r.start: (r.n, round(r.g_0_0, 4)) for r in spark.table("streamed_gram").collect()}


def test_samples_are_made_once(spark):
    """Whatever makes the samples runs once for each half that is given, or once for both, however many jobs read them."""
    seen = spark.sparkContext.accumulator(0)

    def counted(batches):
        for batch in batches:
            seen.add(batch.num_rows)
            yield batch

    rows = [(i, float(i % 2), [float(i % 7), float(i % 2)]) for i in range(80)]
    s = spark.createDataFrame(rows, "sample_id long, y double, x array<double>").mapInArrow(counted, "sample_id long, y double, x array<double>")
    want = blackbox.estimate(s.where("sample_id % 4 < 2"), s.where("sample_id % 4 >= 2"), 0.1).first()
    assert seen.value == 2 * len(rows)
    assert blackbox.estimate_halves(s, 0.1).first() == want
    assert seen.value == 3 * len(rows)
    both = s.select(F.lit(5).alias("g"), "*").unionByName(s.select(F.lit(6).alias("g"), "*"))
    assert [(r.g, r[1:]) for r in blackbox.estimate_halves_of(both, "g", [5, 6], 0.1).orderBy("g").collect()] == [(5, tuple(want)), (6, tuple(want))]
    assert seen.value == 5 * len(rows)


def test_rows_of_one_file_are_dealt_to_all_cores(spark):
    """Sums of a sketch come from as many tasks as there are cores, though the table is one partition."""
    df = spark.range(400).select("id", (F.col("id") / 10).alias("x")).coalesce(1)
    assert mechanisms._partial_sums(df, "id", ["x"], 2, 0, 40, "k").count() == spark.sparkContext.defaultParallelism * 80
    got, one = ({(r.draw, r.k): r.x for r in mechanisms.project(d, "id", ["x"], 2, n, "k").collect()} for d, n in ((df, 40), (df.repartition(3), 40)))
    assert got.keys() == one.keys() and all(abs(got[c] - one[c]) < 1e-9 for c in got)


def test_many_batches_share_folders(spark, tmp_path):
    """1,500 batches, some of negative keys, in few files: a range opens the folders that hold it, and finds its rows."""
    df = spark.range(-500, 14_500).select("id", (F.col("id") % 2).cast("int").alias("even"), (F.col("id") * 3).alias("v")).repartition(7)
    tables.write_batches(df, f"{tmp_path}/b", "id", 10, "even")
    back = spark.read.parquet(f"{tmp_path}/b")
    assert len(back.inputFiles()) <= 3 * (tables.MOST_FOLDERS + 2)
    assert back.count() == 15_000 and back.where("batch_id <> id div 10 or batch_id not between batch_from and batch_to or v <> 3 * id").count() == 0
    part = tables.read_range(back, "id", 10, 1234, 3000)
    assert sorted(r.id for r in part.collect()) == list(range(1234, 4234)) and sorted(part.columns) == ["batch_id", "even", "id", "v"]
    plan = part._jdf.queryExecution().toString()
    assert "PartitionFilters: [isnotnull(batch_from" in plan and "GreaterThanOrEqual(batch_id,123)" in plan
