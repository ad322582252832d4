"""Stored counts by batch: each batch once, for a table and for a stream."""

import pytest
from pyspark.sql import functions as F

from privspan.operators import blackbox
from privspan.streaming.histogram import HistogramState, combined


def rows(df):
    return sorted((str(r.x), pytest.approx(r.p0), pytest.approx(r.p1)) for r in df.collect())


def plain(df):
    return sorted((str(r.x), r.p0, r.p1) for r in df.collect())


@pytest.fixture(scope="module")
def events(spark, small):
    return spark.read.parquet(f"{small}/events.parquet").select("event_id", "event_type", (F.col("value") > 100).cast("int").alias("y"))


def test_three_batches_equal_one_pass(spark, events, tmp_path):
    state = HistogramState(spark, f"{tmp_path}/a")
    assert state.histogram().collect() == []
    for batch in (0, 1, 2, 1, 1):
        state.update(events.where(F.col("event_id") % 3 == batch), batch, "y", "event_type")
    want = rows(blackbox.joint_histogram(events, "y", "event_type"))
    assert plain(state.histogram()) == want
    assert {r.batch for r in state.counts().collect()} == {0, 1, 2}
    other = HistogramState(spark, f"{tmp_path}/b")
    other.update(events.where("event_id % 3 = 0"), 0, "y", "event_type")
    both = combined([state, other, state])
    assert plain(both) == rows(blackbox.joint_histogram(events.unionByName(events.where("event_id % 3 = 0")), "y", "event_type"))
    state.drop()
    assert not (tmp_path / "a").exists()


def test_a_stream_that_starts_again_counts_once(spark, events, tmp_path):
    events.repartition(3).write.parquet(f"{tmp_path}/in")
    state = HistogramState(spark, f"{tmp_path}/state")
    for again in range(2):
        stream = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
        q = stream.writeStream.foreachBatch(state.each_batch("y", "event_type")).option("checkpointLocation", f"{tmp_path}/check{again}").trigger(availableNow=True).start()
        q.awaitTermination(120)
        assert {r.batch for r in state.counts().collect()} == {0, 1, 2}
        assert plain(state.histogram()) == rows(blackbox.joint_histogram(events, "y", "event_type"))


def test_odd_labels_and_outcomes(spark, tmp_path):
    df = spark.createDataFrame([(None, 1), (None, None), (2.5, 0), (2.5, 7), (float("nan"), 1)], "x double, y int")
    state = HistogramState(spark, f"{tmp_path}/odd", "double")
    state.update(df, 0, "y", "x")
    state.update(df.where("false"), 1, "y", "x")
    assert plain(state.histogram()) == rows(spark.createDataFrame([("2.5", 1 / 3, 0.0), ("None", 0.0, 1 / 3), ("nan", 0.0, 1 / 3)], "x string, p0 double, p1 double"))
