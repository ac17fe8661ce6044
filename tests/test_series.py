"""Chunked windows equal plain ones, also when one sensor holds most rows."""

import random

import pytest
from pyspark.sql import Window, functions as F

from gaugeflow.operators.features import trailing_measures
from gaugeflow.operators.scoring import rolling_statistics
from gaugeflow.operators.series import suggest_chunk
from gaugeflow.operators.training import horizon_labels


@pytest.fixture(scope="module")
def hot(spark):
    rng = random.Random(7)
    rows, at = [], 1_700_000_000_000_000
    for i in range(1_200):
        at += rng.choice([1, 50_000, 900_000, 40_000_000, 4_000_000_000])
        rows.append((i, "hot" if rng.random() < 0.7 else f"s{rng.randint(0, 40)}", rng.uniform(0, 10), at))
    frame = spark.createDataFrame(rows, "id long, sensor_id string, value double, at long")
    return frame.withColumn("event_time", F.timestamp_micros("at")).withColumn("cluster_id", F.lit("C1")).withColumn(
        "parameter", F.col("sensor_id")
    ).cache()


@pytest.mark.parametrize("chunk", ["1 second", "1 minute", "1 hour", "365 days"])
@pytest.mark.parametrize("rows, current", [(5, True), (11, False)])
def test_rolling_matches_plain_window(hot, chunk, rows, current):
    got = rolling_statistics(hot, rows, current, ("event_time", "id"), chunk)
    series = Window.partitionBy("sensor_id").orderBy("event_time", "id")
    frame = series.rowsBetween(1 - rows, 0) if current else series.rowsBetween(-rows, -1)
    want = hot.withColumns(
        {
            "rolling_average": F.avg("value").over(frame),
            "rolling_stddev": F.coalesce(F.stddev_samp("value").over(frame), F.lit(0.0)),
            "previous_value": F.lag("value").over(series),
        }
    )
    def view(df):
        return {r.id: (r.a, r.s, r.p) for r in df.select(
            "id", F.round("rolling_average", 8).alias("a"), F.round("rolling_stddev", 6).alias("s"),
            F.col("previous_value").alias("p")).collect()}
    assert got.count() == hot.count()
    assert view(got) == view(want)


@pytest.mark.parametrize("chunk", [None, "5 minutes", "1 hour", "30 days"])
def test_trailing_window_is_exact_and_inclusive(hot, chunk):
    got = {r.id: (r.n, r.m) for r in trailing_measures(hot, "5 minutes", chunk=chunk).select(
        "id", "n", F.round("mean", 8).alias("m")).collect()}
    rows = [(r.id, r.sensor_id, r.at, r.value) for r in hot.collect()]
    assert len(got) == len(rows)
    for i, sensor, at, _ in rows:
        near = [v for _, s, t, v in rows if s == sensor and at - 300_000_000 <= t <= at]
        assert got[i][0] == len(near)
        assert got[i][1] == pytest.approx(sum(near) / len(near), abs=1e-7)


def test_horizon_excludes_the_row_itself(spark):
    rows = spark.createDataFrame([("a", m, int(m == 12)) for m in range(20)], "run string, minute long, state int")
    for length in (1, 7, 100):
        labels = {r.minute: r.label for r in horizon_labels(rows, ["run"], "minute", "state", 5, length).collect()}
        assert [m for m in range(20) if labels[m] == 1] == [7, 8, 9, 10, 11]
        assert labels[19] is None


def test_suggested_chunk_bounds_the_largest_group(hot):
    assert suggest_chunk(hot, ["sensor_id"], "event_time", target_rows=10_000) == "365 days"
    chosen = suggest_chunk(hot, ["sensor_id"], "event_time", target_rows=20)
    from gaugeflow.operators.series import CHUNK_LADDER, time_chunk

    assert chosen in CHUNK_LADDER
    largest = hot.groupBy("sensor_id", time_chunk("event_time", chosen)).count().agg(F.max("count")).first()[0]
    assert largest <= 20 or chosen == CHUNK_LADDER[-1]


def test_repeated_moments_lose_no_row(spark):
    """Rows that tie in time, across chunk seams, come out once each."""
    rows = [("s", i // 7, float(i % 5), i) for i in range(3_000)]
    hot = spark.createDataFrame(rows, "sensor_id string, at int, value double, id int").repartition(6)
    hot = hot.withColumn("event_time", F.timestamp_seconds("at")).drop("at")
    got = rolling_statistics(hot, 5, True, ("event_time",), "2 seconds")
    assert sorted(r["id"] for r in got.select("id").collect()) == list(range(3_000))
