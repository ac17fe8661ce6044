import random

import pytest
from pyspark.sql import functions as F

from gaugeflow.operators.cooldown import apply_cooldown

SCHEMA = "sensor_id string, alert_type string, at long, alert_id string, note string"


def greedy(times, cooldown):
    kept, last = [], None
    for t in sorted(times):
        if last is None or t - last >= cooldown:
            kept.append(t)
            last = t
    return kept


def alerts(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).withColumn("event_time", F.timestamp_micros("at"))


def test_fixture(spark):
    rows = [("s", "HIGH", t * 1_000_000, str(i), "n") for i, t in enumerate([700, 0, 100, 300, 350])]
    kept = apply_cooldown(alerts(spark, rows)).collect()
    assert sorted(r["at"] // 1_000_000 for r in kept) == [0, 300, 700]


@pytest.mark.parametrize("chunk", [None, "1 hour", "10 minutes", "1 minute"])
def test_hot_and_moderate_keys(spark, chunk):
    rng = random.Random(3)
    rows = []
    for i in range(2_000):
        sensor = rng.choices(["hot", "a", "b", None], [80, 10, 5, 5])[0]
        rows.append((sensor, rng.choice(["LOW", "HIGH"]), rng.randint(0, 200_000) * 250_000, f"{i:05d}", "n"))
    kept = apply_cooldown(alerts(spark, rows), 300, chunk=chunk)
    got = sorted((r.sensor_id or "", r.alert_type, r.at) for r in kept.collect())
    want = []
    for key in {(r[0], r[1]) for r in rows}:
        times = [r[2] for r in rows if (r[0], r[1]) == key]
        want += [(key[0] or "", key[1], t) for t in greedy(times, 300_000_000)]
    assert got == sorted(want)
    assert kept.columns == alerts(spark, rows).columns


def test_dense_sparse_and_tied_series(spark):
    rng = random.Random(9)
    rows, want = [], []
    for key in range(25):
        times = sorted(rng.randint(0, 400) * rng.choice([1, 1, 40]) * 1_000_000 for _ in range(rng.randint(1, 90)))
        rows += [(f"s{key}", "LOW", t, f"{key}-{i:03d}", "n") for i, t in enumerate(times)]
        want += [(f"s{key}", t, f"{key}-{times.index(t):03d}") for t in greedy(times, 60_000_000)]
    rng.shuffle(rows)
    kept = apply_cooldown(alerts(spark, rows + rows[:40]), 60, chunk="1 minute").collect()
    assert sorted((r.sensor_id, r.at, r.alert_id) for r in kept) == sorted(want)


def test_no_python_in_the_plan_and_no_alerts(spark):
    kept = apply_cooldown(alerts(spark, [("s", "LOW", 5, "a", "n")]), 300)
    assert "Pandas" not in kept._jdf.queryExecution().toString()
    assert apply_cooldown(alerts(spark, []), 300).count() == 0
