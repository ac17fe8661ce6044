import pytest
from pyspark.sql import functions as F

from gaugeflow.operators import latest
from gaugeflow.operators.aggregates import daily_aggregates, hourly_aggregates, latest_minute_rollup, minute_rollup, parameter_averages
from gaugeflow.operators.alarms import group_alarms, overview_counts, system_status
from gaugeflow.schemas import TABLES
from gaugeflow.sources import tables

METRIC = (
    "cluster_id string, minute_start timestamp, processed_reading_count long, alert_count long, avg_anomaly_score double,"
    "max_anomaly_score double, avg_event_latency_ms double, max_event_latency_ms double, updated_at timestamp"
)


def ts(df, *columns):
    return df.withColumns({c: F.col(c).cast("timestamp") for c in columns})


def test_hour_and_day_boundaries_and_units(spark):
    rows = [
        ("C1", "pH", "pH", "2026-06-07 10:05:00", 1.0),
        ("C1", "pH", "pH", "2026-06-07 10:59:59", 3.0),
        ("C1", "pH", "pH", "2026-06-07 11:00:00", 5.0),
        ("C1", "pH", "other", "2026-06-07 10:10:00", 9.0),
    ]
    frame = ts(spark.createDataFrame(rows, "cluster_id string, parameter string, unit string, event_time string, value double"), "event_time")
    hours = {(r.unit, r.window_start.hour): r for r in hourly_aggregates(frame).collect()}
    ten = hours["pH", 10]
    assert (ten.reading_count, ten.avg_value, ten.min_value, ten.max_value, ten.last_value) == (2, 2.0, 1.0, 3.0, 3.0)
    assert len(hours) == 3 and ten.bucket_month == "2026-06"
    days = {r.unit: r for r in daily_aggregates(frame).collect()}
    assert (days["pH"].reading_count, days["pH"].last_value, days["pH"].bucket_year) == (3, 5.0, 2026)


def test_aggregates_hash_with_partial_step(spark):
    frame = ts(spark.createDataFrame([("C1", "pH", "u", "2026-06-07 10:05:00", 1.0)], "cluster_id string, parameter string, unit string, event_time string, value double"), "event_time")
    plan = hourly_aggregates(frame)
    text = plan._sc._jvm.PythonSQLUtils.explainString(plan._jdf.queryExecution(), "simple")
    assert "SortAggregate" not in text and text.count("HashAggregate") == 2


def test_minute_rollup_means_of_means_and_nulls(spark):
    rows = [
        ("C1", "2026-06-07 10:05:00", 9, 1, 0.1, 0.5, 1000.0, 2000.0, "2026-06-07 10:05:09"),
        ("C2", "2026-06-07 10:05:00", 1, 0, 0.4, 0.4, None, None, "2026-06-07 10:05:30"),
        ("C1", "2026-06-07 10:04:00", 5, 5, 0.9, 0.9, 1.0, 1.0, "2026-06-07 10:04:30"),
    ]
    frame = spark.createDataFrame(rows, METRIC.replace("timestamp", "string"))
    frame = ts(frame, "minute_start", "updated_at")
    newest = latest_minute_rollup(frame).first()
    assert (newest.processed_reading_count, newest.alert_count) == (10, 1)
    assert newest.avg_anomaly_score == 0.25 and newest.max_anomaly_score == 0.5
    assert newest.weighted_anomaly_score == pytest.approx(0.13)
    assert (newest.avg_event_latency_ms, newest.max_event_latency_ms, newest.weighted_event_latency_ms) == (1000.0, 2000.0, 1000.0)
    assert newest.updated_at.second == 30 and minute_rollup(frame).count() == 2
    assert latest_minute_rollup(frame.limit(0)).count() == 0


def test_latest_takes_newest_with_tie_break(spark):
    rows = [("a", 1, 10, "x"), ("a", 3, 30, "z"), ("a", 3, 40, "w"), ("b", 2, 20, None)]
    frame = spark.createDataFrame(rows, "k string, at long, id long, v string")
    got = {r.k: (r.id, r.v) for r in latest.latest_per_key(frame, ["k"], ["at", "id"]).collect()}
    assert got == {"a": (40, "w"), "b": (20, None)}


def test_retention_is_a_range_filter(spark):
    rows = ts(spark.createDataFrame([("2026-01-01",), ("2026-03-31",)], "t string"), "t")
    assert latest.retain(rows, "t", 90 * 86_400, "2026-04-01T00:00:00Z").count() == 1
    assert latest.retain(rows, "t", 89 * 86_400, "2026-03-31T00:00:00Z").count() == 1


def alert_rows(spark, rows):
    schema = "sensor_id string, alert_type string, severity string, event_time string, alert_id string, value double"
    frame = ts(spark.createDataFrame(rows, schema), "event_time")
    return frame.withColumns({"parameter": F.lit("pH"), "message": F.lit("m"), "explanation": F.lit("e")})


def test_alarm_state_and_sticky_severity(spark):
    now = "2026-06-07T12:10:00Z"
    frame = alert_rows(
        spark,
        [
            ("a", "HIGH", "CRITICAL", "2026-06-07 12:00:00", "1", 1.0),
            ("a", "HIGH", "WARNING", "2026-06-07 12:06:00", "2", 2.0),
            ("a", "HIGH", "WARNING", "2026-06-07 12:09:00", "3", 3.0),
            ("b", "LOW", "WARNING", "2026-06-07 12:00:00", "4", 4.0),
            ("b", "LOW", "WARNING", "2026-06-07 12:04:59", "5", 5.0),
            ("c", "LOW", "WARNING", "2026-06-07 12:05:00", "6", 6.0),
        ],
    )
    got = {r.sensor_id: (r.state, r.alert_count, r.severity, r.latest_value) for r in group_alarms(frame, now).collect()}
    assert got == {"a": ("ACTIVE", 3, "CRITICAL", 3.0), "b": ("RESOLVED", 2, "WARNING", 5.0), "c": ("ACTIVE", 1, "WARNING", 6.0)}


@pytest.mark.parametrize(
    "severity, level, status, count",
    [("CRITICAL", "NORMAL", "CRITICAL", 1), ("WARNING", "NORMAL", "WARNING", 1), (None, "CRITICAL", "CRITICAL", 0),
     (None, "WATCH", "WARNING", 0), (None, "NORMAL", "NORMAL", 0), (None, None, "NORMAL", 0)],
)
def test_system_status(spark, severity, level, status, count):
    rows = [("a", "HIGH", severity, "2026-06-07 12:09:00", "1", 1.0)] if severity else []
    scores = spark.createDataFrame([(level,)] if level else [], "anomaly_level string")
    found = system_status(alert_rows(spark, rows), scores, "2026-06-07T12:10:00Z").first()
    assert (found.system_status, found.active_alert_count) == (status, count)


def test_overview_counts_and_parameter_averages(spark, registry, seed_rules):
    newest = ts(
        spark.createDataFrame(
            [("pH", 7.0, "2026-06-07 12:00:00", "a", None), ("pH", 8.0, "2026-06-07 11:00:00", "b", "x"), ("mud", 1.0, "2026-06-07 11:00:00", "c", "g")],
            "parameter string, value double, event_time string, sensor_id string, unit string",
        ),
        "event_time",
    )
    counts = overview_counts(registry, alert_rows(spark, []), newest, "2026-06-07T12:10:00Z").first()
    assert (counts.active_sensor_count, counts.active_alert_count, counts.average_ph, counts.average_temperature) == (20, 0, 7.5, None)
    averages = [(r.display_name, r.unit, r.average_value) for r in parameter_averages(newest, seed_rules).collect()]
    assert averages == [("mud", "g", 1.0), ("pH", "pH", 7.5)]


def test_upserts_are_idempotent_and_newest_wins(spark, tmp_path, enrich):
    rows = [("C1S000", "pH", 7.0 + i / 10, f"2026-06-07T12:00:{i:02d}Z") for i in range(4)]
    first = enrich(rows)
    second = first.limit(2).withColumn("quality_status", F.lit("reviewed"))
    root = str(tmp_path)
    for _ in range(2):
        tables.append_batch(first, root, "readings_by_sensor_day", 0)
        tables.append_batch(second, root, "readings_by_sensor_day", 1)
        got = tables.read_table(spark, root, "readings_by_sensor_day")
        assert sorted(r.quality_status for r in got.collect()) == ["normal", "normal", "reviewed", "reviewed"]
        assert got.columns == list(TABLES["readings_by_sensor_day"].columns)
    tables.compact_table(spark, root, "readings_by_sensor_day", f"{root}/compacted")
    again = tables.read_table(spark, f"{root}/compacted", "readings_by_sensor_day")
    assert sorted(map(repr, again.collect())) == sorted(map(repr, got.collect()))
    assert tables.read_table(spark, root, "readings_by_sensor_day", "2026-12-31T00:00:00Z").count() == 0


def test_late_batch_does_not_replace_newer_latest_row(spark, tmp_path, enrich):
    newer = enrich([("C1S000", "pH", 8.0, "2026-06-07T12:00:00Z")])
    older = enrich([("C1S000", "pH", 7.0, "2026-06-07T11:00:00Z")])
    for number, batch in enumerate((newer, older)):
        tables.append_batch(latest.latest_readings(batch), str(tmp_path), "latest_readings_by_cluster", number)
    assert [r.value for r in tables.read_table(spark, str(tmp_path), "latest_readings_by_cluster").collect()] == [8.0]


def test_day_filter_prunes_partitions(spark, tmp_path, enrich):
    batch = enrich([("C1S000", "pH", 8.0, "2026-06-07T12:00:00Z"), ("C1S000", "pH", 8.0, "2026-06-08T12:00:00Z")])
    tables.append_batch(batch, str(tmp_path), "readings_by_sensor_day", 0)
    stored = tables.read_table(spark, str(tmp_path), "readings_by_sensor_day").filter("bucket_date = DATE '2026-06-08'")
    text = stored._sc._jvm.PythonSQLUtils.explainString(stored._jdf.queryExecution(), "simple")
    assert "PartitionFilters: [isnotnull(bucket_date" in text
    assert stored.count() == 1


def test_expired_days_of_a_live_table_go_in_place(spark, tmp_path):
    from datetime import datetime, timedelta

    table = "readings_by_sensor_day"
    spec = TABLES[table]
    start = datetime(2024, 1, 1, 12)
    for batch in range(4):
        values = {f.name: F.lit(None).cast(f.dataType) for f in spec.schema}
        values |= {"sensor_id": F.lit("s"), "event_time": F.lit(start + timedelta(days=batch)), "bucket_date": F.lit((start + timedelta(days=batch)).date())}
        tables.append_batch(spark.range(1).select(*[values[f.name].alias(f.name) for f in spec.schema]), str(tmp_path), table, batch)
    moment = start + timedelta(days=2, seconds=spec.ttl_seconds)
    assert tables.expire_table(spark, str(tmp_path), table, moment) == 2
    left = sorted(r["event_time"] for r in tables.read_table(spark, str(tmp_path), table).collect())
    assert left == [start + timedelta(days=2), start + timedelta(days=3)]
    assert tables.expire_table(spark, str(tmp_path), table, moment) == 0


def _table_files(spark, root, table):
    return sorted(tables.stored_rows(spark, root, table).inputFiles())


def _reading_batches(enrich, count):
    for number in range(count):
        rows = [(f"C1S00{i}", "pH", 7.0 + number / 10, f"2026-06-0{1 + (number + i) % 3}T12:00:{number % 4:02d}Z") for i in range(3)]
        yield enrich(rows).withColumn("ingestion_time", F.timestamp_seconds(F.lit(1_780_000_000 + number)))


@pytest.mark.parametrize("table", ["readings_by_sensor_day", "readings_by_cluster_parameter_day", "latest_readings_by_cluster"])
def test_files_of_a_live_table_stay_few_and_replays_change_nothing(spark, tmp_path, enrich, table):
    from gaugeflow.streaming.runtime import upkeep_writer

    plain, kept, folders = str(tmp_path / "plain"), str(tmp_path / "kept"), []
    for number, batch in enumerate(_reading_batches(enrich, 13)):
        batch = latest.latest_readings(batch) if table.startswith("latest") else batch
        tables.append_batch(batch, plain, table, number)
        for _ in range(2 if number % 3 == 0 else 1):  # a batch that merges is replayed
            tables.append_batch(batch, kept, table, number)
            upkeep_writer(kept, [table], 3)(batch, number)
        folders.append(len({f.rpartition("/")[0] for f in _table_files(spark, kept, table)}))
    expected = sorted(map(repr, tables.read_table(spark, plain, table).collect()))
    assert sorted(map(repr, tables.read_table(spark, kept, table).collect())) == expected
    assert max(folders[9:]) <= max(folders[3:6]) and folders[12] < len({f.rpartition("/")[0] for f in _table_files(spark, plain, table)})
    assert tables.merge_table(spark, kept, table, 12) and not tables.merge_table(spark, kept, table, 12)
    assert sorted(map(repr, tables.read_table(spark, kept, table).collect())) == expected


def test_a_merge_that_breaks_off_leaves_the_same_rows(spark, tmp_path, enrich):
    import shutil

    table, root = "readings_by_sensor_day", str(tmp_path / "t")
    for number, batch in enumerate(_reading_batches(enrich, 6)):
        tables.append_batch(batch, root, table, number)
    before, old = sorted(map(repr, tables.read_table(spark, root, table).collect())), _table_files(spark, root, table)
    shutil.copytree(f"{root}/{table}", tmp_path / "copy")
    assert tables.merge_table(spark, root, table, 4) == 3
    new = [f for f in _table_files(spark, root, table) if f not in old]
    for path in new[1:]:  # only the first merged file had arrived when the driver was lost, nothing was deleted
        part = path.rpartition("/batch_id=")[2]
        assert (tmp_path / "t" / table / f"batch_id={part}").exists()
    first = new[0].rpartition("/batch_id=")[2]
    target = tmp_path / "copy" / f"batch_id={first}"
    target.parent.mkdir(parents=True, exist_ok=True)
    shutil.copy(tmp_path / "t" / table / f"batch_id={first}", target)
    broken = tmp_path / "broken"
    broken.mkdir()
    shutil.copytree(tmp_path / "copy", broken / table)
    assert sorted(map(repr, tables.read_table(spark, str(broken), table).collect())) == before
    assert tables.merge_table(spark, str(broken), table, 4)
    assert sorted(map(repr, tables.read_table(spark, str(broken), table).collect())) == before


def test_merging_drops_expired_rows_and_leaves_open_batches(spark, tmp_path, enrich):
    table, root = "readings_by_sensor_day", str(tmp_path)
    for number, batch in enumerate(_reading_batches(enrich, 4)):
        tables.append_batch(batch, root, table, number)
    rows = tables.read_table(spark, root, table).count()
    assert tables.merge_table(spark, root, table, 0) == 0
    assert tables.merge_table(spark, root, table, 2, as_of="2027-06-07T00:00:00Z") == 3
    stored = tables.stored_rows(spark, root, table)
    assert {r.batch_id for r in stored.select("batch_id").distinct().collect()} == {3} and 0 < stored.count() < rows
