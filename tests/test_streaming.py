"""Streams drained over several micro-batches equal their batch forms."""

import json
import random
import time

import pytest
from pyspark.sql import functions as F, types as T

from gaugeflow.operators import aggregates, features
from gaugeflow.operators.alerts import derive_alerts
from gaugeflow.operators.cooldown import apply_cooldown
from gaugeflow.operators.latest import dedup_readings, latest_readings
from gaugeflow.operators.model import train_risk_model
from gaugeflow.operators.scoring import score_anomalies
from gaugeflow.sources import readings as sources, tables
from gaugeflow.streaming import aggregates as stream_aggregates, runtime, stateful
from gaugeflow.streaming.late import dropped_rows

START = 1_780_833_600_000_000  # 2026-06-07 12:00 UTC


@pytest.fixture(scope="module")
def enriched_schema():
    text, number, moment = T.StringType(), T.DoubleType(), T.TimestampType()
    names = {
        "sensor_id": text, "cluster_id": text, "local_sensor_id": text, "sensor_type": text, "event_time": moment,
        "parameter": text, "display_name": text, "value": number, "unit": text, "quality_status": text,
        "rule_enabled": T.BooleanType(), "normal_low": number, "normal_high": number, "critical_low": number,
        "critical_high": number, "threshold_scale": number, "rate_change_scale": number, "ingestion_time": moment,
        "bucket_date": T.DateType(), "bucket_month": text, "bucket_year": T.IntegerType(),
    }
    return T.StructType([T.StructField(n, k) for n, k in names.items()])


@pytest.fixture(scope="module")
def rows(spark, enriched_schema):
    """Two hours of readings of two clusters, three parameters each, in event order."""
    rng, data = random.Random(5), []
    for i in range(600):
        kind = ("pH", "ORP", "turbidity")[i % 3]
        cluster = "C1" if rng.random() < 0.8 else "C2"
        data.append((cluster, kind, {"pH": 7.0, "ORP": 400.0, "turbidity": 8.0}[kind] + rng.gauss(0, 2), START + i * 12_000_000 + rng.randint(0, 999)))
    bounds = {"pH": (6.5, 9.0, 6.0, 9.5, 1.0, 1.0), "ORP": (300.0, 500.0, 100.0, 700.0, 200.0, 100.0), "turbidity": (0.0, 10.0, -1.0, 50.0, 15.0, 5.0)}
    frame = spark.createDataFrame([(*d, *bounds[d[1]]) for d in data], "cluster_id string, parameter string, value double, at long, normal_low double, normal_high double, critical_low double, critical_high double, threshold_scale double, rate_change_scale double")
    moment = F.timestamp_micros("at")
    full = frame.withColumns(
        {
            "local_sensor_id": F.concat(F.lit("S_"), "parameter"), "sensor_id": F.concat("cluster_id", F.lit("S_"), "parameter"),
            "sensor_type": F.col("parameter"), "display_name": F.col("parameter"), "unit": F.lit("u"), "event_time": moment,
            "ingestion_time": moment, "bucket_date": F.to_date(moment), "bucket_month": F.date_format(moment, "yyyy-MM"),
            "bucket_year": F.year(moment), "rule_enabled": F.lit(True),
            "quality_status": F.when((F.col("value") < F.col("normal_low")) | (F.col("value") > F.col("normal_high")), "alert").otherwise("normal"),
        }
    )
    return spark.createDataFrame(full.select(*enriched_schema.names).collect(), enriched_schema).cache()


def in_files(frame, path, count):
    """The rows in event order over ``count`` files, each file one micro-batch."""
    ordered = frame.orderBy("event_time").collect()
    size = -(-len(ordered) // count)
    for i in range(0, len(ordered), size):
        part = frame.sparkSession.createDataFrame(ordered[i : i + size], frame.schema)
        part.coalesce(1).write.mode("append").parquet(path)
        time.sleep(1.05)
    return sources.read_readings_stream(frame.sparkSession, "parquet", frame.schema, path, maxFilesPerTrigger="1")


@pytest.fixture(scope="module")
def stream(rows, tmp_path_factory):
    return in_files(rows, str(tmp_path_factory.mktemp("in")), 4)


def drained(spark, out, path, mode="append"):
    runtime.use_rocksdb(spark)
    query = out.writeStream.format("parquet").option("path", f"{path}/rows").option("checkpointLocation", f"{path}/cp")
    query.outputMode(mode).trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(out.schema).parquet(f"{path}/rows")


def as_set(frame, *columns):
    rounded = [F.round(c, 8).alias(c) if dict(frame.dtypes)[c] == "double" else F.col(c) for c in columns]
    found = [tuple(r) for r in frame.select(*rounded).collect()]
    assert len(found) == len(set(found))
    return set(found)


SCORE = ("sensor_id", "event_time", "rolling_average", "rolling_stddev", "rate_of_change", "anomaly_score", "anomaly_level", "explanation")


def test_scores_continue_across_batches(spark, rows, stream, tmp_path):
    out = stateful.stream_scores(stream, watermark="0 seconds")
    assert as_set(drained(spark, out, tmp_path), *SCORE) == as_set(score_anomalies(rows), *SCORE)


def test_rolled_writer_puts_late_rows_aside(spark, rows, tmp_path):
    """Three files, newest first, one a batch: every row is scored, late, or younger than the delay."""
    ordered = rows.orderBy("event_time").collect()
    for delay, held in (("0 seconds", 0), ("10 minutes", 50)):
        root = str(tmp_path / delay.split()[0])
        for at in (400, 200, 0):
            spark.createDataFrame(ordered[at : at + 200], rows.schema).coalesce(1).write.mode("append").parquet(f"{root}/in")
            time.sleep(1.05)
        source = sources.read_readings_stream(spark, "parquet", rows.schema, f"{root}/in", maxFilesPerTrigger="1")
        runtime.use_rocksdb(spark)
        rolled = stateful.stream_rolling(source, watermark=delay)
        writer = runtime.fan_out(runtime.rolled_writer(root, runtime.score_writer(root)), skip_empty=False)
        runtime.start(rolled, writer, "scores", f"{root}/cp", drain=True).awaitTermination()
        scored = tables.read_table(spark, root, "ai_scores_by_sensor_day")
        late = spark.read.parquet(f"{root}/late_readings")
        newest = rows.agg(F.max("event_time") - F.expr(f"INTERVAL {delay}")).first()[0]
        passed = F.unix_millis("event_time") <= F.unix_millis(F.lit(newest))  # watermarks have milliseconds
        want = score_anomalies(spark.createDataFrame(ordered[400:], rows.schema)).filter(passed)
        assert as_set(scored, *SCORE) == as_set(want, *SCORE)
        assert late.count() == 400 and as_set(late, "sensor_id", "event_time") == as_set(spark.createDataFrame(ordered[:400], rows.schema), "sensor_id", "event_time")
        assert 200 - scored.count() == held


def test_rows_inside_the_delay_are_put_in_order(spark, rows, tmp_path):
    order = rows.orderBy("event_time").collect()
    order[100], order[160] = order[160], order[100]
    for at in range(0, 600, 150):
        spark.createDataFrame(order[at : at + 150], rows.schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        time.sleep(1.05)
    source = sources.read_readings_stream(spark, "parquet", rows.schema, f"{tmp_path}/in", maxFilesPerTrigger="1")
    released = rows.agg(F.max("event_time") - F.expr("INTERVAL 30 MINUTES")).first()[0]
    want = score_anomalies(rows).filter(F.unix_millis("event_time") <= F.unix_millis(F.lit(released)))
    assert as_set(drained(spark, stateful.stream_scores(source, watermark="30 minutes"), tmp_path), *SCORE) == as_set(want, *SCORE)


def test_state_begins_with_the_values_of_a_table(spark, rows, tmp_path):
    ordered = rows.orderBy("event_time").collect()
    before, after = (spark.createDataFrame(x, rows.schema) for x in (ordered[:300], ordered[300:]))
    out = stateful.stream_scores(in_files(after, f"{tmp_path}/in", 2), watermark="0 seconds", initial=stateful.recent_values(before))
    middle = after.agg(F.min("event_time")).first()[0]
    want = score_anomalies(rows).filter(F.col("event_time") >= F.lit(middle))
    assert as_set(drained(spark, out, tmp_path), *SCORE) == as_set(want, *SCORE)


def state_rows(query):
    return max(sum(op["numRowsTotal"] for op in json.loads(p.json)["stateOperators"]) for p in query.recentProgress)


def test_many_sensors_share_their_state(spark, rows, tmp_path):
    """5,394 sensors and one without an id, over two batches: the scores of the batch form, and fewer entries of state than sensors."""
    sensor = F.when(F.col("copy") > 0, F.concat_ws("-", "sensor_id", "copy"))
    many = rows.orderBy("event_time").limit(12).crossJoin(spark.range(900).withColumnRenamed("id", "copy")).withColumn("sensor_id", sensor).drop("copy")
    runtime.use_rocksdb(spark)
    out = stateful.stream_scores(in_files(many.select(*rows.columns), f"{tmp_path}/in", 2), watermark="0 seconds")
    query = out.writeStream.format("parquet").option("path", f"{tmp_path}/rows").option("checkpointLocation", f"{tmp_path}/cp")
    query = query.trigger(availableNow=True).start()
    query.awaitTermination()
    found, want = spark.read.schema(out.schema).parquet(f"{tmp_path}/rows"), score_anomalies(many)
    columns = [F.round(c, 8).alias(c) if dict(found.dtypes)[c] == "double" else F.col(c) for c in SCORE]
    listed = lambda frame: sorted(map(str, frame.select(*columns).collect()))
    assert listed(found) == listed(want)
    assert 0 < state_rows(query) < many.select("sensor_id").distinct().count()


def test_many_alarms_share_their_state(spark, tmp_path):
    """3,000 keys with a gap inside a batch, one between batches, and an open episode that the watermark closes."""
    kind = "sensor_id string, alert_type string, severity string, event_time timestamp"
    at = lambda minute: F.timestamp_seconds(F.lit(START // 1_000_000) + 60 * minute)
    steps = spark.createDataFrame([(0, "WARNING"), (3, "CRITICAL"), (20, "WARNING"), (26, "WARNING"), (90, "CRITICAL")], "minute int, severity string")
    keys = spark.range(3_000).select(F.when(F.col("id") > 0, F.format_string("s%d", "id")).alias("sensor_id"), F.lit("LOW").alias("alert_type"))
    alerts = keys.crossJoin(steps).select("sensor_id", "alert_type", "severity", at(F.col("minute")).alias("event_time"))
    alerts = spark.createDataFrame(alerts.collect(), kind)
    runtime.use_rocksdb(spark)
    out = stateful.stream_alarms(in_files(alerts, f"{tmp_path}/in", 2), "10 minutes", watermark="0 seconds")
    query = out.writeStream.format("parquet").option("path", f"{tmp_path}/rows").option("checkpointLocation", f"{tmp_path}/cp")
    query = query.trigger(availableNow=True).start()
    query.awaitTermination()
    found = spark.read.schema(out.schema).parquet(f"{tmp_path}/rows")
    minute = lambda c: ((F.unix_seconds(c) - START // 1_000_000) / 60).cast("int").alias(c)
    counted = found.groupBy("state", "severity", minute("first_seen"), minute("last_seen"), "alert_count").agg(F.count_distinct(F.coalesce("sensor_id", F.lit(""))).alias("n"), F.count("*").alias("rows"))
    assert {tuple(r) for r in counted.collect()} == {
        ("ACTIVE", "WARNING", 0, 0, 1, 3_000, 3_000), ("RESOLVED", "CRITICAL", 0, 3, 2, 3_000, 3_000),
        ("ACTIVE", "WARNING", 20, 20, 1, 3_000, 3_000), ("RESOLVED", "WARNING", 20, 26, 2, 3_000, 3_000),
        ("ACTIVE", "CRITICAL", 90, 90, 1, 3_000, 3_000),
    }
    assert 0 < state_rows(query) < 4 * stateful.BUCKETS


def test_repeats_over_batches_come_once(spark, rows, tmp_path):
    ordered = rows.orderBy("event_time").collect()
    for part in (ordered[:300], ordered[200:] + ordered[:50]):
        spark.createDataFrame(part, rows.schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        time.sleep(1.05)
    source = sources.read_readings_stream(spark, "parquet", rows.schema, f"{tmp_path}/in", maxFilesPerTrigger="1")
    out = drained(spark, stream_aggregates.stream_dedup(source, watermark="1 day"), tmp_path)
    want = dedup_readings(rows, ["ingestion_time"])
    assert as_set(out, "sensor_id", "event_time", "value") == as_set(want, "sensor_id", "event_time", "value")


def test_cooldown_carries_over(spark, rows, stream, tmp_path):
    columns = ("sensor_id", "alert_type", "event_time", "alert_id")
    alerts, seen = derive_alerts(stream, F.col("ingestion_time")).select(*columns), []
    writer = runtime.cooldown_writer(f"{tmp_path}/sent", 600)

    def twice(batch, batch_id):  # a replayed batch changes nothing
        writer(batch, batch_id)
        writer(batch, batch_id)
        seen.append(batch_id)

    runtime.start(alerts, runtime.fan_out(twice), "cooldown", f"{tmp_path}/cp", drain=True).awaitTermination()
    want = apply_cooldown(derive_alerts(rows, F.col("ingestion_time")).select(*columns), 600)
    assert len(seen) == 4
    assert as_set(runtime.sent_alerts(spark, f"{tmp_path}/sent", alerts.schema), *columns) == as_set(want, *columns)


def test_cooldown_of_batches_with_missing_keys_and_times(spark, tmp_path):
    schema = "sensor_id string, alert_type string, event_time timestamp, alert_id string"
    at = lambda minute: F.timestamp_seconds(F.lit(START // 1_000_000 + 60 * minute))
    frame = lambda *rows: spark.createDataFrame(rows, "sensor_id string, alert_type string, m int, alert_id string").withColumn("event_time", at(0) + F.make_dt_interval(mins="m")).select("sensor_id", "alert_type", "event_time", "alert_id")
    write = runtime.cooldown_writer(str(tmp_path / "sent"), 600)
    write(frame(("a", "LOW", None, "untimed")), 0)
    write(frame((None, "LOW", 0, "1"), ("a", "LOW", 0, "2"), ("a", None, 5, "3")), 1)
    write(frame((None, "LOW", 9, "held"), ("a", "LOW", 10, "4"), ("a", "LOW", 10, "5"), ("a", None, 14, "held"), ("b", "LOW", 1, "6")), 2)
    write(frame((None, "LOW", 10, "7"), ("a", "LOW", 19, "held")), 3)
    sent = runtime.sent_alerts(spark, str(tmp_path / "sent"), spark.createDataFrame([], schema).schema)
    assert sorted(r.alert_id for r in sent.collect()) == ["1", "2", "3", "4", "6", "7"]


HOURLY = ("cluster_id", "parameter", "unit", "window_start", "reading_count", "avg_value", "min_value", "max_value", "last_value")


def test_update_mode_upserts_equal_batch_aggregates(spark, rows, stream, tmp_path):
    root, table = str(tmp_path), "readings_hourly_by_cluster_parameter"
    writer = runtime.fan_out(runtime.table_writer(root, table))
    runtime.start(stream_aggregates.stream_hourly(stream), writer, "hourly", f"{root}/cp", "update", drain=True).awaitTermination()
    assert as_set(tables.read_table(spark, root, table), *HOURLY) == as_set(aggregates.hourly_aggregates(rows), *HOURLY)


def test_features_close_with_the_watermark(spark, rows, stream, tmp_path):
    kinds = ("pH", "ORP", "turbidity")
    out = stream_aggregates.stream_features(stream, kinds, "10 minutes", watermark="1 minute")
    names = ("location_id", "prediction_time", *features.feature_columns(kinds))
    last = rows.agg(F.max("event_time") - F.expr("INTERVAL 1 MINUTE")).first()[0]
    want = features.window_features(rows, kinds, "10 minutes").filter(F.col("prediction_time") <= F.lit(last))
    assert as_set(drained(spark, out, tmp_path), *names) == as_set(want, *names) != set()


def test_alarm_changes(spark, rows, tmp_path):
    base = derive_alerts(rows, F.col("ingestion_time")).limit(1).collect()[0].asDict()
    def at(minute, severity="WARNING"):
        return {**base, "event_time": F_time(minute), "severity": severity}
    from datetime import datetime, timedelta
    def F_time(minute):
        return datetime(2026, 6, 7, 12) + timedelta(minutes=minute)
    schema = derive_alerts(rows, F.col("ingestion_time")).schema
    alerts = spark.createDataFrame([tuple(at(m, s)[f] for f in schema.names) for m, s in [(0, "WARNING"), (3, "CRITICAL"), (20, "WARNING"), (90, "WARNING")]], schema)
    out = stateful.stream_alarms(in_files(alerts, f"{tmp_path}/in", 4), watermark="0 seconds")
    got = [(r.state, r.first_seen.minute, r.last_seen.minute, r.alert_count, r.severity) for r in drained(spark, out, tmp_path).orderBy("last_seen", "state").collect()]
    assert ("ACTIVE", 0, 0, 1, "WARNING") in got and ("RESOLVED", 0, 3, 2, "CRITICAL") in got
    assert ("ACTIVE", 20, 20, 1, "WARNING") in got and ("RESOLVED", 20, 20, 1, "WARNING") in got
    assert ("ACTIVE", 30, 30, 1, "WARNING") in got and len(got) == 5


def late_count(spark, rows, path, groups):
    """Rows counted in 10:00-11:00 style hours when the groups arrive as separate batches."""
    from datetime import datetime
    base = rows.filter("parameter = 'pH'").first().asDict()
    for group in groups:
        part = [tuple({**base, "event_time": datetime(2026, 6, 7, *t)}[f] for f in rows.schema.names) for t in group]
        spark.createDataFrame(part, rows.schema).coalesce(1).write.mode("append").parquet(f"{path}/in")
        time.sleep(1.05)
    source = sources.read_readings_stream(spark, "parquet", rows.schema, f"{path}/in", maxFilesPerTrigger="1")
    writer = runtime.fan_out(runtime.table_writer(str(path), "readings_hourly_by_cluster_parameter"))
    runtime.start(stream_aggregates.stream_hourly(source), writer, "late", f"{path}/cp", "update", drain=True).awaitTermination()
    stored = tables.read_table(spark, str(path), "readings_hourly_by_cluster_parameter")
    return {r.window_start.hour: r.reading_count for r in stored.collect()}


def test_late_row_is_dropped_one_batch_after_the_watermark_jump(spark, rows, tmp_path):
    early = [(10, 5), (10, 30)]
    assert late_count(spark, rows, tmp_path / "a", [early, [(12, 0)], [(10, 40)]])[10] == 3
    counter = dropped_rows(spark)
    assert late_count(spark, rows, tmp_path / "b", [early, [(12, 0)], [(12, 1)], [(10, 40)]])[10] == 2
    for _ in range(100):  # listeners hear of a batch after it
        if counter.counts().get("late"):
            break
        time.sleep(0.1)
    spark.streams.removeListener(counter)
    assert counter.counts()["late"] == 1
    assert late_count(spark, rows, tmp_path / "c", [[(10, 5)], [(10, 58)], [(10, 59)], [(10, 10)]])[10] == 4


def test_trailing_features_of_each_batch_and_replay(spark, rows, tmp_path):
    kinds, batches = ("pH", "ORP", "turbidity"), {}
    ordered = rows.orderBy("event_time").collect()
    writer = runtime.trailing_feature_writer(f"{tmp_path}/state", lambda out, n: batches.update({n: out.collect()}), kinds, "20 minutes")
    for number, at in enumerate((0, 150, 300, 450, 450)):
        batch = spark.createDataFrame(ordered[at : at + 150], rows.schema)
        writer(batch, min(number, 3))  # the last one twice
        want = features.features_at(spark.createDataFrame(ordered[: at + 150], rows.schema), batch.agg(F.max("event_time")).first()[0], kinds, "20 minutes")
        near = [[round(x, 8) if isinstance(x, float) else str(x) for x in r] for r in sorted(batches[min(number, 3)])]
        assert near == [[round(x, 8) if isinstance(x, float) else str(x) for x in r] for r in sorted(want.collect())] != []
    writer(rows.limit(0), 4)
    assert 4 not in batches


def test_days_that_no_span_reaches_are_dropped(spark, rows, tmp_path):
    from datetime import timedelta

    seen = []
    writer = runtime.trailing_feature_writer(str(tmp_path), lambda out, n: seen.append(out.count()), ("pH", "ORP", "turbidity"), "5 hours", keep_days=1)
    for day in range(6):
        writer(rows.withColumn("event_time", F.col("event_time") + F.lit(timedelta(days=day))), day)
    assert len(seen) == 6 and all(seen)
    assert len(list(tmp_path.glob("batch_id=*/day=*"))) <= 3


def test_whole_pipeline_and_restart(spark, rows, tmp_path):
    root, source = str(tmp_path / "tables"), str(tmp_path / "in")
    kinds = ("pH", "ORP", "turbidity")
    names = features.feature_columns(kinds)
    labelled = features.window_features(rows, kinds, "5 minutes").withColumn("target_class", F.when(F.col("critical_count_5m") > 0, "storm_runoff").otherwise("normal"))
    fitted = train_risk_model(labelled, names, numTrees=3, maxDepth=3, minInstancesPerNode=1)
    ordered = rows.orderBy("event_time")
    middle = rows.agg(F.min("event_time") + F.expr("INTERVAL 1 HOUR")).first()[0]
    for part in (ordered.filter(F.col("event_time") < F.lit(middle)), ordered.filter(F.col("event_time") >= F.lit(middle))):
        stream = in_files(part, source, 2)
        started = runtime.start_pipeline(stream, root, str(tmp_path / "cp"), fitted, drain=True, watermark="0 seconds", features={"parameters": kinds})
        for query in started:
            query.awaitTermination()
    read = {name: tables.read_table(spark, root, name) for name in (
        "readings_by_sensor_day", "readings_by_cluster_parameter_day", "latest_readings_by_cluster", "alerts_by_sensor_day",
        "alerts_by_cluster_day", "readings_hourly_by_cluster_parameter", "readings_daily_by_cluster_parameter",
        "ai_scores_by_sensor_day", "ml_predictions_by_location_minute", "latest_ml_predictions_by_location")}
    assert read["readings_by_sensor_day"].count() == read["readings_by_cluster_parameter_day"].count() == rows.count()
    view = ("sensor_id", "event_time", "value")
    assert as_set(read["latest_readings_by_cluster"], *view) == as_set(latest_readings(rows), *view)
    assert read["alerts_by_sensor_day"].count() == read["alerts_by_cluster_day"].count() == derive_alerts(rows).count()
    assert as_set(read["readings_hourly_by_cluster_parameter"], *HOURLY) == as_set(aggregates.hourly_aggregates(rows), *HOURLY)
    assert as_set(read["ai_scores_by_sensor_day"], *SCORE) == as_set(score_anomalies(rows), *SCORE)
    assert read["ml_predictions_by_location_minute"].count() >= 2
    assert read["latest_ml_predictions_by_location"].count() == read["ml_predictions_by_location_minute"].select("location_id").distinct().count()


def test_kafka_options():
    options = sources.kafka_source_options("broker:9092", "readings")
    assert options["startingOffsets"] == "earliest" and "maxOffsetsPerTrigger" not in options
    assert options["failOnDataLoss"] == "true" and options["subscribe"] == "readings"
    bounded = sources.kafka_source_options("b", "t", "latest", max_offsets=600, fail_on_data_loss=False)
    assert (bounded["startingOffsets"], bounded["maxOffsetsPerTrigger"], bounded["failOnDataLoss"]) == ("latest", "600", "false")
