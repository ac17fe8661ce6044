"""Tables stored as folders, several data batches, and ids that look like numbers."""

import pytest
from pyspark.sql import functions as F

from gaugeflow.operators.cooldown import apply_cooldown
from gaugeflow.plans.catalogue import registered
from gaugeflow.plans.stations import Stations
from gaugeflow.sources import tables
from gaugeflow.streaming import runtime

SF_DIR = "/root/testdata/sf0.001"
BATCH_TWIN = {
    "stream_hourly": "hourly_aggregates",
    "stream_daily": "daily_aggregates",
    "stream_latest": "latest_readings",
    "stream_cooldown": "alert_cooldown",
    "stream_features": "window_features",
    "stream_alert_topic": "alert_topic",
    "stream_metrics": "pipeline_metrics",
}


@pytest.fixture(scope="module")
def folder_dir(spark, tmp_path_factory):
    """The tables with ``events`` as a folder of four files, in event order."""
    root = tmp_path_factory.mktemp("sf")
    for name in ("supplier", "region"):
        spark.read.parquet(f"{SF_DIR}/{name}.parquet").write.parquet(f"{root}/{name}.parquet")
    events = spark.read.parquet(f"{SF_DIR}/events.parquet")
    parts = [F.col("ts") < "2024-01-08", F.col("ts").between("2024-01-08", "2024-01-15"), F.col("ts").between("2024-01-15 00:00:00.000001", "2024-01-22"), F.col("ts") > "2024-01-22"]
    for part in parts:  # one after the other, so that a stream takes them in event order
        events.filter(part).coalesce(1).write.mode("append").parquet(f"{root}/events.parquet")
    return str(root)


def rows_of(df):
    return sorted(tuple(str(r[c]) for c in sorted(df.columns)) for r in df.collect())


@pytest.mark.parametrize("name", sorted(BATCH_TWIN))
def test_streams_read_a_folder(spark, folder_dir, name):
    queries = registered()
    found = rows_of(queries[name](spark, folder_dir))
    assert found and found == rows_of(queries[BATCH_TWIN[name]](spark, SF_DIR))


def test_several_data_batches_add_up(spark, folder_dir, tmp_path, monkeypatch):
    def one_file_at_a_time(self):
        schema = self.table("events").schema
        return self.spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{self.root}/events*.parquet")

    monkeypatch.setattr(Stations, "event_stream", one_file_at_a_time)
    queries = registered()
    for name in ("stream_hourly", "stream_metrics", "stream_cooldown"):
        found = rows_of(queries[name](spark, folder_dir))
        assert found == rows_of(queries[BATCH_TWIN[name]](spark, SF_DIR)), name


def test_ids_like_numbers_stay_apart(spark, tmp_path):
    rows = spark.createDataFrame([("007", 1.0), ("7", 2.0)], "cluster_id string, value double").selectExpr(
        "cluster_id", "'p' AS parameter", "DATE '2024-01-01' AS bucket_date", "TIMESTAMP '2024-01-01 10:00:00' AS event_time",
        "'s' AS sensor_id", "'s' AS local_sensor_id", "value", "'u' AS unit", "'normal' AS quality_status",
        "TIMESTAMP '2024-01-01 10:00:00' AS ingestion_time",
    )
    tables.append_batch(rows, str(tmp_path), "readings_by_cluster_parameter_day", 0)
    read = tables.read_table(spark, str(tmp_path), "readings_by_cluster_parameter_day")
    assert sorted((r["cluster_id"], r["value"]) for r in read.collect()) == [("007", 1.0), ("7", 2.0)]
    tables.compact_table(spark, str(tmp_path), "readings_by_cluster_parameter_day", str(tmp_path / "later"), "2024-05-01 00:00:00")
    assert tables.read_table(spark, str(tmp_path / "later"), "readings_by_cluster_parameter_day").count() == 0


@pytest.mark.parametrize("seconds", [0, -5])
def test_without_a_cooldown_every_alert_passes(spark, tmp_path, seconds):
    alerts = spark.createDataFrame([("s", "t", i // 2, f"a{i}") for i in range(6)], "sensor_id string, alert_type string, at int, alert_id string")
    alerts = alerts.withColumn("event_time", F.timestamp_seconds("at")).drop("at")
    assert apply_cooldown(alerts, seconds).count() == 6
    alerts.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(alerts.schema).parquet(str(tmp_path / "in"))
    writer = runtime.cooldown_writer(str(tmp_path / "out"), seconds)
    runtime.start(stream, writer, "all", str(tmp_path / "c"), drain=True).awaitTermination()
    assert runtime.sent_alerts(spark, str(tmp_path / "out"), alerts.schema).count() == 6
