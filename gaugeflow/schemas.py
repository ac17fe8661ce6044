"""Record layouts and the keyed tables: columns, upsert key, version order, partitioning, retention."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import types as T

READING_MESSAGE = T.StructType(
    [
        T.StructField("sensor_id", T.StringType()),
        T.StructField("sensor_type", T.StringType()),
        T.StructField("value", T.DoubleType()),
        T.StructField("timestamp", T.StringType()),
    ]
)

ALERT_MESSAGE = T.StructType(
    [
        T.StructField("alert_id", T.StringType()),
        T.StructField("sensor_id", T.StringType()),
        T.StructField("cluster_id", T.StringType()),
        T.StructField("local_sensor_id", T.StringType()),
        T.StructField("parameter", T.StringType()),
        T.StructField("value", T.DoubleType()),
        T.StructField("unit", T.StringType()),
        T.StructField("alert_type", T.StringType()),
        T.StructField("severity", T.StringType()),
        T.StructField("threshold_low", T.DoubleType()),
        T.StructField("threshold_high", T.DoubleType()),
        T.StructField("message", T.StringType()),
        T.StructField("event_time", T.StringType()),
        T.StructField("processed_at", T.StringType()),
    ]
)

SENSOR_CONFIG = T.StructType(
    [
        T.StructField("cluster_id", T.StringType()),
        T.StructField("sensor_id", T.StringType()),
        T.StructField("min_value", T.DoubleType()),
        T.StructField("max_value", T.DoubleType()),
        T.StructField("sensor_type", T.StringType()),
        T.StructField("unit", T.StringType()),
        T.StructField("measure_interval_s", T.IntegerType()),
        T.StructField("config_interval_s", T.IntegerType()),
        T.StructField("updated_at", T.TimestampType()),
    ]
)

DAY = 86_400


@dataclass(frozen=True)
class TableSpec:
    """``version`` orders rows of one key when both are stored; the write batch always comes last."""

    columns: tuple[str, ...]
    keys: tuple[str, ...]
    version: tuple[str, ...] = ()
    partition_by: tuple[str, ...] = ()
    time_column: str | None = None
    ttl_seconds: int | None = None

    @property
    def schema(self) -> T.StructType:
        return T.StructType([T.StructField(c, COLUMN_TYPES[c]) for c in self.columns])


# Types of the tables' columns; a name has one type in all tables.
COLUMN_TYPES: dict[str, T.DataType] = {
    **dict.fromkeys(
        (
            "sensor_id", "cluster_id", "local_sensor_id", "parameter", "unit", "quality_status", "alert_id", "alert_type", "severity",
            "alarm_state", "message", "explanation", "bucket_month", "anomaly_level", "location_id", "risk_level",
            "predicted_event_type", "model_name", "model_version", "display_name", "sensor_type",
        ),
        T.StringType(),
    ),
    **dict.fromkeys(
        (
            "value", "threshold_low", "threshold_high", "avg_value", "min_value", "max_value", "last_value", "rolling_average",
            "rolling_stddev", "z_score", "rate_of_change", "threshold_component", "statistical_component", "rate_component",
            "anomaly_score", "avg_anomaly_score", "max_anomaly_score", "avg_event_latency_ms",
            "max_event_latency_ms", "risk_score", "normal_low",
            "normal_high", "critical_low", "critical_high", "threshold_scale", "rate_change_scale",
        ),
        T.DoubleType(),
    ),
    **dict.fromkeys(
        ("event_time", "ingestion_time", "updated_at", "processed_at", "window_start", "computed_at", "minute_start", "prediction_time"),
        T.TimestampType(),
    ),
    **dict.fromkeys(("bucket_date", "day", "metric_date", "prediction_date"), T.DateType()),
    **dict.fromkeys(("reading_count", "processed_reading_count", "alert_count"), T.LongType()),
    **dict.fromkeys(("bucket_year", "measure_interval_s", "config_interval_s", "forecast_horizon_minutes"), T.IntegerType()),
    "class_probabilities": T.StringType(),
    "enabled": T.BooleanType(),
}


# Column sets, keys and retention periods of the published tables. The aggregate keys
# also hold the unit, so two units of one parameter never overwrite each other.
TABLES = {
    "readings_by_sensor_day": TableSpec(
        (
            "sensor_id", "bucket_date", "event_time", "cluster_id", "local_sensor_id", "parameter", "value", "unit",
            "quality_status", "ingestion_time",
        ),
        ("sensor_id", "bucket_date", "event_time"),
        version=("ingestion_time",),
        partition_by=("bucket_date",),
        time_column="event_time",
        ttl_seconds=90 * DAY,
    ),
    "readings_by_cluster_parameter_day": TableSpec(
        (
            "cluster_id", "parameter", "bucket_date", "event_time", "sensor_id", "local_sensor_id", "value", "unit",
            "quality_status", "ingestion_time",
        ),
        ("cluster_id", "parameter", "bucket_date", "event_time", "sensor_id"),
        version=("ingestion_time",),
        partition_by=("bucket_date", "cluster_id"),
        time_column="event_time",
        ttl_seconds=90 * DAY,
    ),
    "latest_readings_by_cluster": TableSpec(
        (
            "cluster_id", "parameter", "sensor_id", "local_sensor_id", "event_time", "value", "unit",
            "quality_status", "updated_at",
        ),
        ("cluster_id", "parameter", "sensor_id"),
        version=("event_time", "updated_at"),
    ),
    "alerts_by_sensor_day": TableSpec(
        (
            "sensor_id", "bucket_date", "event_time", "alert_id", "cluster_id", "local_sensor_id", "parameter",
            "value", "unit", "alert_type", "severity", "threshold_low", "threshold_high", "alarm_state", "message",
            "explanation", "processed_at",
        ),
        ("sensor_id", "bucket_date", "event_time", "alert_id"),
        version=("processed_at",),
        partition_by=("bucket_date",),
        time_column="event_time",
        ttl_seconds=1825 * DAY,
    ),
    "alerts_by_cluster_day": TableSpec(
        (
            "cluster_id", "bucket_date", "event_time", "sensor_id", "local_sensor_id", "alert_id", "parameter",
            "value", "unit", "alert_type", "severity", "threshold_low", "threshold_high", "alarm_state", "message",
            "explanation", "processed_at",
        ),
        ("cluster_id", "bucket_date", "event_time", "sensor_id", "alert_id"),
        version=("processed_at",),
        partition_by=("bucket_date", "cluster_id"),
        time_column="event_time",
        ttl_seconds=1825 * DAY,
    ),
    "readings_hourly_by_cluster_parameter": TableSpec(
        (
            "cluster_id", "parameter", "bucket_month", "window_start", "reading_count", "avg_value", "min_value",
            "max_value", "last_value", "unit", "updated_at",
        ),
        ("cluster_id", "parameter", "bucket_month", "window_start", "unit"),
        version=("updated_at",),
        partition_by=("bucket_month",),
        time_column="window_start",
        ttl_seconds=400 * DAY,
    ),
    "readings_daily_by_cluster_parameter": TableSpec(
        (
            "cluster_id", "parameter", "bucket_year", "day", "reading_count", "avg_value", "min_value", "max_value",
            "last_value", "unit", "updated_at",
        ),
        ("cluster_id", "parameter", "bucket_year", "day", "unit"),
        version=("updated_at",),
        partition_by=("bucket_year",),
        time_column="day",
        ttl_seconds=1825 * DAY,
    ),
    "ai_scores_by_sensor_day": TableSpec(
        (
            "sensor_id", "bucket_date", "event_time", "cluster_id", "local_sensor_id", "parameter", "value", "unit",
            "rolling_average", "rolling_stddev", "z_score", "rate_of_change", "threshold_component",
            "statistical_component", "rate_component", "anomaly_score", "anomaly_level", "explanation",
            "computed_at",
        ),
        ("sensor_id", "bucket_date", "event_time"),
        version=("computed_at",),
        partition_by=("bucket_date",),
        time_column="event_time",
        ttl_seconds=1825 * DAY,
    ),
    "latest_ai_scores_by_cluster": TableSpec(
        (
            "cluster_id", "parameter", "sensor_id", "local_sensor_id", "event_time", "value", "unit",
            "anomaly_score", "anomaly_level", "rolling_average", "z_score", "rate_of_change", "explanation",
            "updated_at",
        ),
        ("cluster_id", "parameter", "sensor_id"),
        version=("event_time", "updated_at"),
    ),
    "pipeline_metrics_by_cluster_minute": TableSpec(
        (
            "cluster_id", "metric_date", "minute_start", "processed_reading_count", "alert_count",
            "avg_anomaly_score", "max_anomaly_score", "avg_event_latency_ms", "max_event_latency_ms", "updated_at",
        ),
        ("cluster_id", "metric_date", "minute_start"),
        version=("updated_at",),
        partition_by=("metric_date",),
        time_column="minute_start",
        ttl_seconds=1825 * DAY,
    ),
    "ml_predictions_by_location_minute": TableSpec(
        (
            "location_id", "prediction_date", "prediction_time", "forecast_horizon_minutes", "risk_score",
            "risk_level", "predicted_event_type", "class_probabilities", "explanation", "model_name",
            "model_version", "computed_at",
        ),
        ("location_id", "prediction_date", "prediction_time"),
        version=("computed_at",),
        partition_by=("prediction_date",),
        time_column="prediction_time",
        ttl_seconds=1825 * DAY,
    ),
    "latest_ml_predictions_by_location": TableSpec(
        (
            "location_id", "prediction_time", "forecast_horizon_minutes", "risk_score", "risk_level",
            "predicted_event_type", "class_probabilities", "explanation", "model_name", "model_version",
            "computed_at",
        ),
        ("location_id",),
        version=("prediction_time", "computed_at"),
    ),
    "parameter_rules_by_parameter": TableSpec(
        (
            "parameter", "display_name", "unit", "normal_low", "normal_high", "critical_low", "critical_high",
            "threshold_scale", "rate_change_scale", "enabled",
        ),
        ("parameter",),
    ),
    "sensor_clusters": TableSpec(("cluster_id",), ("cluster_id",)),
    "sensor_configs_by_cluster": TableSpec(
        (
            "cluster_id", "sensor_id", "min_value", "max_value", "sensor_type", "unit", "measure_interval_s",
            "config_interval_s", "updated_at",
        ),
        ("cluster_id", "sensor_id"),
        version=("updated_at",),
    ),
}
