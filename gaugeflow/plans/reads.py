"""The dashboard's read queries as DataFrame functions.

Filters on day, cluster and sensor are plain predicates on partition or data columns, so they prune
partitions and row groups; every page is an ``ORDER BY .. LIMIT``, planned as a distributed top-k.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from gaugeflow.constants import MAX_PAGE, RECENT_INTERVAL
from gaugeflow.functions.risk import parse_probabilities
from gaugeflow.functions.times import given_or_now
from gaugeflow.operators import alarms as alarm_ops
from gaugeflow.operators.aggregates import latest_minute_rollup, minute_rollup, parameter_averages
from gaugeflow.operators.configs import first_sensor, sensor_listing

RECENT_ALERTS_SHOWN = 20


def page_size(wanted: int, maximum: int | None = MAX_PAGE) -> int:
    """``wanted``, at least 1; asking for more than ``maximum`` (None: no bound) is an error, never a silent cut."""
    if maximum is not None and wanted > maximum:
        raise ValueError(f"a page holds at most {maximum} rows, not {wanted}; pass a larger maximum")
    return max(1, wanted)


def tidy(text: str | None) -> str | None:
    """Blank arguments count as not given."""
    return (text or "").strip() or None


def on_day(df: DataFrame, column: str, day: str | None = None, as_of=None) -> DataFrame:
    wanted = F.lit(day).cast("date") if tidy(day) else F.to_date(given_or_now(as_of))
    return df.filter(F.col(column) == wanted)


def matching(df: DataFrame, **wanted: str | None) -> DataFrame:
    for column, value in wanted.items():
        if tidy(value):
            df = df.filter(F.col(column) == tidy(value))
    return df


def newest_page(df: DataFrame, limit: int, *order: str, maximum: int | None = MAX_PAGE) -> DataFrame:
    """The newest rows, shown oldest first."""
    newest = df.orderBy(*[F.col(c).desc() for c in order]).limit(page_size(limit, maximum))
    return newest.orderBy(*order)


def of_sensor(df: DataFrame, configs: DataFrame, sensor_id: str | None, cluster_id: str | None) -> DataFrame:
    if tidy(sensor_id):
        return matching(df, sensor_id=sensor_id)
    return df.join(first_sensor(matching(configs, cluster_id=cluster_id)), "sensor_id", "left_semi")


def list_sensors(configs: DataFrame, cluster_id: str | None = None) -> DataFrame:
    return sensor_listing(matching(configs, cluster_id=cluster_id))


def list_latest(latest: DataFrame, cluster_id: str | None = None) -> DataFrame:
    """Latest rows of one cluster or of all, newest first; rows without a time come last."""
    chosen = matching(latest, cluster_id=cluster_id)
    times = [F.col(c) for c in ("event_time", "minute_start") if c in latest.columns]
    return chosen.orderBy(F.coalesce(*times).desc_nulls_last(), *[c for c in ("cluster_id", "sensor_id") if c in latest.columns])


def readings_page(
    readings: DataFrame, configs: DataFrame, sensor_id=None, cluster_id=None, day=None, limit=200, as_of=None, maximum=MAX_PAGE
) -> DataFrame:
    """Newest readings of a sensor-day, oldest first; without a sensor, of the first registered one."""
    chosen = of_sensor(on_day(readings, "bucket_date", day, as_of), configs, sensor_id, cluster_id)
    return newest_page(chosen, limit, "event_time", maximum=maximum)


def alerts_page(
    alerts: DataFrame, cluster_id=None, day=None, severity=None, sensor_id=None, limit: int | None = 200, as_of=None,
    maximum: int | None = MAX_PAGE,
) -> DataFrame:
    """Filter, then take the newest; ``limit=None`` keeps all."""
    chosen = matching(
        on_day(alerts, "bucket_date", day, as_of), cluster_id=cluster_id, sensor_id=sensor_id, severity=severity
    )
    ordered = chosen.orderBy(F.col("event_time").desc(), "sensor_id", "alert_id")
    return ordered if limit is None else ordered.limit(page_size(limit, maximum))


def recent_alerts(
    alerts: DataFrame, as_of=None, limit: int = RECENT_ALERTS_SHOWN, quiet: str = RECENT_INTERVAL
) -> DataFrame:
    recent = alerts.filter(alarm_ops.is_recent(F.col("event_time"), as_of, quiet))
    return recent.orderBy(F.col("event_time").desc(), "sensor_id", "alert_id").limit(limit)


def alarms(
    alerts: DataFrame, cluster_id=None, day=None, sensor_id=None, severity=None, limit: int | None = None, as_of=None,
    maximum: int | None = MAX_PAGE,
) -> DataFrame:
    """Alarms of a day. All its alerts count unless ``limit`` asks for the newest only."""
    chosen = matching(
        on_day(alerts, "bucket_date", day, as_of), cluster_id=cluster_id, sensor_id=sensor_id, severity=severity
    )
    if limit is not None:
        chosen = chosen.orderBy(F.col("event_time").desc(), "sensor_id", "alert_id").limit(page_size(limit, maximum))
    return alarm_ops.group_alarms(chosen, as_of)


def insights_page(
    scores: DataFrame, configs: DataFrame, sensor_id=None, cluster_id=None, day=None, anomaly_level=None,
    limit=120, limit_first: bool = True, as_of=None, maximum: int | None = MAX_PAGE,
) -> DataFrame:
    """Scores of a sensor-day. The level filter comes after the limit unless ``limit_first=False``."""
    chosen = of_sensor(on_day(scores, "bucket_date", day, as_of), configs, sensor_id, cluster_id)
    level = (tidy(anomaly_level) or "").upper()
    if limit_first:
        return matching(newest_page(chosen, limit, "event_time", maximum=maximum), anomaly_level=level).orderBy("event_time")
    return newest_page(matching(chosen, anomaly_level=level), limit, "event_time", maximum=maximum)


def latest_prediction(latest: DataFrame, location_id=None) -> DataFrame:
    """Newest prediction of a location, or of all locations."""
    chosen = matching(latest, location_id=location_id)
    newest = chosen.orderBy(F.coalesce("computed_at", "prediction_time").desc(), "location_id").limit(1)
    return newest.withColumn("class_probabilities", parse_probabilities(F.col("class_probabilities")))


def predictions_page(predictions: DataFrame, location_id=None, day=None, limit=160, as_of=None, maximum=MAX_PAGE) -> DataFrame:
    """Newest predictions, oldest first. Across locations, the overall top-n needs no per-location step."""
    chosen = matching(on_day(predictions, "prediction_date", day, as_of), location_id=location_id)
    page = newest_page(chosen, limit, "prediction_time", "location_id", maximum=maximum)
    return page.withColumn("class_probabilities", parse_probabilities(F.col("class_probabilities")))


def performance_page(metrics: DataFrame, cluster_id=None, day=None, limit=120, as_of=None, maximum=MAX_PAGE) -> DataFrame:
    """Pipeline metrics of a day: one cluster as stored, or all clusters rolled up per minute."""
    chosen = matching(on_day(metrics, "metric_date", day, as_of), cluster_id=cluster_id)
    return newest_page(chosen if tidy(cluster_id) else minute_rollup(chosen), limit, "minute_start", maximum=maximum)


def overview(
    configs: DataFrame, latest: DataFrame, latest_scores: DataFrame, alerts: DataFrame, metrics: DataFrame,
    rules: DataFrame, latest_predictions: DataFrame, as_of=None, quiet: str = RECENT_INTERVAL,
    averaged: Sequence[str] = ("pH", "temperature"),
) -> dict[str, DataFrame]:
    """The parts of the overview page, each its own lazy plan."""
    today = on_day(alerts, "bucket_date", None, as_of)
    return {
        "status": alarm_ops.system_status(today, latest_scores, as_of, quiet),
        "counts": alarm_ops.overview_counts(configs, today, latest, as_of, quiet, averaged),
        "parameter_averages": parameter_averages(latest, rules),
        "latest_metric": latest_minute_rollup(on_day(metrics, "metric_date", None, as_of)),
        "latest_readings": list_latest(latest),
        "latest_ai": list_latest(latest_scores),
        "latest_ml_prediction": latest_prediction(latest_predictions),
        "recent_alerts": recent_alerts(today, as_of, quiet=quiet),
    }
