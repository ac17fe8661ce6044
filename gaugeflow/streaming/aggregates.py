"""Watermarked aggregates: the batch operators on a watermarked stream."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from gaugeflow.constants import FEATURE_WINDOW, PARAMETERS, RECENT_INTERVAL, WATERMARK
from gaugeflow.operators.aggregates import daily_aggregates, hourly_aggregates
from gaugeflow.operators.features import window_features


def stream_hourly(enriched: DataFrame, watermark: str = WATERMARK, updated_at=None, tie: Sequence[str] = ()) -> DataFrame:
    """For update mode. A row is dropped once its window's end lies behind the watermark; ``late.DroppedRows`` counts it."""
    return hourly_aggregates(enriched.withWatermark("event_time", watermark), updated_at, *tie[:1])


def stream_daily(enriched: DataFrame, watermark: str = WATERMARK, updated_at=None, tie: Sequence[str] = ()) -> DataFrame:
    return daily_aggregates(enriched.withWatermark("event_time", watermark), updated_at, *tie[:1])


def stream_dedup(readings: DataFrame, keys: Sequence[str] = ("sensor_id", "event_time"), watermark: str = WATERMARK) -> DataFrame:
    """The first arrival of each key; a repeat is known for as long as the watermark delay, then its key is forgotten."""
    return readings.withWatermark("event_time", watermark).dropDuplicatesWithinWatermark([*keys])


def stream_features(
    enriched: DataFrame,
    parameters: Sequence[str] = PARAMETERS,
    window: str = FEATURE_WINDOW,
    slide: str | None = None,
    watermark: str = WATERMARK,
    **options,
) -> DataFrame:
    """Feature rows per location as each window closes (append mode).

    The history a prediction needs is kept as window aggregates in the checkpointed state store
    and dropped by the watermark: no reading lists, and a restart or replay changes nothing.
    """
    return window_features(enriched.withWatermark("event_time", watermark), parameters, window, slide, **options)


def stream_episodes(alerts: DataFrame, quiet: str = RECENT_INTERVAL, watermark: str = WATERMARK) -> DataFrame:
    """Alarm episodes per (sensor, alert type) as they end: alerts less than ``quiet`` apart (append mode).

    Session windows, so the state of an open episode is one row and a late but timely alert can join two. For a notice
    when an alarm opens see ``stateful.stream_alarms``.
    """
    timed = alerts.withWatermark("event_time", watermark)
    episodes = timed.groupBy("sensor_id", "alert_type", F.session_window("event_time", quiet).alias("span")).agg(
        F.min("event_time").alias("first_seen"),
        F.max("event_time").alias("last_seen"),
        F.count("*").alias("alert_count"),
        F.bool_or(F.col("severity") == "CRITICAL").alias("critical"),
    )
    severity = F.when(F.col("critical"), "CRITICAL").otherwise("WARNING").alias("severity")
    return episodes.select("sensor_id", "alert_type", severity, "first_seen", "last_seen", "alert_count")
