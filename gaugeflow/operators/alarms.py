"""Alarms: alerts grouped by sensor and alert type, and the overall status."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from gaugeflow.constants import RECENT_INTERVAL
from gaugeflow.functions.times import given_or_now, interval
from gaugeflow.operators.aggregates import steady_round


def is_recent(moment: Column, as_of=None, quiet: str = RECENT_INTERVAL) -> Column:
    return moment >= given_or_now(as_of) - interval(quiet)


def group_alarms(alerts: DataFrame, as_of=None, quiet: str = RECENT_INTERVAL) -> DataFrame:
    """One row per (sensor, alert type) over all given alerts; critical severity sticks."""
    newest = F.max_by(F.struct("parameter", "value", "message", "explanation"), F.struct("event_time", "alert_id"))
    grouped = alerts.groupBy("sensor_id", "alert_type").agg(
        F.min("event_time").alias("first_seen"),
        F.max("event_time").alias("last_seen"),
        F.count("*").alias("alert_count"),
        F.bool_or(F.col("severity") == "CRITICAL").alias("any_critical"),
        F.max_by("severity", F.struct("event_time", "alert_id")).alias("newest_severity"),
        newest.alias("newest"),
    )
    return grouped.select(
        "sensor_id",
        "newest.parameter",
        "alert_type",
        F.when(F.col("any_critical"), "CRITICAL").otherwise(F.col("newest_severity")).alias("severity"),
        F.when(is_recent(F.col("last_seen"), as_of, quiet), "ACTIVE").otherwise("RESOLVED").alias("state"),
        "first_seen",
        "last_seen",
        "alert_count",
        F.col("newest.value").alias("latest_value"),
        "newest.message",
        "newest.explanation",
    )


def system_status(
    alerts: DataFrame, latest_scores: DataFrame, as_of=None, quiet: str = RECENT_INTERVAL
) -> DataFrame:
    """One row: CRITICAL, WARNING or NORMAL. Both inputs fold into one global aggregate."""
    recent = alerts.filter(is_recent(F.col("event_time"), as_of, quiet))
    signals = recent.select(
        (F.col("severity") == "CRITICAL").alias("critical"), F.lit(True).alias("warning"), F.lit(1).alias("alert")
    ).unionByName(
        latest_scores.select(
            (F.col("anomaly_level") == "CRITICAL").alias("critical"),
            F.col("anomaly_level").isin("WATCH", "WARNING").alias("warning"),
            F.lit(0).alias("alert"),
        )
    )
    return signals.agg(
        F.coalesce(F.bool_or("critical"), F.lit(False)).alias("critical"),
        F.coalesce(F.bool_or("warning"), F.lit(False)).alias("warning"),
        F.coalesce(F.sum("alert"), F.lit(0)).alias("active_alert_count"),
    ).select(
        F.when(F.col("critical"), "CRITICAL").when(F.col("warning"), "WARNING").otherwise("NORMAL").alias("system_status"),
        "active_alert_count",
    )


def overview_counts(
    sensors: DataFrame,
    alerts: DataFrame,
    latest: DataFrame,
    as_of=None,
    quiet: str = RECENT_INTERVAL,
    averaged: Sequence[str] = ("pH", "temperature"),
) -> DataFrame:
    """One row: registered sensors, recent alerts, and the mean of the ``averaged`` parameters."""
    absent = F.lit(None)
    recent = alerts.filter(is_recent(F.col("event_time"), as_of, quiet))
    facts = (
        sensors.select(F.lit("sensor").alias("kind"), absent.cast("string").alias("parameter"), absent.cast("double").alias("value"))
        .unionByName(recent.select(F.lit("alert").alias("kind"), "parameter", "value"))
        .unionByName(latest.select(F.lit("reading").alias("kind"), "parameter", "value"))
    )

    def mean_of(parameter: str) -> Column:
        return steady_round(F.avg(F.when((F.col("kind") == "reading") & (F.col("parameter") == parameter), F.col("value"))), 3)

    return facts.agg(
        F.count_if(F.col("kind") == "sensor").alias("active_sensor_count"),
        F.count_if(F.col("kind") == "alert").alias("active_alert_count"),
        *[mean_of(p).alias(f"average_{p.lower()}") for p in averaged],
    )


def named_average(latest: DataFrame, parameter: str) -> DataFrame:
    return latest.filter(F.col("parameter") == parameter).agg(steady_round(F.avg("value"), 3).alias("average_value"))
