"""Event-time aggregates and pipeline metrics.

The window and minute aggregates carry fixed-width buffers, so each runs as a two-phase hash aggregation: a cluster with a
third of all rows shrinks to one row per task and window before the shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from gaugeflow.functions.times import given_or_now, latency_ms, month_bucket, order_key


def steady_round(x: Column, digits: int) -> Column:
    """Rounding that does not depend on the order in which tasks summed the floats."""
    return F.round(F.round(x, 10), digits)


def window_aggregates(readings: DataFrame, length: str, tie: str | None = None) -> DataFrame:
    """Tumbling-window statistics per cluster, parameter and unit.

    ``last_value`` follows event time, not arrival. Readings of two sensors at the very same
    microsecond tie; name a unique whole-number ``tie`` column to settle that.
    """
    order = order_key("event_time", F.col(tie) if tie else None)
    return (
        readings.groupBy("cluster_id", "parameter", "unit", F.window("event_time", length).alias("span"))
        .agg(
            F.count("*").alias("reading_count"),
            F.avg("value").alias("avg_value"),
            F.min("value").alias("min_value"),
            F.max("value").alias("max_value"),
            F.max_by("value", order).alias("last_value"),
        )
        .withColumn("window_start", F.col("span.start"))
        .drop("span")
    )


def hourly_aggregates(readings: DataFrame, updated_at=None, tie: str | None = None) -> DataFrame:
    hours = window_aggregates(readings, "1 hour", tie)
    return hours.withColumns(
        {"bucket_month": month_bucket(F.col("window_start")), "updated_at": given_or_now(updated_at)}
    )


def daily_aggregates(readings: DataFrame, updated_at=None, tie: str | None = None) -> DataFrame:
    days = window_aggregates(readings, "1 day", tie).withColumn("day", F.to_date("window_start"))
    return days.withColumns({"bucket_year": F.year("day"), "updated_at": given_or_now(updated_at)}).drop("window_start")


def pipeline_metrics(scored: DataFrame) -> DataFrame:
    """Per cluster and processing minute, over every row of that minute."""
    timed = scored.withColumns(
        {
            "minute_start": F.date_trunc("minute", "computed_at"),
            "latency": latency_ms(F.col("computed_at"), F.col("event_time")),
        }
    )
    return (
        timed.groupBy("cluster_id", "minute_start")
        .agg(
            F.count("*").alias("processed_reading_count"),
            F.count_if(F.col("quality_status") == "alert").alias("alert_count"),
            F.avg("anomaly_score").alias("avg_anomaly_score"),
            F.max("anomaly_score").alias("max_anomaly_score"),
            F.avg("latency").alias("avg_event_latency_ms"),
            F.max("latency").alias("max_event_latency_ms"),
            F.max("computed_at").alias("updated_at"),
        )
        .withColumn("metric_date", F.to_date("minute_start"))
    )


def minute_rollup(metrics: DataFrame) -> DataFrame:
    """All clusters of a minute in one row.

    The published averages are unweighted means of the cluster averages; ``weighted_*`` weighs them
    by readings.
    """

    def weighted(name: str) -> Column:
        weight = F.when(F.col(name).isNotNull(), F.col("processed_reading_count"))
        return F.try_divide(F.sum(F.col(name) * weight), F.sum(weight))

    return (
        metrics.groupBy("minute_start")
        .agg(
            F.coalesce(F.sum("processed_reading_count"), F.lit(0)).alias("processed_reading_count"),
            F.coalesce(F.sum("alert_count"), F.lit(0)).alias("alert_count"),
            steady_round(F.avg("avg_anomaly_score"), 4).alias("avg_anomaly_score"),
            F.max("max_anomaly_score").alias("max_anomaly_score"),
            steady_round(F.avg("avg_event_latency_ms"), 3).alias("avg_event_latency_ms"),
            F.max("max_event_latency_ms").alias("max_event_latency_ms"),
            F.max("updated_at").alias("updated_at"),
            weighted("avg_anomaly_score").alias("weighted_anomaly_score"),
            weighted("avg_event_latency_ms").alias("weighted_event_latency_ms"),
        )
        .withColumn("metric_date", F.to_date("minute_start"))
    )


def latest_minute_rollup(metrics: DataFrame) -> DataFrame:
    return minute_rollup(metrics).orderBy(F.col("minute_start").desc()).limit(1)


def parameter_averages(latest: DataFrame, rules: DataFrame) -> DataFrame:
    """Mean of the latest values per parameter, with the catalogue's name and a unit.

    The unit is that of the parameter's newest reading, else the catalogue's.
    """
    averages = latest.groupBy("parameter").agg(
        steady_round(F.avg("value"), 3).alias("average_value"),
        F.max_by("unit", F.struct("event_time", "sensor_id")).alias("newest_unit"),
    )
    named = averages.join(rules.select("parameter", "display_name", F.col("unit").alias("rule_unit")), "parameter", "left")
    return named.select(
        "parameter",
        F.coalesce("display_name", "parameter").alias("display_name"),
        F.coalesce("newest_unit", "rule_unit").alias("unit"),
        "average_value",
    ).orderBy("display_name", "parameter")
