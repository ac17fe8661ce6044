"""Explainable anomaly scores."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.window import WindowSpec

from gaugeflow.constants import (
    COMPONENT_TRIGGER,
    DEFAULT_RATE_SCALE,
    DEFAULT_THRESHOLD_SCALE,
    SCORE_BANDS,
    SCORE_FLOORS,
    SCORE_SENTENCES,
    SCORE_WEIGHTS,
    Z_ONSET,
    Z_SPAN,
)
from gaugeflow.functions.rules import capped_share, critical_breach, excess_distance
from gaugeflow.functions.times import given_or_now
from gaugeflow.operators.series import over_recent_rows, suggest_chunk, time_chunk


def rolling_statistics(
    readings: DataFrame,
    window_rows: int = 5,
    include_current: bool = True,
    order: Sequence[str] = ("event_time",),
    chunk: str | None = None,
) -> DataFrame:
    """Rolling mean and deviation over the last rows of each sensor, and the previous value.

    Without a ``chunk`` its length comes from the rows of the most crowded sensor.
    """
    chunk = chunk or suggest_chunk(readings, ["sensor_id"], "event_time")
    first, last = (1 - window_rows, 0) if include_current else (-window_rows, -1)

    def add(df: DataFrame, series: WindowSpec) -> DataFrame:
        recent = series.rowsBetween(first, last)
        return df.withColumns(
            {
                "rolling_average": F.avg("value").over(recent),
                "rolling_stddev": F.coalesce(F.stddev_samp("value").over(recent), F.lit(0.0)),
                "previous_value": F.lag("value").over(series),
            }
        )

    return over_recent_rows(readings, ["sensor_id"], order, max(-first, 1), time_chunk("event_time", chunk), add)


def _level(score: Column) -> Column:
    level = None
    for bound, name in SCORE_BANDS:
        level = F.when(score >= bound, name) if level is None else level.when(score >= bound, name)
    return level.otherwise("NORMAL")


def score_components(rolled: DataFrame, computed_at=None) -> DataFrame:
    """Scores from rolling columns: row-wise, so it serves batch and stream alike.

    Scoring looks at the rule bounds whether or not the rule is enabled.
    """
    value, deviation = F.col("value"), F.col("rolling_stddev")
    distance_scale = F.coalesce(F.col("threshold_scale"), F.lit(DEFAULT_THRESHOLD_SCALE))
    rate_scale = F.coalesce(F.col("rate_change_scale"), F.lit(DEFAULT_RATE_SCALE))

    measured = rolled.withColumns(
        {
            "rate_of_change": F.coalesce(F.abs(value - F.col("previous_value")), F.lit(0.0)),
            "threshold_distance": excess_distance(),
            "z_score": F.when(deviation > 0, F.abs((value - F.col("rolling_average")) / deviation)).otherwise(0.0),
            "critical_rule_component": critical_breach().cast("double"),
        }
    )
    unusual = F.greatest(F.lit(0.0), (F.col("z_score") - Z_ONSET) / Z_SPAN)
    graded = measured.withColumns(
        {
            "threshold_component": capped_share(F.col("threshold_distance"), distance_scale),
            "statistical_component": F.least(F.lit(1.0), unusual),
            "rate_component": capped_share(F.col("rate_of_change"), rate_scale),
        }
    )
    part = {name: F.col(f"{name}_component") for name in SCORE_WEIGHTS}
    fired = {
        "critical": F.col("critical_rule_component") > 0,
        "threshold": part["threshold"] > 0,
        "statistical": part["statistical"] > COMPONENT_TRIGGER,
        "rate": part["rate"] > COMPONENT_TRIGGER,
    }
    weighted = sum((part[name] * weight for name, weight in SCORE_WEIGHTS.items()), F.lit(0.0))
    floors = [F.when(fired[name], floor).otherwise(0.0) for name, floor in SCORE_FLOORS.items()]
    reason = (
        F.when(fired["critical"], SCORE_SENTENCES["critical"])
        .when(fired["threshold"] & fired["statistical"], SCORE_SENTENCES["threshold_statistical"])
        .when(fired["threshold"], SCORE_SENTENCES["threshold"])
        .when(fired["statistical"], SCORE_SENTENCES["statistical"])
        .when(fired["rate"], SCORE_SENTENCES["rate"])
        .otherwise(SCORE_SENTENCES["default"])
    )
    scored = graded.withColumn("raw_anomaly_score", weighted)
    scored = scored.withColumn("anomaly_score", F.round(F.greatest("raw_anomaly_score", *floors), 4))
    return scored.withColumns(
        {
            "anomaly_level": _level(F.col("anomaly_score")),
            "explanation": reason,
            "computed_at": given_or_now(computed_at),
        }
    )


def score_anomalies(readings: DataFrame, computed_at=None, **rolling) -> DataFrame:
    return score_components(rolling_statistics(readings, **rolling), computed_at)
