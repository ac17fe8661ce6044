"""Alert events from enriched readings."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from gaugeflow.functions.ids import snake_key
from gaugeflow.functions.rules import breach_direction, critical_breach
from gaugeflow.functions.times import given_or_now, iso_millis
from gaugeflow.schemas import ALERT_MESSAGE

# Alert wording by direction.
WORDING = {
    "LOW": (" value is below allowed threshold", " is below the configured lower threshold."),
    "HIGH": (" value is above allowed threshold", " is above the configured upper threshold."),
}


def _worded(place: int):
    ending = F.when(F.col("direction") == "LOW", WORDING["LOW"][place]).otherwise(WORDING["HIGH"][place])
    return F.concat("display_name", ending)


def derive_alerts(enriched: DataFrame, processed_at=None) -> DataFrame:
    """One alert per reading outside its enabled normal range: narrow, no shuffle."""
    breached = enriched.withColumn("direction", breach_direction()).filter("direction IS NOT NULL")
    typed = breached.withColumns(
        {
            "alert_type": F.concat_ws("_", "direction", snake_key(F.col("parameter"))),
            "severity": F.when(critical_breach(), "CRITICAL").otherwise("WARNING"),
            "message": _worded(0),
            "explanation": _worded(1),
            "threshold_low": F.col("normal_low"),
            "threshold_high": F.col("normal_high"),
            "alarm_state": F.lit("ACTIVE"),
            "processed_at": given_or_now(processed_at),
        }
    )
    identity = F.concat_ws("|", "sensor_id", "alert_type", iso_millis(F.col("event_time")), F.col("value").cast("string"))
    return typed.withColumn("alert_id", F.sha2(identity, 256)).drop("direction")


def wire_view(alerts: DataFrame) -> DataFrame:
    """Alert with both times as text, in the order of the outgoing message."""
    return alerts.withColumns(
        {name: iso_millis(F.col(name)) for name in ("event_time", "processed_at")}
    ).select(*ALERT_MESSAGE.names)


def alert_messages(alerts: DataFrame) -> DataFrame:
    """Key and JSON value for the alert topic; null fields are left out of the JSON."""
    return wire_view(alerts).select(
        F.col("sensor_id").alias("key"), F.to_json(F.struct(*ALERT_MESSAGE.names)).alias("value")
    )
