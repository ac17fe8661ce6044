"""Outbox: notification texts for alerts; sending them is left to a delivery service."""

from __future__ import annotations

from pyspark.sql import DataFrame

from gaugeflow.functions import texts


def render_notifications(wire_alerts: DataFrame) -> DataFrame:
    """Takes alerts in wire form (times as text)."""
    return wire_alerts.select(
        "alert_id",
        "sensor_id",
        "alert_type",
        texts.mail_subject().alias("subject"),
        texts.mail_body().alias("body"),
        texts.chat_message().alias("chat_message"),
        texts.mail_reading().alias("reading_text"),
        texts.place().alias("cluster_text"),
        texts.mail_threshold().alias("threshold_text"),
    )
