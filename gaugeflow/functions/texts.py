"""Notification texts as columns."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from gaugeflow.constants import CHAT_TITLE, MAIL_TITLE, UNKNOWN


def text_of(name: str, default: str = UNKNOWN) -> Column:
    """Column as text; null and blank give the default."""
    return F.coalesce(F.nullif(F.col(name).cast("string"), F.lit("")), F.lit(default))


def number_text(name: str) -> Column:
    """A double as digits with at least one decimal, up to 1e16 without an exponent; null gives the default."""
    number = F.col(name)
    whole = F.concat(F.format_string("%.0f", number), F.lit(".0"))
    plain = F.abs(number).between(1e7, 9.99e15) & (number == F.round(number, 0))
    return F.when(plain, whole).otherwise(text_of(name))


def _with_unit(text: Column) -> Column:
    unit = text_of("unit", "")
    return F.when(unit == "", text).otherwise(F.concat_ws(" ", text, unit))


def mail_reading() -> Column:
    return _with_unit(number_text("value"))


def chat_reading() -> Column:
    return F.concat(text_of("parameter"), F.lit(": "), _with_unit(number_text("value")))


def place() -> Column:
    local = text_of("local_sensor_id", "")
    return F.when(local.isin("", UNKNOWN), text_of("cluster_id")).otherwise(
        F.concat_ws(" / ", text_of("cluster_id"), local)
    )


def _bounds(both: tuple[str, str], low_only: str, high_only: str, neither: str) -> Column:
    low, high = F.col("threshold_low").cast("string"), F.col("threshold_high").cast("string")
    return (
        F.when(low.isNotNull() & high.isNotNull(), F.concat(F.lit(both[0]), low, F.lit(both[1]), high))
        .when(low.isNotNull(), F.concat(F.lit(low_only), low))
        .when(high.isNotNull(), F.concat(F.lit(high_only), high))
        .otherwise(F.lit(neither))
    )


def mail_threshold() -> Column:
    return _bounds(("expected range: ", " - "), "minimum allowed: ", "maximum allowed: ", "threshold not provided")


def chat_threshold() -> Column:
    text = _bounds(("", " to "), "at least ", "at most ", UNKNOWN)
    return F.when(text == UNKNOWN, text).otherwise(_with_unit(text))


def mail_subject() -> Column:
    return F.concat(F.lit(f"{MAIL_TITLE}: "), text_of("alert_type"), F.lit(" in cluster "), text_of("cluster_id"))


def mail_body() -> Column:
    labelled = [
        ("Alert type", text_of("alert_type")),
        ("Severity", text_of("severity")),
        ("Sensor", text_of("sensor_id")),
        ("Cluster", place()),
        ("Parameter", text_of("parameter")),
        ("Reading", mail_reading()),
        ("Threshold", mail_threshold()),
        ("Event time", text_of("event_time")),
        ("Processed at", text_of("processed_at")),
    ]
    lines = [F.concat(F.lit(f"{label}: "), text) for label, text in labelled]
    return F.concat_ws("\n", F.lit(MAIL_TITLE), F.lit(""), *lines, F.lit(""), text_of("message", ""))


def escape_html(text: Column) -> Column:
    for plain, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")):
        text = F.replace(text, F.lit(plain), F.lit(entity))
    return text


def _tag(tag: str, text: Column) -> Column:
    return F.concat(F.lit(f"<{tag}>"), escape_html(text), F.lit(f"</{tag}>"))


def _field(label: str, text: Column) -> Column:
    return F.concat(F.lit(f"{label}: "), _tag("code", text))


def chat_message() -> Column:
    blocks = [
        [F.lit(f"<b>{CHAT_TITLE}</b>")],
        [_tag("blockquote", text_of("message"))],
        [
            F.lit("<b>Summary</b>"),
            _field("Severity", text_of("severity")),
            _field("Alert type", text_of("alert_type")),
            _field("Reading", chat_reading()),
            _field("Expected range", chat_threshold()),
        ],
        [F.lit("<b>Cluster</b>"), escape_html(place()), _field("Sensor", text_of("sensor_id"))],
        [
            F.lit("<b>Timing</b>"),
            _field("Event time", text_of("event_time")),
            _field("Processed at", text_of("processed_at")),
        ],
    ]
    return F.concat_ws("\n\n", *[F.concat_ws("\n", *block) for block in blocks])
