"""From JSON messages to valid readings, and the reverse."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from gaugeflow.functions.times import given_or_now, iso_micros, parse_event_time
from gaugeflow.schemas import ALERT_MESSAGE, READING_MESSAGE

REQUIRED = ("sensor_id", "sensor_type", "value", "timestamp", "event_time")


def stamp_messages(measurements: DataFrame, arrival=None) -> DataFrame:
    """Ingest side: add the arrival time, key by sensor, encode as JSON."""
    body = F.struct("sensor_id", "sensor_type", "value", iso_micros(given_or_now(arrival)).alias("timestamp"))
    return measurements.select(F.col("sensor_id").alias("key"), F.to_json(body).alias("value"))


def computed_once(struct: Column) -> Column:
    """The struct's fields as columns, with the struct evaluated once per row.

    A filter on columns of a plain projection is pushed below it together with the expressions, so
    each tested field would parse the JSON again. It cannot be pushed through a generator.
    """
    return F.inline(F.array(struct))


def parse_messages(raw: DataFrame, payload: str = "value", keep: tuple[str, ...] = ()) -> DataFrame:
    """Broken JSON becomes a row of nulls; a field of the wrong type becomes null on its own."""
    message = F.from_json(F.col(payload).cast("string"), READING_MESSAGE)
    parsed = raw.select(*keep, computed_once(message))
    moment = F.struct(parse_event_time(F.col("timestamp")).alias("event_time"))
    return parsed.select("*", computed_once(moment))


def is_valid() -> Column:
    """All required fields present; a NaN value counts as absent."""
    present = ~F.isnan("value")
    for name in REQUIRED:
        present = present & F.col(name).isNotNull()
    return F.coalesce(present, F.lit(False))


def valid_readings(parsed: DataFrame) -> DataFrame:
    return parsed.filter(is_valid())


def split_valid(parsed: DataFrame) -> tuple[DataFrame, DataFrame]:
    return parsed.filter(is_valid()), parsed.filter(~is_valid())


def decode_alerts(raw: DataFrame, payload: str = "value") -> DataFrame:
    """Alert consumer side: undecodable messages are skipped."""
    text = F.try_validate_utf8(F.col(payload).cast("string"))
    decoded = raw.select(computed_once(F.from_json(text, ALERT_MESSAGE)))
    return decoded.filter(F.coalesce(*[F.col(f.name).cast("string") for f in ALERT_MESSAGE]).isNotNull())
