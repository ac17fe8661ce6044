"""Sensor and cluster identifiers."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# Accepted sensor references.
SENSOR_REFERENCE = r"^C\dS\d{3}$"
SENSOR_PARTS = r"^(C\d)(S\d{3})$"


def global_sensor_id(cluster: Column, local: Column) -> Column:
    return F.concat(cluster, local)


def is_sensor_reference(ref: Column) -> Column:
    return ref.rlike(SENSOR_REFERENCE)


def reference_part(ref: Column, part: int) -> Column:
    """Cluster (1) or local sensor (2) of a reference; null when the reference is malformed."""
    return F.nullif(F.regexp_extract(ref, SENSOR_PARTS, part), F.lit(""))


def prefixed_id(raw: Column, prefix: str) -> Column:
    tidy = F.upper(F.trim(raw))
    return F.when(tidy.startswith(prefix), tidy).otherwise(F.concat(F.lit(prefix), tidy))


def blank_to_null(text: Column) -> Column:
    return F.nullif(F.trim(text), F.lit(""))


def snake_key(text: Column) -> Column:
    return F.upper(F.regexp_replace(text, "[^A-Za-z0-9]+", "_"))
