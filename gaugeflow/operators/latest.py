"""Latest row per key, key de-duplication and retention."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from gaugeflow.functions.times import given_or_now
from gaugeflow.schemas import TABLES


def latest_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[str | Column]) -> DataFrame:
    """Row with the greatest ``order`` per key.

    An aggregate, not a window: each task reduces a hot key to one row before the shuffle, and the
    same plan works on a stream in update mode. ``order`` should be unique per key.
    """
    others = [c for c in df.columns if c not in set(keys)]
    newest = F.max_by(F.struct(*others), F.struct(*order))
    return df.groupBy(*keys).agg(newest.alias("_row")).select(*keys, "_row.*").select(*df.columns)


def dedup_readings(readings: DataFrame, arrival: Sequence[str | Column]) -> DataFrame:
    """The last arrival wins when a sensor repeats an event time."""
    return latest_per_key(readings, ["sensor_id", "event_time"], arrival)


def retain(df: DataFrame, time_column: str, ttl_seconds: int, as_of=None) -> DataFrame:
    """Rows not yet expired; a plain range filter, so it reaches the scan."""
    cutoff = given_or_now(as_of) - F.make_dt_interval(secs=F.lit(ttl_seconds))
    return df.filter(F.col(time_column) > cutoff)


def _latest_for_table(rows: DataFrame, table: str, tie: Sequence[str]) -> DataFrame:
    """Only the table's columns are carried through the sort and shuffle of the aggregate."""
    spec = TABLES[table]
    narrow = rows.select(*spec.columns, *[c for c in tie if c not in spec.columns])
    return latest_per_key(narrow, spec.keys, ["event_time", *tie]).select(*spec.columns)


def latest_readings(enriched: DataFrame, tie: Sequence[str] = ()) -> DataFrame:
    rows = enriched.withColumn("updated_at", F.col("ingestion_time"))
    return _latest_for_table(rows, "latest_readings_by_cluster", tie)


def latest_scores(scored: DataFrame, tie: Sequence[str] = ()) -> DataFrame:
    rows = scored.withColumn("updated_at", F.col("computed_at"))
    return _latest_for_table(rows, "latest_ai_scores_by_cluster", tie)
