"""Timestamp parsing, formatting and calendar buckets (session zone UTC)."""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column, functions as F

from gaugeflow.constants import MICROS_PATTERN, MILLIS_PATTERN, SECONDS_PATTERN


def parse_event_time(text: Column) -> Column:
    """First reading of ``text`` that succeeds; null when none does, never an ANSI error."""
    explicit = [F.try_to_timestamp(text, F.lit(p)) for p in (MICROS_PATTERN, MILLIS_PATTERN, SECONDS_PATTERN)]
    return F.coalesce(F.try_to_timestamp(text), *explicit)


def iso_millis(moment: Column) -> Column:
    return F.date_format(moment, MILLIS_PATTERN)


def iso_micros(moment: Column) -> Column:
    return F.date_format(moment, MICROS_PATTERN)


def month_bucket(moment: Column) -> Column:
    return F.date_format(moment, "yyyy-MM")


def latency_ms(done: Column, happened: Column) -> Column:
    """Whole-second latency expressed in milliseconds."""
    return ((F.unix_seconds(done) - F.unix_seconds(happened)) * 1000).cast("double")


def interval(text: str) -> Column:
    return F.expr(f"INTERVAL {text}")


def interval_micros(text: str) -> int:
    """Length of a fixed interval such as ``5 minutes`` in microseconds."""
    units = {"microsecond": 1, "millisecond": 10**3, "second": 10**6, "minute": 60 * 10**6}
    units |= {"hour": 3600 * 10**6, "day": 86_400 * 10**6}
    number, unit = text.split()
    return int(number) * units[unit.rstrip("s")]


def order_key(moment: str, tie: Column | None = None) -> Column:
    """Event order as one number: by moment, then by a whole-number tie (null first).

    A struct would do the same, but a decimal is fixed-width, so an aggregate that carries it stays a hash aggregate. Two
    moments lie further apart than any two ties: 2 * 10**19 is more than the span of a long.
    """
    micros = F.unix_micros(moment)
    if tie is None:
        return micros
    last = F.coalesce(tie.cast("long"), F.lit(-(2**63)))
    return micros.cast("decimal(18,0)") * F.lit(Decimal(2 * 10**19)).cast("decimal(20,0)") + last.cast("decimal(19,0)")


def given_or_now(moment) -> Column:
    """An explicit moment (column, literal or ISO text), or the batch's wall clock."""
    if moment is None:
        return F.current_timestamp()
    return moment if isinstance(moment, Column) else F.lit(moment).cast("timestamp")
