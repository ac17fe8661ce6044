"""Threshold logic over a value and its rule columns."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def _holds(condition: Column) -> Column:
    """Three-valued to two-valued: a missing bound or flag never counts as a breach."""
    return F.coalesce(condition, F.lit(False))


def below_normal(value="value") -> Column:
    return _holds(F.col("normal_low") > F.col(value))


def above_normal(value="value") -> Column:
    return _holds(F.col("normal_high") < F.col(value))


def critical_breach(value="value") -> Column:
    """Critical bounds are inclusive, normal bounds are not."""
    return _holds(F.col("critical_low") >= F.col(value)) | _holds(F.col("critical_high") <= F.col(value))


def enabled() -> Column:
    return _holds(F.col("rule_enabled"))


def quality_status(value="value") -> Column:
    return (
        F.when(~enabled(), F.lit("unconfigured"))
        .when(below_normal(value) | above_normal(value), F.lit("alert"))
        .otherwise(F.lit("normal"))
    )


def breach_direction(value="value") -> Column:
    """LOW, HIGH or null; only enabled rules raise a direction."""
    return F.when(enabled() & below_normal(value), F.lit("LOW")).when(enabled() & above_normal(value), F.lit("HIGH"))


def excess_distance(value="value") -> Column:
    return (
        F.when(below_normal(value), F.col("normal_low") - F.col(value))
        .when(above_normal(value), F.col(value) - F.col("normal_high"))
        .otherwise(F.lit(0.0))
    )


def capped_share(amount: Column, scale: Column) -> Column:
    """``min(1, amount / scale)``; a scale that is not positive switches the component off."""
    return F.when(scale > 0, F.least(F.lit(1.0), amount / scale)).otherwise(F.lit(0.0))


def capped_distance(value="value") -> Column:
    """Distance used by the risk features: here a missing or zero scale means 1."""
    scale = F.coalesce(F.nullif(F.col("threshold_scale"), F.lit(0.0)), F.lit(1.0))
    return F.least(F.lit(1.0), excess_distance(value) / scale)


def value_state(value="value") -> Column:
    return (
        F.when(critical_breach(value), F.lit("critical"))
        .when(below_normal(value) | above_normal(value), F.lit("warning"))
        .otherwise(F.lit("normal"))
    )


def clamp(x: Column, low: Column, high: Column) -> Column:
    return F.greatest(low, F.least(high, x))
