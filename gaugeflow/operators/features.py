"""Risk-model features per location and time window."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from gaugeflow.constants import FEATURE_WINDOW, PARAMETERS
from gaugeflow.functions.rules import capped_distance, value_state
from gaugeflow.functions.times import given_or_now, interval, interval_micros, order_key
from gaugeflow.operators.series import over_span, suggest_chunk

RULE_BOUNDS = ("normal_low", "normal_high", "critical_low", "critical_high", "threshold_scale")
MEASURES = ("latest", "mean", "std", "slope", "threshold_distance")


def feature_name(parameter: str, measure: str, suffix: str) -> str:
    timed = measure in ("mean", "std", "slope")
    return f"{parameter.lower()}_{measure}" + (f"_{suffix}" if timed else "")


def feature_columns(parameters: Sequence[str] = PARAMETERS, suffix: str = "5m") -> list[str]:
    per_parameter = [feature_name(p, m, suffix) for p in parameters for m in MEASURES]
    return [
        *per_parameter,
        f"warning_count_{suffix}",
        f"critical_count_{suffix}",
        "max_threshold_distance",
        "avg_threshold_distance",
    ]


def per_minute(rise: Column, elapsed_micros: Column) -> Column:
    return F.when(elapsed_micros > 0, rise / (elapsed_micros / 60e6)).otherwise(0.0)


def parameter_measures(readings: DataFrame, by: Sequence[str | Column], tie: str | None = None) -> DataFrame:
    """One row per group and parameter, combined map-side.

    A unique whole-number ``tie`` column settles readings of the same moment. The buffers are fixed-width either way.
    """
    order = order_key("event_time", F.col(tie) if tie else None)
    newest = [F.max_by(name, order).alias(name) for name in RULE_BOUNDS]
    summary = readings.groupBy(*by, "parameter").agg(
        F.count("*").alias("n"),
        F.max_by("value", order).alias("latest"),
        F.min_by("value", order).alias("earliest"),
        F.avg("value").alias("mean"),
        F.coalesce(F.stddev_samp("value"), F.lit(0.0)).alias("std"),
        (F.unix_micros(F.max("event_time")) - F.unix_micros(F.min("event_time"))).alias("elapsed"),
        *newest,
    )
    return summary.withColumn("slope", per_minute(F.col("latest") - F.col("earliest"), F.col("elapsed")))


def widen(
    measures: DataFrame, by: Sequence[str], parameters: Sequence[str], min_readings: int, suffix: str
) -> DataFrame:
    """Measures of all parameters side by side; groups missing a parameter are left out.

    The counts are of parameters whose latest value is in that state, not of readings.
    """
    judged = measures.withColumns({"threshold_distance": capped_distance("latest"), "state": value_state("latest")})
    judged = judged.filter(F.col("parameter").isin(*parameters) & (F.col("n") >= min_readings))
    cells = [
        F.coalesce(F.max(F.when(F.col("parameter") == p, F.col(m))), F.lit(0.0)).alias(feature_name(p, m, suffix))
        for p in parameters
        for m in MEASURES
    ]
    wide = judged.groupBy(*by).agg(
        *cells,
        F.count_if(F.col("state") == "warning").cast("double").alias(f"warning_count_{suffix}"),
        F.count_if(F.col("state") == "critical").cast("double").alias(f"critical_count_{suffix}"),
        F.max("threshold_distance").alias("max_threshold_distance"),
        F.avg("threshold_distance").alias("avg_threshold_distance"),
        F.count("*").alias("complete"),
    )
    return wide.filter(F.col("complete") == len(parameters)).drop("complete")


def window_features(
    readings: DataFrame,
    parameters: Sequence[str] = PARAMETERS,
    window: str = FEATURE_WINDOW,
    slide: str | None = None,
    min_readings: int = 2,
    location: str = "cluster_id",
    suffix: str = "5m",
    tie: str | None = None,
) -> DataFrame:
    """Feature row per location and window; ``slide`` shorter than ``window`` gives overlapping ones.

    Works unchanged on a stream with a watermark: both aggregates then run in append mode.
    """
    usable = readings.filter("rule_enabled").filter(F.col("parameter").isin(*parameters))
    span = F.window("event_time", window, slide or window).alias("span")
    measures = parameter_measures(usable, [F.col(location).alias("location_id"), span], tie)
    wide = widen(measures, ["location_id", "span"], parameters, min_readings, suffix)
    return wide.withColumn("prediction_time", F.col("span.end")).drop("span")


def features_at(
    readings: DataFrame,
    prediction_time,
    parameters: Sequence[str] = PARAMETERS,
    window: str = FEATURE_WINDOW,
    min_readings: int = 2,
    location: str = "cluster_id",
    suffix: str = "5m",
    tie: str | None = None,
) -> DataFrame:
    """Feature rows for one moment; the window holds both its ends."""
    moment = given_or_now(prediction_time)
    usable = readings.filter("rule_enabled").filter(F.col("parameter").isin(*parameters))
    usable = usable.filter(F.col("event_time").between(moment - interval(window), moment))
    measures = parameter_measures(usable, [F.col(location).alias("location_id")], tie)
    return widen(measures, ["location_id"], parameters, min_readings, suffix).withColumn("prediction_time", moment)


def active_locations(readings: DataFrame, as_of, window: str = FEATURE_WINDOW, location: str = "cluster_id") -> DataFrame:
    moment = given_or_now(as_of)
    recent = readings.filter(F.col("event_time").between(moment - interval(window), moment))
    return recent.select(F.col(location).alias("location_id")).distinct().orderBy("location_id")


def trailing_measures(
    readings: DataFrame, window: str = FEATURE_WINDOW, location: str = "cluster_id", tie: str | None = None, chunk: str | None = None
) -> DataFrame:
    """Per reading: count, mean, deviation and slope over the window ending at it, both ends included.

    Running sums inside each chunk of a series: a reading's window is the sum at its moment less the sum just before
    the window opens, so every reading adds a mark there, sorted among the readings. All steps of a chunk share
    one shuffle and stream through sorted rows. ``tie`` orders readings of one moment. Without a ``chunk`` its length comes
    from the rows of the most crowded series, no shorter than the window: long ones copy fewer rows over the seams, short
    ones spread a hot series over more tasks.
    """
    reach, keys = interval_micros(window), [location, "parameter"]
    chunk = chunk or suggest_chunk(readings, keys, "event_time", at_least=reach)
    value, last_key = F.col("value"), [F.col(tie)] if tie else []

    def add(df: DataFrame, groups: list[str]) -> DataFrame:
        series = Window.partitionBy(*groups).orderBy("_position", *last_key)
        changed = F.coalesce((value != F.lag("value").over(series)).cast("int"), F.lit(0))
        rows = df.withColumns({"_offset": value - F.avg("value").over(Window.partitionBy(*groups)), "_changed": changed})
        rows = rows.withColumn("_changes", F.sum("_changed").over(series.rowsBetween(Window.unboundedPreceding, 0)))
        here = F.struct(F.col("_position").alias("at"), F.lit(0).alias("mark"))
        opening = F.struct((F.col("_position") - reach - 1).alias("at"), F.lit(1).alias("mark"))
        spots = F.when(F.col("_chunk") == F.col("_home"), F.array(here, opening)).otherwise(F.array(here))
        spread = rows.withColumn("_spot", F.explode(spots))
        real, mark = F.col("_spot.mark") == 0, F.col("_spot.mark") == 1

        upward = Window.partitionBy(*groups).orderBy("_spot.at").rangeBetween(Window.unboundedPreceding, 0)
        downward = Window.partitionBy(*groups).orderBy(F.col("_spot.at").desc(), F.col("_spot.mark").desc(), *[k.desc() for k in last_key])
        downward = downward.rowsBetween(Window.unboundedPreceding, -1)
        offset = F.when(real, F.col("_offset"))
        reading = F.when(real, F.struct(value.alias("value"), F.col("_position").alias("at"), F.col("_changes").alias("changes")))
        summed = spread.withColumns(
            {
                "_n": F.count(offset).over(upward),
                "_sum": F.coalesce(F.sum(offset).over(upward), F.lit(0.0)),
                "_squares": F.coalesce(F.sum(offset * offset).over(upward), F.lit(0.0)),
                "_first": F.last(reading, ignorenulls=True).over(downward),
            }
        )
        moment = Window.partitionBy(*groups, "_position")  # the readings of a moment and their marks
        marked = {f"_{c}_before": F.max(F.when(mark, F.col(f"_{c}"))).over(moment) for c in ("n", "sum", "squares")}
        newest = F.max_by("value", F.when(real, F.struct(*(last_key or [F.lit(0)])))).over(moment)
        both = summed.withColumns(
            {**marked, "_oldest": F.max(F.when(mark, F.col("_first"))).over(moment), "_newest": newest, "_final": F.max(F.when(real, F.col("_changes"))).over(moment)}
        )
        n, total = F.col("_n") - F.col("_n_before"), F.col("_sum") - F.col("_sum_before")
        spread_out = (F.col("_squares") - F.col("_squares_before") - total * total / n) / F.greatest(n - 1, F.lit(1))
        # a span without a change has no spread, whatever the sums' last bits say
        steady = F.col("_final") == F.col("_oldest.changes")
        centre = value - F.col("_offset")
        measured = both.filter(real).withColumns(
            {
                "n": n,
                "mean": total / n + centre,
                "std": F.when(steady, 0.0).otherwise(F.sqrt(F.greatest(spread_out, F.lit(0.0)))),
                "slope": per_minute(F.col("_newest") - F.col("_oldest.value"), F.col("_position") - F.col("_oldest.at")),
            }
        )
        return measured.select(*df.columns, "n", "mean", "std", "slope")

    return over_span(readings, keys, F.unix_micros("event_time"), reach, 0, interval_micros(chunk), add)
