"""Training windows, labels and the split by run."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.window import Window, WindowSpec

from gaugeflow.constants import HORIZON_MINUTES, NORMAL_CLASS, PARAMETERS
from gaugeflow.functions.sizes import broadcast_if_few
from gaugeflow.functions.times import interval_micros
from gaugeflow.operators.features import RULE_BOUNDS, per_minute, widen
from gaugeflow.operators.series import over_recent_rows, over_span, suggest_chunk
from gaugeflow.session import scratch_root

MINUTE = 60_000_000


def horizon_class(scenario: Column, minute: Column, event_start: Column, horizon: int = HORIZON_MINUTES) -> Column:
    """The scenario from ``horizon`` minutes before its event on, normal before that."""
    return F.when(minute >= event_start - horizon, scenario).otherwise(NORMAL_CLASS)


def horizon_labels(
    df: DataFrame,
    keys: Sequence[str],
    position: str,
    state: str,
    horizon: int,
    length: int | None = None,
    levels: Sequence[int] = (0, 1),
) -> DataFrame:
    """``label``: the greatest ``state`` in the ``horizon`` after each row, the row itself excluded.

    ``levels`` lists the values the state takes. For each level the next position that has it comes
    from a running minimum over the reversed series, so a dense series costs no more than a sparse. Without a
    ``length`` the chunks are as long as the rows of the most crowded series allow, but no shorter than the horizon.
    """
    if length is None:
        moment = F.timestamp_micros(F.col(position).cast("long"))
        placed = df.select(*keys, moment.alias("_moment"))
        length = interval_micros(suggest_chunk(placed, keys, "_moment", at_least=horizon))

    def add(rows: DataFrame, groups: list[str]) -> DataFrame:
        ahead = Window.partitionBy(*groups).orderBy(F.col("_position").desc())
        ahead = ahead.rangeBetween(Window.unboundedPreceding, -1)
        coming = {f"_next{level}": F.min(F.when(F.col(state) == level, F.col("_position"))).over(ahead) for level in levels}
        due = F.col("_position") + horizon
        reached = [F.when(F.col(f"_next{level}") <= due, F.lit(level)) for level in levels]
        label = F.greatest(*reached) if len(reached) > 1 else reached[0]
        return rows.withColumns(coming).withColumn("label", label).drop(*coming)

    return over_span(df, keys, F.col(position).cast("long"), 0, horizon, length, add)


def training_windows(
    samples: DataFrame,
    rules: DataFrame,
    parameters: Sequence[str] = PARAMETERS,
    window_rows: int = 5,
    warmup: int = 5,
    minutes_per_chunk: int = 1_440,
    suffix: str = "5m",
) -> DataFrame:
    """Feature rows from long samples ``run_id, scenario, minute, parameter, value``.

    The same measures as when serving, slope per minute included, over the last rows of each run.
    """

    def add(df: DataFrame, series: WindowSpec) -> DataFrame:
        recent = series.rowsBetween(1 - window_rows, 0)
        elapsed = (F.col("minute") - F.first("minute").over(recent)) * MINUTE
        return df.withColumns(
            {
                "n": F.count("*").over(recent),
                "latest": F.col("value"),
                "mean": F.avg("value").over(recent),
                "std": F.coalesce(F.stddev_samp("value").over(recent), F.lit(0.0)),
                "slope": per_minute(F.col("value") - F.first("value").over(recent), elapsed),
            }
        )

    chunk = F.floor(F.col("minute") / minutes_per_chunk).cast("long")
    rolled = over_recent_rows(samples, ["run_id", "parameter"], ["minute"], window_rows - 1, chunk, add)
    bounds = broadcast_if_few(rules.select("parameter", *RULE_BOUNDS))
    measured = rolled.filter(F.col("minute") >= warmup).join(bounds, "parameter", "left")
    return widen(measured, ["run_id", "scenario", "minute"], parameters, 1, suffix)


def global_positions(ids: DataFrame, column: str) -> DataFrame:
    """Zero-based rank of each distinct id without gathering the ids in one task.

    A distributed sort numbers the rows inside each partition; only the per-partition counts are
    accumulated in one place. The sorted rows are checkpointed so both uses see the same partitions.
    """
    scratch_root(ids.sparkSession)
    row = F.monotonically_increasing_id()
    ordered = ids.select(column).distinct().orderBy(column).select(column, row.alias("_row")).checkpoint()
    placed = ordered.select(
        column, F.shiftright("_row", 33).alias("_part"), F.col("_row").bitwiseAND(F.lit((1 << 33) - 1)).alias("_place")
    )
    counts = placed.groupBy("_part").agg(F.count("*").alias("_n"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset"))
    return placed.join(offsets, "_part").select(column, (F.col("_offset") + F.col("_place")).alias("position"))


def split_by_run(rows: DataFrame, run: str = "run_id", every: int = 5) -> tuple[DataFrame, DataFrame]:
    """Train and test rows: every fifth run in sorted order, whole, is held out."""
    held_out = global_positions(rows, run).filter(F.col("position") % every == 0).select(run)
    return rows.join(held_out, run, "left_anti"), rows.join(held_out, run, "left_semi")


def first_per_class(rows: DataFrame, label: str, order: Sequence[str]) -> DataFrame:
    others = [c for c in rows.columns if c != label]
    first = F.min_by(F.struct(*others), F.struct(*order))
    return rows.groupBy(label).agg(first.alias("_row")).select(label, "_row.*")
