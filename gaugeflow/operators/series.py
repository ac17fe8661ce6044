"""Window functions over long series, without putting one series into one task.

A sensor may hold a third of all rows, so ``PARTITION BY sensor`` alone would send that third to one
task. Both helpers cut every series into chunks and stay exact at the seams:

* row frames: only the first rows of a chunk can look across the seam, and all they look at are the
  last rows of earlier chunks. Those edge rows - at most ``2 * lookback`` per series and chunk - get
  a second, small window over the whole series.
* spans of time: a row is copied into each chunk whose rows can reach it and the copies are dropped
  afterwards. Spark recomputes a sliding RANGE frame for every row, which is quadratic in a dense
  series, so the operators on spans use running frames or prefix sums instead.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F
from pyspark.sql.window import WindowSpec

from gaugeflow.functions.times import interval_micros

AddColumns = Callable[[DataFrame, WindowSpec], DataFrame]
AddInGroups = Callable[[DataFrame, list[str]], DataFrame]

# Candidate chunk lengths, coarse to fine.
CHUNK_LADDER = ("365 days", "30 days", "1 day", "1 hour", "10 minutes", "1 minute", "1 second")


def time_chunk(moment: str, length: str) -> Column:
    return F.floor(F.unix_micros(moment) / F.lit(interval_micros(length))).cast("long")


def over_recent_rows(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], lookback: int, chunk: Column, add: AddColumns
) -> DataFrame:
    """Run ``add(df, window)`` where the window's frames reach at most ``lookback`` rows back.

    ``chunk`` must not decrease along ``order``. Rows that tie in it are ordered by the hash of their columns, so that
    both windows see one order; what still ties is the same row twice.
    """
    hashed = [f.name for f in df.schema if "map<" not in f.dataType.simpleString()]
    near = Window.partitionBy(*keys, "_chunk").orderBy(*order, "_tie")
    marked = df.withColumns({"_chunk": chunk, "_tie": F.xxhash64(*hashed)}).withColumns(
        {
            "_head": F.lag(F.lit(True), lookback).over(near).isNull(),
            "_tail": F.lead(F.lit(True), lookback).over(near).isNull(),
        }
    )
    body = add(marked, near).filter("NOT _head")
    across = Window.partitionBy(*keys).orderBy(*order, "_tie")
    heads = add(marked.filter("_head OR _tail"), across).filter("_head")
    return body.unionByName(heads).drop("_chunk", "_tie", "_head", "_tail")


def over_span(
    df: DataFrame, keys: Sequence[str], position: Column, before: int, after: int, length: int, add: AddInGroups
) -> DataFrame:
    """Run ``add(df, groups)`` where a row depends on rows at ``position - before .. position + after``.

    ``position`` is an integer such as microseconds, seen by ``add`` as ``_position``; ``groups`` are
    the columns to partition by. Every row a group's own rows depend on is in the group.
    """
    size = F.lit(length)
    placed = df.withColumn("_position", position).withColumn("_home", F.floor(F.col("_position") / size).cast("long"))
    first = F.floor((F.col("_position") - after) / size).cast("long")
    final = F.floor((F.col("_position") + before) / size).cast("long")
    spread = placed.withColumn("_chunk", F.explode(F.sequence(first, final)))
    return add(spread, [*keys, "_chunk"]).filter("_chunk = _home").drop("_position", "_home", "_chunk")


def suggest_chunk(df: DataFrame, keys: Sequence[str], moment: str, target_rows: int = 5_000_000, at_least: int = 0) -> str:
    """Longest chunk of the ladder that keeps every (series, chunk) group within ``target_rows``.

    One histogram: rows are counted at the finest step but one, and these counts are added up for every longer step, so
    the input is read once; one number per step reaches the driver. The finest step is taken where none of the others will
    do. No chunk is shorter than ``at_least`` microseconds, the reach of the operator, unless the ladder has none that
    long. ``df`` may be any table that holds at least the rows of each series, such as the one that a series is derived from.
    """
    usable = [length for length in CHUNK_LADDER if interval_micros(length) >= at_least] or [CHUNK_LADDER[0]]
    if len(usable) == 1:
        return usable[0]
    *measured, finest = usable
    unit = interval_micros(measured[-1])
    counts = df.groupBy(*keys, time_chunk(moment, measured[-1]).alias("_chunk")).agg(F.count("*").alias("_rows"))
    steps = F.explode(
        F.array(*[F.struct(F.lit(i).alias("step"), F.floor(F.col("_chunk") * F.lit(unit) / F.lit(interval_micros(x))).cast("long").alias("chunk")) for i, x in enumerate(measured)])
    )
    groups = counts.withColumn("_at", steps).groupBy(*keys, "_at").agg(F.sum("_rows").alias("_rows"))
    largest = dict(groups.groupBy("_at.step").agg(F.max("_rows")).collect())  # one row per step
    return next((x for i, x in enumerate(measured) if largest.get(i, 0) <= target_rows), finest)
