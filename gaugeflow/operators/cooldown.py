"""Alert cooldown: per key, emit an alert only when enough time passed since the last *emitted* one.

Each emission depends on the one before, which looks like a fold over the whole series of a key. It is a walk over pointers
instead, the same for all keys and spread over all tasks, whatever a key's share:

1. The moments of a key are the nodes. A node points at the first moment at least a cooldown later, found by a running
   minimum inside time chunks; where a chunk has none, at the first moment of the next chunk that has one.
2. A moment without another in the cooldown before it is emitted for certain: the walks start there and need go no
   further than the next such moment.
3. Pointers are doubled: round ``k`` marks the targets of all marked nodes over pointers of ``2 ** k`` steps. A
   pointer past the end of its walk is dropped, so the rounds are the logarithm of the longest walk and get smaller.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from gaugeflow.constants import COOLDOWN_SECONDS
from gaugeflow.functions.times import interval_micros
from gaugeflow.operators.series import suggest_chunk
from gaugeflow.session import scratch_dir

MOST_ROUNDS = 64


def _kept(df: DataFrame, label: str) -> DataFrame:
    """Written to the scratch folder and read back: computed once, and the plan starts anew."""
    path = scratch_dir(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def next_moments(nodes: DataFrame, keys: Sequence[str], cooldown: int, chunk: int) -> DataFrame:
    """``(keys, at, next, sure)``: the first moment of the key at least ``cooldown`` later, and whether none is in the cooldown before.

    ``nodes`` holds each moment ``at`` (microseconds) of a key once. Every moment is a place to be found and sends two
    questions along the series: what is at ``at + cooldown`` or later, and what is after ``at - cooldown``.
    """
    at = F.col("at")
    spots = F.explode(
        F.array(
            F.struct(at.alias("pos"), F.lit(0).alias("asks"), at.alias("of")),
            F.struct((at + cooldown).alias("pos"), F.lit(1).alias("asks"), at.alias("of")),
            F.struct((at - cooldown + 1).alias("pos"), F.lit(2).alias("asks"), at.alias("of")),
        )
    )
    placed = nodes.select(*keys, spots.alias("_spot")).select(*keys, "_spot.*")
    placed = placed.withColumn("_chunk", F.floor(F.col("pos") / F.lit(chunk)).cast("long"))
    moment = F.when(F.col("asks") == 0, F.col("pos"))
    onward = Window.partitionBy(*keys, "_chunk").orderBy(F.col("pos").desc(), "asks").rowsBetween(Window.unboundedPreceding, 0)
    later = Window.partitionBy(*keys).orderBy(F.col("_chunk").desc()).rowsBetween(Window.unboundedPreceding, -1)
    firsts = placed.groupBy(*keys, "_chunk").agg(F.min(moment).alias("_first"))
    beyond = firsts.select(*keys, "_chunk", F.min("_first").over(later).alias("_beyond"))
    found = placed.withColumn("_here", F.min(moment).over(onward)).filter("asks > 0").join(beyond, [*keys, "_chunk"])
    answer = F.coalesce("_here", "_beyond")
    answers = found.groupBy(*keys, F.col("of").alias("at")).agg(
        F.min(F.when(F.col("asks") == 1, answer)).alias("next"), F.min(F.when(F.col("asks") == 2, answer)).alias("_nearest")
    )
    return answers.select(*keys, "at", "next", (F.col("_nearest") == F.col("at")).alias("sure"))


def emitted_moments(pointers: DataFrame, keys: Sequence[str]) -> DataFrame:
    """``(keys, at)`` of the moments that the walks from the sure ones visit."""
    ends = pointers.filter("sure").select(*keys, F.col("at").alias("next"))
    marked = pointers.filter("sure").select(*keys, "at")
    steps = pointers.filter("next IS NOT NULL").select(*keys, "at", "next").join(ends, [*keys, "next"], "left_anti")
    steps = _kept(steps, "cooldown-steps")
    for _ in range(MOST_ROUNDS):
        if steps.isEmpty():
            return marked
        reached = steps.join(marked, [*keys, "at"], "left_semi").select(*keys, F.col("next").alias("at"))
        marked = _kept(marked.unionByName(reached).distinct(), "cooldown-marked")
        onward = steps.select(*keys, F.col("at").alias("next"), F.col("next").alias("_far"))
        steps = _kept(steps.join(onward, [*keys, "next"]).select(*keys, "at", F.col("_far").alias("next")), "cooldown-steps")
    raise RuntimeError("walks longer than 2 ** 64 steps")


def key_slots(keys: Sequence[str]) -> dict[str, Column]:
    """The keys as columns of their own in which a missing key has a name."""
    unnamed = {"sensor_id": "unknown-sensor", "alert_type": "unknown-alert"}
    return {f"_key{i}": F.coalesce(k, F.lit(unnamed.get(k, ""))) for i, k in enumerate(keys)}


def not_held(alerts: DataFrame, sent: DataFrame, seconds: int, keys: Sequence[str], time_col: str = "event_time") -> DataFrame:
    """Alerts at least a cooldown after the newest of their key in ``sent``, the alerts that were let through before."""
    slots = key_slots(keys)
    newest = sent.groupBy(*[c.alias(n) for n, c in slots.items()]).agg(F.max(time_col).alias("_last"))
    free = F.col("_last").isNull() | (F.col(time_col) >= F.col("_last") + F.make_dt_interval(secs=F.lit(seconds)))
    return alerts.withColumns(slots).join(newest, [*slots], "left").filter(free).select(*alerts.columns)


def apply_cooldown(
    alerts: DataFrame,
    seconds: int = COOLDOWN_SECONDS,
    keys: Sequence[str] = ("sensor_id", "alert_type"),
    time_col: str = "event_time",
    tie: str = "alert_id",
    chunk: str | None = None,
) -> DataFrame:
    """Alerts that a cooldown of ``seconds`` lets through, in event time, exact for any key size.

    ``alerts`` is computed once and written to the scratch folder; all else reads that. Of alerts at one moment the one with
    the smallest ``tie`` passes. Without a ``chunk`` its length comes from the alerts of the most crowded key. Without a
    cooldown (0 or less) every alert passes.
    """
    if seconds <= 0:
        return alerts
    slots = key_slots(keys)
    given = _kept(alerts.withColumns({**slots, "_at": F.unix_micros(time_col)}), "cooldown-alerts")
    chunk = chunk or suggest_chunk(given, [*slots], time_col)
    nodes = given.filter("_at IS NOT NULL").groupBy(*slots, F.col("_at").alias("at")).agg(F.min(tie).alias("_tie"))
    pointers = _kept(next_moments(nodes.select(*slots, "at"), [*slots], seconds * 1_000_000, interval_micros(chunk)), "cooldown-pointers")
    emitted = emitted_moments(pointers, [*slots]).withColumnRenamed("at", "_at")
    first = emitted.join(nodes.withColumnRenamed("at", "_at"), [*slots, "_at"]).withColumnRenamed("_tie", tie)
    return given.join(first, [*slots, "_at", tie], "left_semi").dropDuplicates([*slots, "_at", tie]).select(*alerts.columns)
