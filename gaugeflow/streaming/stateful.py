"""State kept across micro-batches: rolling rows and alarm episodes.

Both depend on the order of single events, which no built-in streaming aggregate expresses. Keys share their state by
``BUCKETS`` hash buckets, so that a call of the state store and of pandas serves all keys of a bucket, not one.
State is bounded: a few rows or numbers per key, plus the rows the watermark still holds back. It lives in Spark's state
store, rows as Arrow batches; one timer per bucket releases what the watermark has passed.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F, types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from gaugeflow.constants import RECENT_INTERVAL, WATERMARK
from gaugeflow.functions.times import interval_micros
from gaugeflow.operators.scoring import score_components

#: Buckets of keys; a checkpoint is bound to their number. The rows of a bucket that the watermark holds back go to one task.
BUCKETS = 1_024
#: Rows of one entry of a state list.
ROWS_PER_ENTRY = 10_000


def _bucket(buckets: int, *keys: str) -> Column:
    return F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int")


def _micros(times: pd.Series) -> np.ndarray:
    return times.to_numpy().astype("datetime64[us]").astype("int64")


def _packed(frame: pd.DataFrame) -> list[tuple[bytes]]:
    """Entries of a state list that hold the rows as Arrow batches."""
    table, entries = pa.Table.from_pandas(frame, preserve_index=False).replace_schema_metadata(None), []
    for at in range(0, table.num_rows, ROWS_PER_ENTRY):
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, table.schema, options=pa.ipc.IpcWriteOptions(compression="lz4")) as writer:
            writer.write_table(table.slice(at, ROWS_PER_ENTRY))
        entries.append((sink.getvalue().to_pybytes(),))
    return entries


def _unpacked(entries: Iterator[tuple[bytes]], columns: Sequence[str]) -> pd.DataFrame:
    held = [pa.ipc.open_stream(entry[0]).read_all() for entry in entries]
    return pa.concat_tables(held, promote_options="permissive").to_pandas() if held else pd.DataFrame(columns=[*columns])


class _Bucketed(StatefulProcessor):
    """A bucket has at most one timer, at the moment kept as ``due``."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.due = handle.getValueState("due", "at long")

    def _wake(self, at: int, later: bool = False) -> None:
        """Moves the timer to ``at`` if there is none or a later one; with ``later`` in any case."""
        held = self.due.get()
        if held is None or at < held[0] or (later and at != held[0]):
            if held is not None:
                self.handle.deleteTimer(held[0])
            self.due.update((at,))
            self.handle.registerTimer(at)

    def close(self) -> None:
        pass


def _recent_statistics(values: np.ndarray, place: np.ndarray, window_rows: int) -> tuple[np.ndarray, np.ndarray]:
    """Mean and deviation of each value and up to ``window_rows - 1`` before it; ``place`` counts the values of the same series before it."""
    values = np.where(np.isfinite(values), values, np.nan)
    shifted = []
    for back in range(min(window_rows, int(place.max()) + 1)):
        own = np.full(len(values), np.nan)
        own[back:] = values[: len(values) - back]
        own[place < back] = np.nan
        shifted.append(own)
    least = shifted[0]
    for own in shifted[1:]:
        least = np.fmin(least, own)
    count, total, squares = np.zeros(len(values)), np.zeros(len(values)), np.zeros(len(values))
    for own in shifted:
        there = ~np.isnan(own)
        count += there
        total += np.where(there, own - least, 0.0)  # from the smallest on: equal values deviate by nothing
    with np.errstate(invalid="ignore", divide="ignore"):
        mean = total / count
        for own in shifted:
            squares += np.where(np.isnan(own), 0.0, (own - least - mean) ** 2)
        return least + mean, np.where(count > 1, np.sqrt(squares / (count - 1)), 0.0)


class RollingRows(_Bucketed):
    """Holds rows until the watermark passes them, then emits them with statistics, a sensor's in event order.

    A row that comes when the watermark is past it is late: it is emitted at once, marked, without statistics, and has no part
    in those of other rows.
    """

    def __init__(self, schema: T.StructType, window_rows: int, order: list[str]):
        self.names, self.window_rows, self.order = schema.names, window_rows, order

    def init(self, handle: StatefulProcessorHandle) -> None:
        super().init(handle)
        self.waiting = handle.getListState("waiting", "rows binary")
        self.recent = handle.getListState("recent", "rows binary")

    def handleInitialState(self, key, initialState: pd.DataFrame, timerValues) -> None:
        """Values that came before the stream, oldest first."""
        values = [np.asarray(v, dtype="float64") for v in initialState["recent"]]
        values = [v[len(v) - min(len(v), self.window_rows - 1):] for v in values]
        sensors = initialState["sensor_id"].repeat([len(v) for v in values])
        if len(sensors):
            self.recent.appendList(_packed(pd.DataFrame({"sensor_id": sensors.to_numpy(), "value": np.concatenate(values)})))

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        passed, earliest = timerValues.getCurrentWatermarkInMs(), None
        for batch in rows:
            batch = batch[self.names]
            stamp = _micros(batch["event_time"]) // 1000
            late = (stamp <= passed) & (passed > 0)
            if late.any():
                yield batch[late].assign(rolling_average=np.nan, rolling_stddev=np.nan, previous_value=np.nan, late=True)
            if not late.all():
                self.waiting.appendList(_packed(batch[~late]))
                first = int(stamp[~late].min())
                earliest = first if earliest is None else min(earliest, first)
        if earliest is not None:
            self._wake(max(earliest, passed + 1))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.due.clear()
        held = _unpacked(self.waiting.get(), self.names)
        if held.empty:
            return
        stamp = _micros(held["event_time"]) // 1000
        ready = stamp <= timerValues.getCurrentWatermarkInMs()
        if ready.all():
            self.waiting.clear()
        else:
            self.waiting.put(_packed(held[~ready]))
            self._wake(int(stamp[~ready].min()))
        if ready.any():
            yield self._rolled(held[ready])

    def _rolled(self, due: pd.DataFrame) -> pd.DataFrame:
        past = _unpacked(self.recent.get(), ("sensor_id", "value"))
        sensors = np.concatenate([past["sensor_id"].to_numpy(dtype=object), due["sensor_id"].to_numpy(dtype=object)])
        code, known = pd.factorize(sensors, use_na_sentinel=False)
        due = due.assign(_sensor=code[len(past):]).sort_values(["_sensor", *self.order], ignore_index=True)
        code = np.r_[code[: len(past)], due.pop("_sensor")]
        values = np.r_[past["value"].to_numpy(dtype="float64"), due["value"].to_numpy(dtype="float64")]
        at = np.argsort(code, kind="stable")  # a sensor's past values, then its rows in order
        code, values, own = code[at], values[at], at >= len(past)
        size = np.bincount(code)
        start = np.cumsum(size) - size
        place = np.arange(len(code)) - start[code]
        average, deviation = _recent_statistics(values, place, self.window_rows)
        previous = np.where(place > 0, np.r_[np.nan, values[:-1]], np.nan)
        last = size[code] - place <= max(self.window_rows - 1, 1)
        self.recent.put(_packed(pd.DataFrame({"sensor_id": known[code[last]], "value": values[last]})))
        return due.assign(rolling_average=average[own], rolling_stddev=deviation[own], previous_value=previous[own], late=False)


def recent_values(readings: DataFrame, window_rows: int = 5, order: Sequence[str] = ("event_time",)) -> DataFrame:
    """``(sensor_id, recent)``: the last values of each sensor of a batch table, oldest first, to begin a stream with."""
    newest_first = Window.partitionBy("sensor_id").orderBy(*[F.col(c).desc() for c in order])
    last = readings.withColumn("_place", F.row_number().over(newest_first)).filter(F.col("_place") < window_rows)
    values = F.array_sort(F.collect_list(F.struct((-F.col("_place")).alias("at"), "value")))
    return last.groupBy("sensor_id").agg(F.transform(values, lambda v: v["value"]).alias("recent"))


def stream_rolling(
    enriched: DataFrame,
    window_rows: int = 5,
    order: Sequence[str] = ("event_time",),
    watermark: str = WATERMARK,
    initial: DataFrame | None = None,
    buckets: int = BUCKETS,
) -> DataFrame:
    """Every row of the stream once: with its rolling statistics, or marked ``late``.

    Rows leave once the watermark passes them, in event-time order, so the statistics of on-time rows
    equal the batch operator's however the input was split. ``initial`` (see ``recent_values``) is handed over to the state
    when the stream first starts. The state holds a sensor's last values and the rows that the watermark has not passed, by
    ``buckets`` of sensors.
    """
    place = _bucket(buckets, "sensor_id")
    # The watermark goes by a copy of the time that the operator doesn't get: Spark would drop late rows before it.
    timed = enriched.withColumn("_seen", F.col("event_time")).withWatermark("_seen", watermark).drop("_seen").withColumn("_bucket", place)
    added = [T.StructField(c, T.DoubleType()) for c in ("rolling_average", "rolling_stddev", "previous_value")]
    rolled = timed.groupBy("_bucket").transformWithStateInPandas(
        RollingRows(enriched.schema, window_rows, list(order)),
        T.StructType([*enriched.schema.fields, *added, T.StructField("late", T.BooleanType())]),
        "Append",
        "EventTime",
        initialState=None if initial is None else initial.withColumn("_bucket", place).groupBy("_bucket"),
    )
    # A pandas column carries "no value" as NaN.
    return rolled.withColumns({f.name: F.nanvl(f.name, F.lit(None).cast("double")) for f in added})


def on_time_scores(rolled: DataFrame, computed_at=None) -> DataFrame:
    return score_components(rolled.filter("NOT late").drop("late"), computed_at)


def late_rows(rolled: DataFrame) -> DataFrame:
    return rolled.filter("late").drop("rolling_average", "rolling_stddev", "previous_value", "late")


def stream_scores(
    enriched: DataFrame,
    window_rows: int = 5,
    order: Sequence[str] = ("event_time",),
    watermark: str = WATERMARK,
    computed_at=None,
    initial: DataFrame | None = None,
) -> DataFrame:
    """Anomaly scores of the rows that were on time; rolling windows continue across micro-batches."""
    return on_time_scores(stream_rolling(enriched, window_rows, order, watermark, initial), computed_at)


class AlarmEpisodes(_Bucketed):
    """Opens an alarm on the first alert and resolves it when none followed for a while."""

    KEYS, COLUMNS = ["sensor_id", "alert_type"], ["sensor_id", "alert_type", "first", "last", "alerts", "critical"]

    def __init__(self, quiet_micros: int):
        self.quiet = quiet_micros

    def init(self, handle: StatefulProcessorHandle) -> None:
        super().init(handle)
        self.episodes = handle.getListState("episodes", "rows binary")

    def _changes(self, state: str, episodes: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame(
            {
                "sensor_id": episodes["sensor_id"],
                "alert_type": episodes["alert_type"],
                "state": state,
                "severity": np.where(episodes["critical"].to_numpy(dtype=bool), "CRITICAL", "WARNING"),
                "first_seen": pd.to_datetime(episodes["first"], unit="us"),
                "last_seen": pd.to_datetime(episodes["last"], unit="us"),
                "alert_count": episodes["alerts"],
            }
        )

    def _ends(self, episodes: pd.DataFrame) -> np.ndarray:
        return (episodes["last"].to_numpy(dtype="int64") + self.quiet) // 1000 + 1

    def _keep(self, episodes: pd.DataFrame) -> None:
        self.episodes.put(_packed(episodes))
        self._wake(int(self._ends(episodes).min()), later=True)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        """Gaps longer than the quiet span cut a key's batch, the open episode before it, into episodes."""
        batch = pd.concat(list(rows), ignore_index=True)
        times = _micros(batch["event_time"])
        alerts = batch[self.KEYS].assign(first=times, last=times, alerts=1, critical=batch["severity"] == "CRITICAL", held=False)
        held = _unpacked(self.episodes.get(), self.COLUMNS)
        found = alerts if held.empty else pd.concat([held.assign(held=True), alerts], ignore_index=True)
        found["key"] = found.groupby(self.KEYS, dropna=False, sort=False).ngroup()
        missing = found["first"] == np.iinfo(np.int64).min  # no event time: last of its key, and an episode of its own
        found = found.assign(missing=missing).sort_values(["key", "held", "missing", "first"], ascending=[True, False, True, True], ignore_index=True)
        of, first, is_held = found["key"].to_numpy(), found["first"].to_numpy(dtype="int64"), found["held"].to_numpy(dtype=bool)
        latest = found.groupby("key")["last"].cummax().to_numpy(dtype="int64")
        begins = np.r_[True, of[1:] != of[:-1]] | np.r_[True, first[1:] - latest[:-1] > self.quiet]
        starts = np.flatnonzero(begins)
        ends = np.r_[starts[1:], len(found)] - 1
        episodes = found.loc[starts, self.KEYS].assign(
            first=np.minimum.reduceat(first, starts),
            last=np.where(is_held[starts], latest[ends], first[ends]),
            alerts=np.add.reduceat(found["alerts"].to_numpy(dtype="int64"), starts),
            critical=np.logical_or.reduceat(found["critical"].to_numpy(dtype=bool), starts),
        )
        opened = found.loc[starts[~is_held[starts]]]
        newest = np.r_[of[starts][1:] != of[starts][:-1], True]
        self._keep(episodes[newest])
        if len(opened):
            yield self._changes("ACTIVE", opened)
        if not newest.all():
            yield self._changes("RESOLVED", episodes[~newest])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.due.clear()
        held = _unpacked(self.episodes.get(), self.COLUMNS)
        if held.empty:
            return
        over = self._ends(held) <= timerValues.getCurrentWatermarkInMs()
        if over.all():
            self.episodes.clear()
        else:
            self._keep(held[~over])
        if over.any():
            yield self._changes("RESOLVED", held[over])


ALARM_CHANGES = (
    "sensor_id string, alert_type string, state string, severity string, first_seen timestamp,"
    "last_seen timestamp, alert_count long"
)


def stream_alarms(alerts: DataFrame, quiet: str = RECENT_INTERVAL, watermark: str = WATERMARK, buckets: int = BUCKETS) -> DataFrame:
    """State changes of alarms: ACTIVE when one opens, RESOLVED after ``quiet`` without alerts."""
    narrow = alerts.select("sensor_id", "alert_type", "severity", "event_time").withWatermark("event_time", watermark)
    return narrow.withColumn("_bucket", _bucket(buckets, "sensor_id", "alert_type")).groupBy("_bucket").transformWithStateInPandas(
        AlarmEpisodes(interval_micros(quiet)), ALARM_CHANGES, "Append", "EventTime"
    )
