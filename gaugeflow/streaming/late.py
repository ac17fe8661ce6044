"""Rows that streaming aggregates leave out because the watermark has passed them."""

from __future__ import annotations

from collections import Counter
from threading import Lock

from pyspark.sql import SparkSession
from pyspark.sql.streaming import StreamingQueryListener


class DroppedRows(StreamingQueryListener):
    """Counts, per query name, the rows that its stateful operators dropped as late.

    An aggregate counts a late row once per task and group, after its partial step, as Spark's own metric does.
    """

    def __init__(self):
        self._lock, self._counts = Lock(), Counter()

    def counts(self) -> dict[str, int]:
        with self._lock:
            return dict(self._counts)

    def onQueryStarted(self, event) -> None:
        with self._lock:
            self._counts[event.name or str(event.id)] += 0

    def onQueryProgress(self, event) -> None:
        progress = event.progress
        dropped = sum(operator.numRowsDroppedByWatermark for operator in progress.stateOperators)
        with self._lock:
            self._counts[progress.name or str(progress.id)] += dropped

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        pass


def dropped_rows(spark: SparkSession) -> DroppedRows:
    """A counter that hears of all queries of the session from now on."""
    counter = DroppedRows()
    spark.streams.addListener(counter)
    return counter
