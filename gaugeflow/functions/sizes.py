"""Checked broadcasts."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

FEW_ROWS = 10_000


def broadcast_if_few(df: DataFrame, rows: int = FEW_ROWS) -> DataFrame:
    """Broadcast ``df`` after counting that it has at most ``rows`` rows; else leave the join to Spark.

    For catalogues such as the parameter rules: joining on a handful of parameters by shuffle would
    send whole parameters to single tasks. The count stops after ``rows + 1`` rows.
    """
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df
