"""Checks of a topic's offsets, over rows that carry ``partition`` and ``offset``."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

#: Offsets of a partition that are looked at in one task.
OFFSETS_PER_CHUNK = 1_000_000


def topic_gaps(rows: DataFrame, per_chunk: int = OFFSETS_PER_CHUNK) -> DataFrame:
    """``(partition, kind, first_offset, last_offset, rows)``: ranges of offsets that are missing, and offsets that came more than once.

    ``rows`` is the number of missing offsets, or of surplus rows. A partition is cut into chunks of offsets, so a busy
    one is not one task; between chunks only their first and last offsets are compared. What comes before a
    partition's first offset and after its last is not missing. Rows without partition or offset are ignored.
    """
    offset = F.col("offset").cast("long")
    placed = rows.select("partition", offset.alias("offset"), F.floor(offset / F.lit(per_chunk)).cast("long").alias("_chunk"))
    placed = placed.filter("partition IS NOT NULL AND offset IS NOT NULL")
    before = F.lag("offset").over(Window.partitionBy("partition", "_chunk").orderBy("offset"))
    steps = placed.select("partition", "_chunk", "offset", before.alias("_before"))
    edges = placed.groupBy("partition", "_chunk").agg(F.min("offset").alias("offset"), F.max("offset").alias("_last"))
    seams = edges.select("partition", "_chunk", "offset", F.lag("_last").over(Window.partitionBy("partition").orderBy("_chunk")).alias("_before"))
    moves = steps.unionByName(seams)
    missing = moves.filter(F.col("offset") > F.col("_before") + 1).select(
        "partition", F.lit("gap").alias("kind"), (F.col("_before") + 1).alias("first_offset"), (F.col("offset") - 1).alias("last_offset"),
        (F.col("offset") - F.col("_before") - 1).alias("rows"),
    )
    again = steps.filter(F.col("offset") == F.col("_before")).groupBy("partition", "offset").agg(F.count("*").alias("rows"))
    return missing.unionByName(
        again.select("partition", F.lit("repeat").alias("kind"), F.col("offset").alias("first_offset"), F.col("offset").alias("last_offset"), "rows")
    )
