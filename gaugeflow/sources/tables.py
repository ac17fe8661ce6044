"""Keyed tables as parquet: append per batch, newest row per key on read.

A write to an existing key replaces it, as in a keyed store. Each batch goes to its own
``batch_id=<n>`` folder and a replayed batch overwrites exactly that folder, so a failed or repeated
micro-batch can neither lose nor double rows. ``read_table`` resolves keys; ``merge_table`` keeps the number
of files of a live table in bounds and ``compact_table`` writes the resolved rows to a new table.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Callable
from datetime import date, datetime, timedelta

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from gaugeflow.operators.latest import latest_per_key, retain
from gaugeflow.schemas import TABLES

BatchWriter = Callable[[DataFrame, int], None]


def project(df: DataFrame, table: str) -> DataFrame:
    """The table's columns under its declared types."""
    return df.select(*[F.col(field.name).cast(field.dataType).alias(field.name) for field in TABLES[table].schema])


def append_batch(df: DataFrame, root: str, table: str, batch_id: int) -> None:
    """Write one batch of upserts. Rebalancing merges small files and splits a hot partition."""
    spec = TABLES[table]
    rows = project(df, table)
    if spec.partition_by:
        rows = rows.hint("rebalance", *spec.partition_by)
    writer = rows.write.mode("overwrite").option("partitionOverwriteMode", "static").partitionBy(*spec.partition_by)
    writer.parquet(f"{root}/{table}/batch_id={batch_id}")


def stored_rows(spark: SparkSession, root: str, table: str) -> DataFrame:
    """All rows of all batches, under the declared types: ids in partition folders stay text."""
    schema = T.StructType([*TABLES[table].schema.fields, T.StructField("batch_id", T.LongType())])
    return spark.read.schema(schema).option("basePath", f"{root}/{table}").parquet(f"{root}/{table}")


def read_table(spark: SparkSession, root: str, table: str, as_of=None) -> DataFrame:
    """Current rows; with ``as_of``, only those still inside the table's retention."""
    spec = TABLES[table]
    stored = stored_rows(spark, root, table)
    if as_of is not None and spec.ttl_seconds is not None:
        stored = retain(stored, spec.time_column, spec.ttl_seconds, as_of)
    rows = stored.select(*spec.columns, "batch_id")
    return latest_per_key(rows, spec.keys, [*spec.version, "batch_id"]).drop("batch_id")


def compact_table(spark: SparkSession, root: str, table: str, target_root: str, as_of=None) -> None:
    """Write the current rows, with ``as_of`` without the expired ones, as one batch of a new table."""
    append_batch(read_table(spark, root, table, as_of), target_root, table, 0)


def _hadoop_path(spark: SparkSession, uri: str):
    return spark._jvm.org.apache.hadoop.fs.Path(spark._jvm.java.net.URI(uri))


def folder_exists(spark: SparkSession, path: str) -> bool:
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    return folder.getFileSystem(spark._jsc.hadoopConfiguration()).exists(folder)


def _files_by_partition(spark: SparkSession, root: str, table: str) -> dict[str, dict[int, list[str]]]:
    """File addresses of a table by partition (its folder below the batch's) and batch; names only, nothing is read."""
    found: dict[str, dict[int, list[str]]] = defaultdict(lambda: defaultdict(list))
    for uri in stored_rows(spark, root, table).inputFiles():
        batch, _, below = uri.rpartition("/batch_id=")[2].partition("/")
        found[below.rpartition("/")[0]][int(batch)].append(uri)
    return found


def merge_table(spark: SparkSession, root: str, table: str, upto: int, least: int = 2, as_of=None) -> int:
    """Merge, in place, the partitions that ``least`` or more of the batches up to ``upto`` wrote to; how many.

    Only those partitions are read. Their current rows (with ``as_of`` without the expired ones) are written aside, moved into
    batch ``upto`` file by file, and only then the files they came from are deleted. A row that is stored twice
    meanwhile, or after a crash, is resolved by its key like any other, so the table reads the same at every moment, and the next
    merge clears what is left. Batches up to ``upto`` must be over: a batch that can be replayed would replace its folder. One
    merge at a time per table; a query that listed the files before they were merged may have to be run again.
    """
    spec = TABLES[table]
    merged = {}
    for partition, batches in _files_by_partition(spark, root, table).items():
        closed = {batch: files for batch, files in batches.items() if batch <= upto}
        if len(closed) >= least:
            merged[partition] = closed
    if not merged:
        return 0
    place, aside = f"{root}/{table}", f"{root}/_merging/{table}"
    folders = [str(_hadoop_path(spark, files[0]).getParent()) for closed in merged.values() for files in closed.values()]
    schema = T.StructType([*spec.schema.fields, T.StructField("batch_id", T.LongType())])
    stored = spark.read.schema(schema).option("basePath", place).parquet(*folders)
    if as_of is not None and spec.ttl_seconds is not None:
        stored = retain(stored, spec.time_column, spec.ttl_seconds, as_of)
    rows = latest_per_key(stored.select(*spec.columns, "batch_id"), spec.keys, [*spec.version, "batch_id"]).drop("batch_id")
    rows = rows.hint("rebalance", *spec.partition_by) if spec.partition_by else rows
    rows.write.mode("overwrite").option("partitionOverwriteMode", "static").partitionBy(*spec.partition_by).parquet(aside)
    start = spark._jvm.org.apache.hadoop.fs.Path(aside)
    files = start.getFileSystem(spark._jsc.hadoopConfiguration())
    for uri in spark.read.schema(spec.schema).option("basePath", aside).parquet(aside).inputFiles():
        source = _hadoop_path(spark, uri)
        below = source.toString().rpartition(f"/_merging/{table}/")[2]
        target = spark._jvm.org.apache.hadoop.fs.Path(f"{place}/batch_id={upto}/{below}")
        files.mkdirs(target.getParent())
        if not files.rename(source, target):
            raise OSError(f"could not move {source} to {target}")
    for closed in merged.values():
        for batch, uris in closed.items():
            gone = [_hadoop_path(spark, uri) for uri in uris]
            for path in gone if batch == upto else [gone[0].getParent()]:
                files.delete(path, True)
    files.delete(start, True)
    return len(merged)


def drop_days(spark: SparkSession, root: str, before: date, column: str = "day") -> int:
    """Delete the folders ``column=<day>`` under the batches of ``root`` whose day is over; how many.

    Only names are looked at, no file is read. A day that comes back in a later batch is a new folder.
    """
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{root}/batch_id=*/{column}=*")
    files = path.getFileSystem(spark._jsc.hadoopConfiguration())
    gone = 0
    for status in files.globStatus(path) or ():
        day = status.getPath().getName().removeprefix(f"{column}=")
        if day[:4].isdigit() and date.fromisoformat(day) < before:
            gone += bool(files.delete(status.getPath(), True))
    return gone


def expire_table(spark: SparkSession, root: str, table: str, as_of: datetime) -> int:
    """Drop the day folders of a live table that have outlived its retention; how many.

    For tables partitioned by a day: whole days go, in place, while readers and writers go on.
    """
    spec = TABLES[table]
    days = [c for c in spec.partition_by if isinstance(spec.schema[c].dataType, T.DateType)]
    if spec.ttl_seconds is None or not days:
        return 0
    return drop_days(spark, f"{root}/{table}", (as_of - timedelta(seconds=spec.ttl_seconds)).date(), days[0])


def drop_prediction_date(history: DataFrame) -> DataFrame:
    """Rows for the latest-prediction table from history rows."""
    return project(history, "latest_ml_predictions_by_location")
