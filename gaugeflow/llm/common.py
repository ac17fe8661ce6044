"""Helpers of the text operators: Arrow batches, words, stored intermediate tables."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructField, StructType

from gaugeflow.session import scratch_dir

#: Rows handled at once inside a task.
ROWS_AT_ONCE = 2_000
#: Rows that go to a Python worker in one batch; texts may be long, and a worker holds a batch several times.
ROWS_PER_BATCH = 1_000

Columns = Callable[[pa.RecordBatch], list]


def sliced(batches: Iterator[pa.RecordBatch], rows: int = ROWS_AT_ONCE) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of at most ``rows``."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def append_columns(df: DataFrame, make: Callable[[], Columns], fields: list[StructField], keep: list[str] | None = None) -> DataFrame:
    """``keep`` (all columns by default) plus new columns computed per Arrow batch, without a shuffle.

    ``make`` runs once per task and returns the function from a batch to the new columns. A kept
    column that has the name of a new one gives way to it.
    """
    df.sparkSession.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ROWS_PER_BATCH))
    new = {f.name for f in fields}
    kept = [c for c in (df.columns if keep is None else keep) if c not in new]
    schema = StructType([df.schema[c] for c in kept] + fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        compute = make()
        for batch in sliced(batches):
            columns = [batch.column(c) for c in kept] + compute(batch)
            yield pa.RecordBatch.from_arrays(columns, names=schema.names)

    return df.mapInArrow(run, schema)


def utf8(batch: pa.RecordBatch, column: str) -> list[bytes]:
    """UTF-8 bytes of a text column; null is the empty text."""
    return [x or b"" for x in batch.column(column).cast(pa.binary()).to_pylist()]


def texts(batch: pa.RecordBatch, column: str) -> list[str]:
    """Values of a text column; null is the empty text."""
    return [x or "" for x in batch.column(column).to_pylist()]


def stored(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` to the shared scratch folder and read it back: lineage ends at the files."""
    spark = df.sparkSession
    path = scratch_dir(spark, label)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def reads_files_only(df: DataFrame) -> bool:
    """Whether ``df`` is a scan of files with at most row-wise steps on it, whose rows come in one order however often it runs."""
    plan = df._jdf.queryExecution().optimizedPlan()
    names = [plan.apply(i).nodeName() for i in range(_nodes(plan))]
    return plan.deterministic() and all(n in ("Project", "Filter") or n.startswith("Relation") or n == "LogicalRelation" for n in names)


def _nodes(plan) -> int:
    """Operators of a logical plan."""
    children = plan.children()
    return 1 + sum(_nodes(children.apply(i)) for i in range(children.size()))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
