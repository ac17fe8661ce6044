"""Reading sources and the outgoing alert topic."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import DataStreamWriter
from pyspark.sql.types import StructType


def kafka_source_options(
    servers: str, topic: str, starting: str = "earliest", max_offsets: int | None = None, fail_on_data_loss: bool = True
) -> dict[str, str]:
    """Lost offsets stop the query and nothing is skipped or held back, unless asked for."""
    options = {
        "kafka.bootstrap.servers": servers,
        "subscribe": topic,
        "startingOffsets": starting,
        "failOnDataLoss": str(fail_on_data_loss).lower(),
    }
    return options | ({"maxOffsetsPerTrigger": str(max_offsets)} if max_offsets else {})


def read_readings_stream(
    spark: SparkSession,
    fmt: str = "kafka",
    schema: StructType | str | None = None,
    path: str | None = None,
    **options: str,
) -> DataFrame:
    """Streaming source: ``kafka`` with the options above, or files (``parquet``, ``json``, ``text``).

    The Kafka connector package must be on the session's classpath. Bound a file source with
    ``maxFilesPerTrigger``.
    """
    reader = spark.readStream.format(fmt).options(**options)
    if schema is not None:
        reader = reader.schema(schema)
    return reader.load(path) if path else reader.load()


def alert_topic_writer(messages: DataFrame, servers: str, topic: str, checkpoint: str) -> DataStreamWriter:
    return (
        messages.writeStream.format("kafka")
        .option("kafka.bootstrap.servers", servers)
        .option("topic", topic)
        .option("checkpointLocation", checkpoint)
        .queryName("alerts_topic")
        .outputMode("append")
    )


def alert_file_writer(messages: DataFrame, path: str, checkpoint: str) -> DataStreamWriter:
    """The same messages as JSON files, where no broker is at hand."""
    return (
        messages.writeStream.format("json")
        .option("path", path)
        .option("checkpointLocation", checkpoint)
        .queryName("alerts_files")
        .outputMode("append")
    )


def console_writer(rows: DataFrame, name: str, checkpoint: str) -> DataStreamWriter:
    """Debug sink."""
    return (
        rows.writeStream.format("console")
        .option("truncate", "false")
        .option("checkpointLocation", checkpoint)
        .queryName(name)
        .outputMode("append")
    )
