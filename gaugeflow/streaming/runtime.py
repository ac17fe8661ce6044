"""Starting the queries: one fan-out for the row-wise outputs, one query per stateful output."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import timedelta

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T
from pyspark.sql.streaming import StreamingQuery

from gaugeflow.constants import COOLDOWN_SECONDS, FEATURE_WINDOW, PARAMETERS
from gaugeflow.functions.times import interval, interval_micros
from gaugeflow.operators.aggregates import pipeline_metrics
from gaugeflow.operators.alerts import alert_messages, derive_alerts
from gaugeflow.operators.cooldown import apply_cooldown, not_held
from gaugeflow.operators.features import RULE_BOUNDS, features_at
from gaugeflow.operators.latest import latest_per_key, latest_readings, latest_scores
from gaugeflow.operators.model import predict_risk
from gaugeflow.session import ROCKSDB_PROVIDER
from gaugeflow.sources.readings import alert_file_writer, alert_topic_writer
from gaugeflow.sources.tables import BatchWriter, append_batch, drop_days, folder_exists, merge_table, project, stored_rows
from gaugeflow.streaming.aggregates import stream_daily, stream_episodes, stream_features, stream_hourly
from gaugeflow.streaming.stateful import late_rows, on_time_scores, recent_values, stream_alarms, stream_rolling


def use_rocksdb(spark: SparkSession) -> None:
    """State store for custom state; set before the first query of a checkpoint."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB_PROVIDER)


def fan_out(*writers: BatchWriter, skip_empty: bool = True) -> BatchWriter:
    """Several writes from one micro-batch: computed once, by default skipped when empty."""

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.persist()
        try:
            if not (skip_empty and batch.isEmpty()):
                for writer in writers:
                    writer(batch, batch_id)
        finally:
            batch.unpersist()

    return write


def reading_writer(root: str, tie: Sequence[str] = ()) -> BatchWriter:
    def write(batch: DataFrame, batch_id: int) -> None:
        append_batch(batch, root, "readings_by_sensor_day", batch_id)
        append_batch(batch, root, "readings_by_cluster_parameter_day", batch_id)
        append_batch(latest_readings(batch, tie), root, "latest_readings_by_cluster", batch_id)

    return write


def alert_writer(root: str, processed_at=None) -> BatchWriter:
    def write(batch: DataFrame, batch_id: int) -> None:
        alerts = derive_alerts(batch, processed_at)
        append_batch(alerts, root, "alerts_by_sensor_day", batch_id)
        append_batch(alerts, root, "alerts_by_cluster_day", batch_id)

    return write


def score_writer(root: str, tie: Sequence[str] = ()) -> BatchWriter:
    def write(batch: DataFrame, batch_id: int) -> None:
        append_batch(batch, root, "ai_scores_by_sensor_day", batch_id)
        append_batch(latest_scores(batch, tie), root, "latest_ai_scores_by_cluster", batch_id)

    return write


def metrics_writer(root: str) -> BatchWriter:
    """Pipeline metrics of the scored rows, added to what earlier batches stored for the same cluster and minute.

    Wants every batch, empty ones too (``skip_empty=False``), as each but the first reads the table.
    """
    table, keys = "pipeline_metrics_by_cluster_minute", ["cluster_id", "metric_date", "minute_start"]
    sums, means, maxima = ("processed_reading_count", "alert_count"), ("avg_anomaly_score", "avg_event_latency_ms"), ("max_anomaly_score", "max_event_latency_ms", "updated_at")

    def write(batch: DataFrame, batch_id: int) -> None:
        own = project(pipeline_metrics(batch), table)
        if batch_id:
            earlier = stored_rows(batch.sparkSession, root, table).filter(F.col("batch_id") < batch_id)  # a replay leaves its own rows out
            known = latest_per_key(earlier, keys, ["batch_id"]).drop("batch_id").join(own.select(*keys), keys, "left_semi")
            weight = F.col("processed_reading_count")
            own = own.unionByName(known).groupBy(*keys).agg(
                *[(F.sum(F.col(c) * weight) / F.sum(weight)).alias(c) for c in means],
                *[F.sum(c).alias(c) for c in sums],
                *[F.max(c).alias(c) for c in maxima],
            )
        append_batch(own, root, table, batch_id)

    return write


def rolled_writer(root: str, scored: BatchWriter, computed_at=None) -> BatchWriter:
    """For rows of ``stream_rolling``: scores of the rows on time go to ``scored``, late rows to ``late_readings``."""

    def write(batch: DataFrame, batch_id: int) -> None:
        scored(on_time_scores(batch, computed_at), batch_id)
        late_rows(batch).write.mode("overwrite").parquet(f"{root}/late_readings/batch_id={batch_id}")

    return write


def table_writer(root: str, table: str) -> BatchWriter:
    return lambda batch, batch_id: append_batch(batch, root, table, batch_id)


def sent_alerts(spark: SparkSession, root: str, schema: T.StructType) -> DataFrame:
    """What ``cooldown_writer`` let through, with the ``day`` and ``batch_id`` of its folder; ``schema`` is that of the alerts."""
    stored = T.StructType([*schema.fields, T.StructField("day", T.DateType()), T.StructField("batch_id", T.LongType())])
    return spark.read.schema(stored).option("basePath", root).parquet(root) if folder_exists(spark, root) else spark.createDataFrame([], stored)


def cooldown_writer(
    root: str, seconds: int = COOLDOWN_SECONDS, keys: Sequence[str] = ("sensor_id", "alert_type"), tie: str = "alert_id"
) -> BatchWriter:
    """Alerts that the cooldown lets through, as files under ``root`` by batch and day; equal to the batch form if alerts come in event order.

    The files are all the state there is: a batch reads, of earlier batches, the days that a cooldown before its first alert
    reaches, and leaves out what these hold back. The rest is the batch operator's, which spreads a crowded key over tasks.
    A replayed batch overwrites its own files and sees the same earlier ones. Alerts without a time are not let through.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        spark, first, alerts = batch.sparkSession, batch.agg(F.min("event_time")).first()[0], batch
        if first is not None and seconds > 0:
            since = F.lit(first) - F.make_dt_interval(secs=F.lit(seconds))
            sent = sent_alerts(spark, root, batch.schema).filter(F.col("batch_id") < batch_id)
            alerts = not_held(batch, sent.filter((F.col("day") >= F.to_date(since)) & (F.col("event_time") > since)), seconds, keys)
        passed = apply_cooldown(alerts, seconds, keys, tie=tie)
        passed.withColumn("day", F.to_date("event_time")).write.mode("overwrite").partitionBy("day").parquet(f"{root}/batch_id={batch_id}")

    return write


def upkeep_writer(root: str, tables: Sequence[str], every: int) -> BatchWriter:
    """Merges, after every so many batches, what earlier batches left of ``tables``; put it after their writers.

    The batch just written is left alone, as it may be replayed.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        if batch_id and batch_id % every == 0:
            for table in tables:
                merge_table(batch.sparkSession, root, table, batch_id - 1)

    return write


def prediction_writer(root: str, model: PipelineModel, **options) -> BatchWriter:
    def write(batch: DataFrame, batch_id: int) -> None:
        history = predict_risk(model, batch, **options)
        append_batch(history, root, "ml_predictions_by_location_minute", batch_id)
        append_batch(history, root, "latest_ml_predictions_by_location", batch_id)

    return write


def trailing_feature_writer(
    state_root: str,
    writer: BatchWriter,
    parameters: Sequence[str] = PARAMETERS,
    window: str = FEATURE_WINDOW,
    location: str = "cluster_id",
    tie: str | None = None,
    **options,
) -> BatchWriter:
    """Features over the span that ends at each micro-batch's newest reading, handed to ``writer``.

    The readings are kept as files by batch and day; a batch reads the days that its span touches, of itself and earlier
    batches, and drops days that no span can reach any more (``keep_days`` late days are left for a replay). A
    replayed batch overwrites its own files and sees the same earlier ones, so it gives the same features.
    """
    keep_days = options.pop("keep_days", 7)

    def write(batch: DataFrame, batch_id: int) -> None:
        newest = batch.agg(F.max("event_time").alias("at")).first()["at"]
        if newest is None:
            return
        moment = F.lit(newest)
        columns = [location, "parameter", "event_time", "value", "rule_enabled", *RULE_BOUNDS, *([tie] if tie else [])]
        rows = batch.filter("rule_enabled").filter(F.col("parameter").isin(*parameters)).select(*columns)
        schema = rows.schema.add("day", "date").add("batch_id", "long")
        rows.withColumn("day", F.to_date("event_time")).write.mode("overwrite").partitionBy("day").parquet(f"{state_root}/batch_id={batch_id}")
        kept = batch.sparkSession.read.schema(schema).option("basePath", state_root).parquet(state_root)
        span = (F.col("day") >= F.to_date(moment - interval(window))) & (F.col("day") <= F.to_date(moment)) & (F.col("batch_id") <= batch_id)
        writer(features_at(kept.filter(span), newest, parameters, window, location=location, tie=tie, **options), batch_id)
        oldest = newest - timedelta(microseconds=interval_micros(window)) - timedelta(days=keep_days)
        drop_days(batch.sparkSession, state_root, oldest.date())

    return write


def start(
    rows: DataFrame, writer: BatchWriter, name: str, checkpoint_root: str, mode: str = "append", drain: bool = False
) -> StreamingQuery:
    """One named query with its own checkpoint; ``drain`` processes what is there and stops."""
    query = (
        rows.writeStream.foreachBatch(writer)
        .outputMode(mode)
        .queryName(name)
        .option("checkpointLocation", f"{checkpoint_root}/{name}")
    )
    return (query.trigger(availableNow=True) if drain else query).start()


def start_pipeline(
    enriched: DataFrame,
    root: str,
    checkpoint_root: str,
    model: PipelineModel | None = None,
    drain: bool = False,
    tie: Sequence[str] = (),
    watermark: str = "10 minutes",
    features: dict | None = None,
    broker: tuple[str, str] | None = None,
    cooldown_seconds: int | None = None,
    quiet: str | None = None,
    history: DataFrame | None = None,
    trailing: bool = False,
    merge_every: int | None = 20,
) -> list[StreamingQuery]:
    """Every table from one enriched reading stream.

    Readings and alerts share one query, so parsing and enrichment run once for them; only the
    stateful outputs need queries of their own. The score query handles empty batches too, as its metrics add up over
    all batches. Scores begin with the last values of ``history``, a batch table of readings, where one is given. Rows that come
    after the watermark are kept under ``late_readings``; ``dropped_rows`` counts what the aggregates left out. Predictions are made
    for each window as it closes, or with ``trailing`` for the span that ends at each micro-batch's newest reading.

    Alerts leave through ``broker`` (servers, topic), or as JSON files under ``alert_messages`` without one. With
    ``cooldown_seconds`` the alerts that may be notified go to ``notified_alerts``, with ``quiet`` the state changes of
    alarms to ``alarm_changes`` and their episodes to ``alarm_episodes`` when they are over, all as parquet files.

    Every ``merge_every`` batches of a query the files of its keyed tables are merged (None: never), so that reads do not slow down.
    """

    def kept(*tables: str) -> list[BatchWriter]:
        return [upkeep_writer(root, tables, merge_every)] if merge_every else []

    use_rocksdb(enriched.sparkSession)
    scored_tables = kept("ai_scores_by_sensor_day", "latest_ai_scores_by_cluster", "pipeline_metrics_by_cluster_minute")
    scores = rolled_writer(root, fan_out(score_writer(root, tie), metrics_writer(root), *scored_tables, skip_empty=False))
    reading_tables = kept("readings_by_sensor_day", "readings_by_cluster_parameter_day", "latest_readings_by_cluster")
    alert_tables = kept("alerts_by_sensor_day", "alerts_by_cluster_day")
    order = ("event_time", *tie)
    before = None if history is None else recent_values(history, order=order)
    rolled = stream_rolling(enriched, order=order, watermark=watermark, initial=before)
    alerts = derive_alerts(enriched)
    where = {"checkpoint_root": checkpoint_root, "drain": drain}
    queries = [
        start(enriched, fan_out(reading_writer(root, tie), alert_writer(root), *reading_tables, *alert_tables), "readings_and_alerts", **where),
        start(
            stream_hourly(enriched, watermark, tie=tie),
            fan_out(table_writer(root, "readings_hourly_by_cluster_parameter"), *kept("readings_hourly_by_cluster_parameter")), "hourly", mode="update", **where,
        ),
        start(
            stream_daily(enriched, watermark, tie=tie),
            fan_out(table_writer(root, "readings_daily_by_cluster_parameter"), *kept("readings_daily_by_cluster_parameter")), "daily", mode="update", **where,
        ),
        start(rolled, fan_out(scores, skip_empty=False), "scores", **where),
    ]
    messages = alert_messages(alerts)
    if broker:
        sink = alert_topic_writer(messages, *broker, f"{checkpoint_root}/alert_messages")
    else:
        sink = alert_file_writer(messages.select(F.col("value").cast("string").alias("value")), f"{root}/alert_messages", f"{checkpoint_root}/alert_messages")
    queries.append((sink.trigger(availableNow=True) if drain else sink).start())
    changes = {}
    if cooldown_seconds is not None:
        queries.append(start(alerts, fan_out(cooldown_writer(f"{root}/notified_alerts", cooldown_seconds)), "notified_alerts", **where))
    if quiet is not None:
        changes["alarm_changes"] = stream_alarms(alerts, quiet, watermark)
        changes["alarm_episodes"] = stream_episodes(alerts, quiet, watermark)
    for name, rows in changes.items():
        sink = rows.writeStream.format("parquet").option("path", f"{root}/{name}").option("checkpointLocation", f"{checkpoint_root}/{name}").queryName(name)
        queries.append((sink.trigger(availableNow=True) if drain else sink).start())
    if model is not None:
        if trailing:
            order = {"tie": tie[0]} if tie else {}
            rows, writer = enriched, trailing_feature_writer(f"{checkpoint_root}/predictions-readings", prediction_writer(root, model), **order, **(features or {}))
        else:
            rows, writer = stream_features(enriched, watermark=watermark, **(features or {})), prediction_writer(root, model)
        predicted = kept("ml_predictions_by_location_minute", "latest_ml_predictions_by_location")
        queries.append(start(rows, fan_out(writer, *predicted), "predictions", **where))
    return queries


def run_until_failure(spark: SparkSession) -> None:
    spark.streams.awaitAnyTermination()
