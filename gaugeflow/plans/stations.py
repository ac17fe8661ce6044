"""The given tables seen as a sensor installation.

``events`` is the reading stream: a user is a station, and each event type at a station is a sensor.
``supplier`` is the registry: the stations whose number is a supplier key are registered, with one
sensor per event type; readings of all other users come from unknown sensors. ``region`` lists the
clusters, of which some have no sensors. The rule catalogue leaves one parameter disabled and one
without a rule.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from gaugeflow.constants import RULE_COLUMNS
from gaugeflow.functions.rules import breach_direction, critical_breach
from gaugeflow.operators.alerts import derive_alerts
from gaugeflow.operators.enrich import enrich_readings, parameter_rules, sensor_metadata
from gaugeflow.operators.scoring import score_anomalies
from gaugeflow.operators.series import suggest_chunk

KINDS = ("click", "error", "purchase", "signup", "view")
PARAMETERS = ("click", "error", "purchase")
RULES = [
    ("click", "Click", "cnt", 2.0, 150.0, 0.5, 225.0, 50.0, 100.0, True),
    ("error", "Error", "err", 1.0, 120.0, 0.2, 200.0, 25.0, 50.0, True),
    ("purchase", "Purchase", "usd", 5.0, 140.0, 1.0, 220.0, 50.0, 100.0, True),
    ("view", "View", "cnt", 2.0, 150.0, 0.5, 225.0, 50.0, None, False),
]
OUTCOMES = ("high_critical", "high_warning", "low_critical", "low_warning", "normal")
ORDER = ("event_time", "reading_id")


def _literal(v) -> str:
    return "NULL" if v is None else f"'{v}'" if isinstance(v, str) else str(v)


def _cluster(number: Column) -> Column:
    return F.concat(F.lit("C"), (number % 3 + 1).cast("string"))


def _local(number: Column, kind: Column) -> Column:
    return F.concat(F.lit("S"), number.cast("string"), F.lit("_"), kind)


def readings_from(events: DataFrame) -> DataFrame:
    station, kind = F.col("user_id"), F.col("event_type")
    delay = F.get_json_object("props", "$.k").cast("int")
    return events.select(
        F.col("event_id").alias("reading_id"),
        F.concat(_cluster(station), _local(station, kind)).alias("sensor_id"),
        kind.alias("sensor_type"),
        "value",
        F.col("ts").cast("timestamp").alias("event_time"),
        (F.col("ts").cast("timestamp") + F.make_dt_interval(secs=delay)).alias("arrived_at"),
        delay.alias("k"),
    )


@dataclass(frozen=True)
class Stations:
    spark: SparkSession
    root: str

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.root}/{name}.parquet")

    def event_stream(self) -> DataFrame:
        schema = self.table("events").schema
        return self.spark.readStream.schema(schema).parquet(f"{self.root}/events*.parquet")

    def readings(self) -> DataFrame:
        return readings_from(self.table("events"))

    def configs(self) -> DataFrame:
        kinds = F.explode(F.array(*[F.lit(k) for k in KINDS]))
        station = F.col("s_suppkey")
        return self.table("supplier").withColumn("kind", kinds).select(
            _cluster(station).alias("cluster_id"),
            _local(station, F.col("kind")).alias("sensor_id"),
            F.col("s_nationkey").cast("double").alias("min_value"),
            (F.col("s_nationkey") + 250.0).alias("max_value"),
            F.col("kind").alias("sensor_type"),
            F.when(F.col("s_acctbal") >= 5000, F.upper("kind")).alias("unit"),
            (F.col("s_nationkey") + 1).cast("int").alias("measure_interval_s"),
            F.lit(10).alias("config_interval_s"),
            F.timestamp_seconds(F.lit(1704067200) + station).alias("updated_at"),
        )

    def clusters(self) -> DataFrame:
        return self.table("region").select(
            F.concat(F.lit("C"), (F.col("r_regionkey") + 1).cast("string")).alias("cluster_id")
        )

    def rules(self) -> DataFrame:
        names = ", ".join(field.split()[0] for field in RULE_COLUMNS.split(","))
        kinds = {field.split()[0]: field.split()[1] for field in RULE_COLUMNS.split(",")}
        rows = ", ".join("(" + ", ".join(_literal(v) for v in row) + ")" for row in RULES)
        typed = [F.col(name).cast(kind) for name, kind in kinds.items()]
        return self.spark.sql(f"SELECT * FROM VALUES {rows} AS t({names})").select(*typed)

    def enrich(self, readings: DataFrame) -> DataFrame:
        return enrich_readings(
            readings,
            sensor_metadata(self.configs()),
            parameter_rules(self.rules()),
            ingestion_time=F.col("arrived_at"),
            keep=("reading_id", "k"),
        )

    def enriched(self) -> DataFrame:
        return self.enrich(self.readings())

    def alerts(self) -> DataFrame:
        return derive_alerts(self.enriched(), processed_at=F.col("ingestion_time"))

    def scored(self) -> DataFrame:
        chunk = suggest_chunk(self.readings(), ["sensor_id"], "event_time")  # at least the rows of the enriched series
        return score_anomalies(self.enriched(), computed_at=F.col("ingestion_time"), order=ORDER, chunk=chunk)

    def outcome_shares(self, window: str = "1 hour") -> DataFrame:
        """Share of each outcome per cluster and window, as the class probabilities of a prediction."""
        kind = F.concat(
            F.lower(breach_direction()), F.when(critical_breach(), F.lit("_critical")).otherwise("_warning")
        )
        judged = self.enriched().withColumn("outcome", F.coalesce(kind, F.lit("normal")))
        shares = [(F.count_if(F.col("outcome") == o) / F.count("*")) for o in OUTCOMES]
        return (
            judged.groupBy(F.col("cluster_id").alias("location_id"), F.window("event_time", window).alias("span"))
            .agg(F.array(*shares).alias("probabilities"))
            .select("location_id", F.col("span.end").alias("prediction_time"), "probabilities")
        )

    def hourly_samples(self) -> DataFrame:
        """Long training samples: a run is a cluster-day, its minutes are hours, values hourly means.

        A run with an hourly mean of 120 or more is a spike whose event starts at the hour of the peak.
        """
        hourly = (
            self.enriched()
            .filter(F.col("parameter").isin(*PARAMETERS))
            .groupBy("cluster_id", "bucket_date", F.hour("event_time").alias("minute"), "parameter")
            .agg(F.avg("value").alias("value"))
            .withColumn("run_id", F.concat_ws("-", "cluster_id", F.col("bucket_date").cast("string")))
        )
        runs = hourly.groupBy("run_id").agg(
            F.max("value").alias("peak"), F.max_by("minute", "value").alias("event_start")
        )
        scenario = F.when(F.col("peak") >= 120, F.lit("spike")).otherwise("normal")
        return hourly.join(runs.withColumn("scenario", scenario), "run_id").select(
            "run_id", "scenario", F.col("minute").cast("long").alias("minute"), "parameter", "value", "event_start"
        )
