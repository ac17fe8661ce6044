"""Join readings with the sensor registry and the parameter rules.

The rule catalogue is broadcast after a check that it is small. The sensor registry may grow with the
installation and carries no hint: Spark broadcasts it below ``autoBroadcastJoinThreshold`` and
otherwise uses a shuffled join whose skewed partitions (a hot sensor) adaptive execution splits.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from gaugeflow.functions.ids import global_sensor_id
from gaugeflow.functions.rules import quality_status
from gaugeflow.functions.sizes import broadcast_if_few
from gaugeflow.functions.times import given_or_now, month_bucket

RULE_FIELDS = (
    "normal_low",
    "normal_high",
    "critical_low",
    "critical_high",
    "threshold_scale",
    "rate_change_scale",
)

#: Columns of an enriched reading, in order.
ENRICHED = (
    *("sensor_id", "cluster_id", "local_sensor_id", "sensor_type", "event_time", "parameter", "display_name", "value", "unit"),
    *("quality_status", "rule_enabled", *RULE_FIELDS, "ingestion_time", "bucket_date", "bucket_month", "bucket_year"),
)


def sensor_metadata(configs: DataFrame) -> DataFrame:
    return configs.select(
        global_sensor_id(F.col("cluster_id"), F.col("sensor_id")).alias("sensor_id"),
        "cluster_id",
        F.col("sensor_id").alias("local_sensor_id"),
        F.col("sensor_type").alias("parameter"),
        "unit",
    )


def parameter_rules(rules: DataFrame) -> DataFrame:
    """``(parameter, rule)``: the catalogue with each rule as one column."""
    return broadcast_if_few(rules.select("parameter", F.struct("display_name", "unit", "enabled", *RULE_FIELDS).alias("rule")))


def enrich_readings(
    valid: DataFrame, metadata: DataFrame, rules: DataFrame, ingestion_time=None, keep: tuple[str, ...] = ()
) -> DataFrame:
    """Registered readings with rule columns, quality status and calendar buckets.

    Unregistered sensors drop out (inner join); a parameter without a rule stays, unconfigured.
    ``keep`` carries further input columns through, for example a reading id used as a tie-break.
    """
    known = valid.join(metadata, "sensor_id").filter("cluster_id IS NOT NULL")
    named = known.withColumn("parameter", F.coalesce("parameter", "sensor_type")).filter("parameter IS NOT NULL")
    rule, moment = F.col("rule"), F.col("event_time")
    judged = named.join(rules, "parameter", "left").withColumns(
        {
            **{bound: rule[bound] for bound in RULE_FIELDS},
            "rule_enabled": F.coalesce(rule["enabled"], F.lit(False)),
            "display_name": F.coalesce(rule["display_name"], "parameter"),
            "unit": F.coalesce("unit", rule["unit"]),
        }
    )
    dated = judged.withColumns(
        {
            "quality_status": quality_status(),
            "ingestion_time": given_or_now(ingestion_time),
            "bucket_date": F.to_date(moment),
            "bucket_month": month_bucket(moment),
            "bucket_year": F.year(moment),
        }
    )
    return dated.select(*keep, *ENRICHED)


def unknown_sensors(readings: DataFrame, metadata: DataFrame) -> DataFrame:
    return readings.join(metadata, "sensor_id", "left_anti")


def known_sensors(readings: DataFrame, metadata: DataFrame) -> DataFrame:
    return readings.join(metadata, "sensor_id", "left_semi")
