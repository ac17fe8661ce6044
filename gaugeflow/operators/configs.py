"""Sensor registry: listing, dump, patching and reference checks."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from gaugeflow.functions.ids import global_sensor_id, is_sensor_reference, prefixed_id, reference_part
from gaugeflow.functions.times import given_or_now

# Patch field -> stored column and type.
PATCH_FIELDS = {
    "min": ("min_value", "double"),
    "max": ("max_value", "double"),
    "type": ("sensor_type", "string"),
    "unit": ("unit", "string"),
    "measure_interval_s": ("measure_interval_s", "int"),
    "config_interval_s": ("config_interval_s", "int"),
}
DEFAULT_CONFIG_INTERVAL = 10


def cluster_ids(clusters: DataFrame, configs: DataFrame) -> DataFrame:
    return clusters.select("cluster_id").union(configs.select("cluster_id")).distinct().orderBy("cluster_id")


def sensor_listing(configs: DataFrame) -> DataFrame:
    listed = configs.withColumns(
        {
            "local_sensor_id": F.col("sensor_id"),
            "sensor_id": global_sensor_id(F.col("cluster_id"), F.col("sensor_id")),
            "parameter": F.col("sensor_type"),
            "status": F.lit("active"),
            "last_seen_at": F.col("updated_at"),
        }
    )
    return listed.orderBy("cluster_id", "local_sensor_id")


def first_sensor(configs: DataFrame) -> DataFrame:
    return sensor_listing(configs).select("sensor_id").limit(1)


def known_clusters(requested: DataFrame, clusters: DataFrame) -> DataFrame:
    return requested.join(clusters, "cluster_id", "left_semi")


def sensor_references(refs: DataFrame, column: str = "ref") -> DataFrame:
    ref = F.col(column)
    return refs.select(
        "*",
        is_sensor_reference(ref).alias("is_valid"),
        reference_part(ref, 1).alias("ref_cluster"),
        reference_part(ref, 2).alias("ref_sensor"),
        prefixed_id(ref, "C").alias("as_cluster"),
        prefixed_id(ref, "S").alias("as_sensor"),
    )


def dump_configs(clusters: DataFrame, configs: DataFrame) -> DataFrame:
    """One row per cluster and sensor with the sensor's settings under their patch names.

    Clusters without sensors appear once without a sensor, sensors of an unlisted cluster bring their cluster along.
    """
    fields = [F.col(stored).alias(field) for field, (stored, _) in PATCH_FIELDS.items()]
    sensors = configs.select("cluster_id", "sensor_id", *fields)
    return clusters.select("cluster_id").distinct().join(sensors, "cluster_id", "full_outer")


def reduce_patches(patches: DataFrame, order: str = "patch_time") -> DataFrame:
    """Several patches of one sensor to one: per field, the latest patch that names it.

    A field is null when no patch names it and ``struct(null)`` when it was set to null on purpose.
    """
    reduced = []
    for field in PATCH_FIELDS:
        named = F.map_contains_key("patch", F.lit(field))
        setting = F.when(named, F.struct(F.col("patch")[field].alias("to")))
        reduced.append(F.max_by(setting, F.when(named, F.col(order))).alias(f"_{field}"))
    return patches.groupBy("cluster_id", "sensor_id").agg(*reduced)


def merge_configs(configs: DataFrame, patches: DataFrame, updated_at=None, order: str = "patch_time") -> DataFrame:
    """Insert unknown sensors, overlay only the named fields on known ones."""
    old = configs.withColumn("_known", F.lit(True))
    new = reduce_patches(patches, order).withColumn("_patched", F.lit(True))
    joined = old.join(new, ["cluster_id", "sensor_id"], "full_outer")

    def merged(field: str, stored: str, kind: str):
        kept = F.col(stored)
        if field == "config_interval_s":
            kept = F.when(F.col("_known"), kept).otherwise(F.lit(DEFAULT_CONFIG_INTERVAL))
        setting = F.col(f"_{field}")
        return F.when(setting.isNotNull(), setting["to"].try_cast(kind)).otherwise(kept).alias(stored)

    stamp = F.when(F.col("_patched"), given_or_now(updated_at)).otherwise(F.col("updated_at"))
    fields = [merged(field, stored, kind) for field, (stored, kind) in PATCH_FIELDS.items()]
    return joined.select("cluster_id", "sensor_id", *fields, stamp.alias("updated_at"))
