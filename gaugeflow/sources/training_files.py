"""Training rows as CSV with a header; model, feature schema and report."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from gaugeflow.constants import HORIZON_MINUTES, MODEL_NAME, MODEL_VERSION, RISK_BANDS

MODEL_TYPE = "RandomForestClassifier"


def training_schema(features: Sequence[str]) -> T.StructType:
    fields = [T.StructField("run_id", T.StringType()), T.StructField("scenario", T.StringType())]
    fields += [T.StructField("minute", T.LongType())]
    fields += [T.StructField(name, T.DoubleType()) for name in features]
    return T.StructType([*fields, T.StructField("target_class", T.StringType())])


def write_training_csv(rows: DataFrame, features: Sequence[str], path: str) -> None:
    columns = training_schema(features).names
    rows.select(*columns).write.mode("overwrite").option("header", True).csv(path)


def read_training_csv(spark: SparkSession, features: Sequence[str], path: str) -> DataFrame:
    return spark.read.schema(training_schema(features)).option("header", True).csv(path)


def save_model(
    model: PipelineModel, features: Sequence[str], parameters: Sequence[str], labels: Sequence[str], path: str,
    window_minutes: int = 5,
) -> None:
    """Model under ``path/model``, its feature schema as one JSON row under ``path/feature_schema``."""
    model.write().overwrite().save(f"{path}/model")
    bands = F.array(*[F.struct(F.lit(n).alias("level"), F.lit(a).alias("min"), F.lit(b).alias("max")) for n, a, b in RISK_BANDS])

    def texts(items: Sequence[str]):
        return F.array(*[F.lit(x) for x in items])

    schema = SparkSession.active().range(1).select(
        F.lit(MODEL_NAME).alias("model_name"),
        F.lit(MODEL_VERSION).alias("model_version"),
        F.lit(MODEL_TYPE).alias("model_type"),
        F.lit("target_class").alias("target"),
        F.lit(window_minutes).alias("window_minutes"),
        F.lit(HORIZON_MINUTES).alias("forecast_horizon_minutes"),
        texts(parameters).alias("parameters"),
        texts(features).alias("feature_columns"),
        bands.alias("risk_levels"),
        texts(labels).alias("scenario_classes"),
    )
    schema.coalesce(1).write.mode("overwrite").json(f"{path}/feature_schema")


def load_model(path: str) -> PipelineModel:
    return PipelineModel.load(f"{path}/model")


def save_report(report: dict[str, DataFrame], path: str) -> None:
    """Each part of the evaluation report as JSON lines; all parts are per class or per feature."""
    for name, part in report.items():
        part.coalesce(1).write.mode("overwrite").json(f"{path}/{name}")


def report_markdown(per_class: DataFrame, importances: DataFrame) -> DataFrame:
    """The two report tables as Markdown lines (column ``value``), ready for a text sink."""
    classes = per_class.select(
        F.format_string("| %s | %.4f | %.4f | %.4f | %d |", "class", "precision", "recall", "f1_score", "support").alias("value"),
        F.lit(1).alias("block"),
        F.lit(0.0).alias("rank"),
        F.col("class").alias("name"),
    )
    features = importances.select(
        F.format_string("| %s | %.6f |", "feature", "importance").alias("value"),
        F.lit(3).alias("block"),
        (-F.col("importance")).alias("rank"),
        F.col("feature").alias("name"),
    )
    heads = classes.sparkSession.createDataFrame(
        [
            ("| Class | Precision | Recall | F1 | Support |\n| --- | ---: | ---: | ---: | ---: |", 0, 0.0, ""),
            ("\n| Feature | Importance |\n| --- | ---: |", 2, 0.0, ""),
        ],
        classes.schema,
    )
    lines = heads.unionByName(classes).unionByName(features)
    return lines.orderBy("block", "rank", "name").select("value")
