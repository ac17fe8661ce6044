"""Risk model: training, prediction rows and evaluation."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import StringIndexer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession, functions as F

from gaugeflow.constants import FOREST, HORIZON_MINUTES, MODEL_NAME, MODEL_VERSION, NORMAL_CLASS
from gaugeflow.functions.risk import predicted_event, probabilities_json, risk_level, risk_score, risk_sentence
from gaugeflow.functions.times import given_or_now
from gaugeflow.operators.training import first_per_class


def train_risk_model(
    rows: DataFrame, features: Sequence[str], label: str = "target_class", **forest
) -> PipelineModel:
    """Random forest over the feature columns; classes in alphabetical order.

    The fit makes several passes, so the rows are kept (spilling to disk) while it runs.
    """
    stages = [
        StringIndexer(inputCol=label, outputCol="label_index", stringOrderType="alphabetAsc"),
        VectorAssembler(inputCols=list(features), outputCol="features"),
        RandomForestClassifier(
            featuresCol="features", labelCol="label_index", featureSubsetStrategy="sqrt", **{**FOREST, **forest}
        ),
    ]
    kept = rows.select(label, *features).persist()
    try:
        return Pipeline(stages=stages).fit(kept)
    finally:
        kept.unpersist()


def model_labels(model: PipelineModel) -> list[str]:
    return list(model.stages[0].labels)


def class_probabilities(model: PipelineModel, rows: DataFrame) -> DataFrame:
    """``probabilities`` in label order and the winning ``prediction`` class."""
    scorer = PipelineModel(stages=list(model.stages[1:]))
    labels = F.array(*[F.lit(x) for x in model_labels(model)])
    scored = scorer.transform(rows)
    winner = F.get(labels, F.col("prediction").cast("int"))
    return scored.withColumns(
        {"probabilities": vector_to_array("probability"), "prediction": winner}
    ).drop("features", "rawPrediction", "probability")


def prediction_rows(
    scored: DataFrame,
    labels: Sequence[str],
    horizon: int = HORIZON_MINUTES,
    model_name: str | None = None,
    model_version: str | None = None,
    computed_at=None,
    keep: Sequence[str] = (),
) -> DataFrame:
    """History rows from ``location_id, prediction_time, probabilities``.

    The level is judged on the rounded score, the event on the unrounded probabilities.
    """
    share = {label: F.col("probabilities")[i] for i, label in enumerate(labels)}
    graded = scored.withColumn("risk_score", risk_score(share[NORMAL_CLASS])).withColumn(
        "risk_level", risk_level(F.col("risk_score"))
    )
    named = graded.withColumns(
        {
            "predicted_event_type": predicted_event(F.col("risk_level"), share),
            "forecast_horizon_minutes": F.lit(horizon),
        }
    )
    return named.select(
        *keep,
        "location_id",
        F.to_date("prediction_time").alias("prediction_date"),
        "prediction_time",
        "forecast_horizon_minutes",
        "risk_score",
        "risk_level",
        "predicted_event_type",
        probabilities_json(labels, share).alias("class_probabilities"),
        risk_sentence(F.col("risk_level"), F.col("predicted_event_type"), F.col("forecast_horizon_minutes")).alias(
            "explanation"
        ),
        F.lit(model_name or MODEL_NAME).alias("model_name"),
        F.lit(model_version or MODEL_VERSION).alias("model_version"),
        given_or_now(computed_at).alias("computed_at"),
    )


def predict_risk(model: PipelineModel, features: DataFrame, **options) -> DataFrame:
    return prediction_rows(class_probabilities(model, features), model_labels(model), **options)


def class_counts(judged: DataFrame, label: str, prediction: str) -> DataFrame:
    return judged.groupBy(F.col(label).alias("label"), F.col(prediction).alias("prediction")).agg(
        F.count("*").alias("rows")
    )


def classification_report(judged: DataFrame, label: str = "label", prediction: str = "prediction") -> DataFrame:
    """Precision, recall, F1 and support per class; an empty denominator gives 0."""
    counts = class_counts(judged, label, prediction)
    hit = F.when(F.col("label") == F.col("prediction"), F.col("rows")).otherwise(0)
    sides = counts.select(
        F.col("label").alias("class"), F.col("rows").alias("actual"), F.lit(0).alias("claimed"), hit.alias("hits")
    ).unionByName(
        counts.select(
            F.col("prediction").alias("class"), F.lit(0).alias("actual"), F.col("rows").alias("claimed"), F.lit(0).alias("hits")
        )
    )
    totals = sides.groupBy("class").agg(
        F.sum("actual").alias("support"), F.sum("claimed").alias("claimed"), F.sum("hits").alias("hits")
    )

    def share(part, whole):
        return F.coalesce(F.try_divide(part, whole), F.lit(0.0))

    return totals.select(
        "class",
        share(F.col("hits"), F.col("claimed")).alias("precision"),
        share(F.col("hits"), F.col("support")).alias("recall"),
        share(2 * F.col("hits"), F.col("claimed") + F.col("support")).alias("f1_score"),
        "support",
        "hits",
    )


def evaluation_summary(judged: DataFrame, label: str = "label", prediction: str = "prediction") -> DataFrame:
    """One row: accuracy and macro F1, four decimals."""
    report = classification_report(judged, label, prediction)
    return report.agg(
        F.sum("support").alias("test_rows"),
        F.round(F.sum("hits") / F.sum("support"), 4).alias("accuracy"),
        F.round(F.avg("f1_score"), 4).alias("macro_f1"),
    )


def confusion_matrix(
    judged: DataFrame, labels: Sequence[str], label: str = "label", prediction: str = "prediction"
) -> DataFrame:
    counts = class_counts(judged, label, prediction)
    cells = [
        F.coalesce(F.sum(F.when(F.col("prediction") == x, F.col("rows"))), F.lit(0)).alias(f"predicted_{x}")
        for x in labels
    ]
    return counts.filter(F.col("label").isin(*labels)).groupBy("label").agg(*cells)


def feature_importances(model: PipelineModel, features: Sequence[str], top: int = 20) -> DataFrame:
    """The ``top`` features; one row per model feature, so small by construction."""
    weights = model.stages[-1].featureImportances.toArray()
    pairs = [(name, float(w)) for name, w in zip(features, weights)]
    frame = SparkSession.active().createDataFrame(pairs, "feature string, importance double")
    return frame.orderBy(F.col("importance").desc(), "feature").limit(top).withColumn(
        "importance", F.round("importance", 6)
    )


def example_predictions(
    predicted: DataFrame, label: str = "target_class", order: Sequence[str] = ("run_id", "minute")
) -> DataFrame:
    """First test row of each class with its prediction."""
    return first_per_class(predicted, label, order).withColumnRenamed(label, "expected_class")
