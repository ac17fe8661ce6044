import math
import statistics

import pytest
from pyspark.sql import functions as F

from gaugeflow.constants import PARAMETERS, SCENARIO_CLASSES
from gaugeflow.functions.risk import parse_probabilities, risk_level
from gaugeflow.operators import features, model, training
from gaugeflow.sources import training_files

KINDS = {"pH": ("S000", 7.0), "temperature": ("S001", 20.0), "turbidity": ("S002", 5.0), "conductivity": ("S003", 300.0), "dissolved_oxygen": ("S004", 4.0), "ORP": ("S005", 50.0)}
AT = "2026-06-07T12:05:00Z"


def readings(enrich, cluster="C3", skip=None):
    rows = []
    for kind, (local, base) in KINDS.items():
        for minute in (0, 2, 5):
            if not (kind == skip and minute > 0):
                rows.append((cluster + local, kind, base + minute, f"2026-06-07T12:0{minute}:00Z"))
    return enrich(rows)


def test_published_feature_order():
    names = features.feature_columns()
    assert len(names) == 5 * len(PARAMETERS) + 4 == 34
    assert names[:6] == ["ph_latest", "ph_mean_5m", "ph_std_5m", "ph_slope_5m", "ph_threshold_distance", "temperature_latest"]
    assert names[-4:] == ["warning_count_5m", "critical_count_5m", "max_threshold_distance", "avg_threshold_distance"]


def test_features_of_one_moment(enrich):
    row = features.features_at(readings(enrich), AT).first()
    assert row.location_id == "C3"
    assert row.ph_latest == 12.0 and row.ph_mean_5m == pytest.approx(28 / 3)
    assert row.ph_std_5m == pytest.approx(statistics.stdev([7, 9, 12])) and row.ph_slope_5m == 1.0
    # latest pH 12 and ORP 55 are critical, dissolved oxygen 9 is normal, turbidity 10 sits on its bound
    assert (row.critical_count_5m, row.warning_count_5m) == (2.0, 0.0)
    assert row.ph_threshold_distance == 1.0 and row.max_threshold_distance == 1.0
    assert row.avg_threshold_distance == pytest.approx(2 / 6)


def test_incomplete_location_has_no_row(enrich):
    assert features.features_at(readings(enrich, skip="ORP"), AT).count() == 0
    assert features.features_at(readings(enrich), AT, window="4 minutes").count() == 1
    assert features.features_at(readings(enrich), AT, window="2 minutes").count() == 0


def test_window_form_agrees_with_moment_form(enrich):
    rows = readings(enrich)
    wide = features.window_features(rows, window="6 minutes", slide="1 minute")
    moment = features.features_at(rows, "2026-06-07T12:05:59.999Z", window="6 minutes").drop("prediction_time")
    same = wide.filter("prediction_time = TIMESTAMP '2026-06-07T12:06:00Z'").drop("prediction_time")
    assert same.collect() == moment.collect()


@pytest.mark.parametrize("score, level", [(0.3499, "LOW"), (0.35, "MEDIUM"), (0.6, "HIGH"), (0.85, "CRITICAL"), (1.0, "CRITICAL"), (1.5, "CRITICAL")])
def test_risk_bands(spark, score, level):
    assert spark.range(1).select(risk_level(F.lit(score)).alias("l")).first().l == level


def scored(spark, *shares):
    return spark.createDataFrame([("C3", list(p)) for p in shares], "location_id string, probabilities array<double>").withColumn(
        "prediction_time", F.lit(AT).cast("timestamp")
    )


def test_prediction_rows(spark):
    labels = ["chemical_shift", "normal", "storm_runoff"]
    low, high, tie = model.prediction_rows(scored(spark, (0.1, 0.7, 0.2), (0.2, 0.3, 0.5), (0.3, 0.4, 0.3)), labels, computed_at=AT).collect()
    assert (low.risk_score, low.risk_level, low.predicted_event_type) == (0.3, "LOW", "none")
    assert (high.risk_level, high.predicted_event_type) == ("HIGH", "storm_runoff")
    assert high.explanation == "Model predicts high risk of storm runoff within the next 10 minutes."
    assert high.class_probabilities == '{"chemical_shift":0.2,"normal":0.3,"storm_runoff":0.5}'
    assert tie.predicted_event_type == "chemical_shift"
    assert (low.model_name, low.model_version) == ("early_warning_random_forest", "synthetic-rf-v1")


def test_probability_parse(spark):
    texts = spark.createDataFrame([('{"normal":0.4}',), ("[1]",), ("oops",), (None,), ("",)], "t string")
    assert [r.p for r in texts.select(parse_probabilities(F.col("t")).alias("p")).collect()] == [{"normal": 0.4}, {}, {}, {}, {}]


def test_split_by_run_takes_every_fifth_sorted_run(spark):
    rows = spark.createDataFrame([(f"run_{i:03d}", m) for i in range(23) for m in range(3)], "run_id string, minute int").repartition(7)
    train, test = training.split_by_run(rows)
    held = sorted({r.run_id for r in test.collect()})
    assert held == [f"run_{i:03d}" for i in range(0, 23, 5)]
    assert train.count() + test.count() == rows.count()


def samples(spark, runs=6):
    rows = []
    for run in range(runs):
        scenario = SCENARIO_CLASSES[run % 2]
        for minute in range(30):
            for kind, (_, base) in KINDS.items():
                drift = 3.0 * max(0, minute - 12) if scenario != "normal" and kind == "turbidity" else 0.0
                rows.append((f"{scenario}_{run:03d}", scenario, minute, kind, base + drift + math.sin(minute * (run + 1) + len(kind))))
    return spark.createDataFrame(rows, "run_id string, scenario string, minute long, parameter string, value double")


@pytest.fixture
def rows(spark, seed_rules):
    wide = training.training_windows(samples(spark), seed_rules)
    return wide.withColumn("target_class", training.horizon_class(F.col("scenario"), F.col("minute"), F.lit(20)))


def test_training_windows_start_after_warm_up(rows, spark):
    assert rows.agg(F.min("minute"), F.max("minute"), F.count("*")).first() == (5, 29, 6 * 25)
    values = {r.minute: r.value for r in samples(spark).filter("run_id = 'normal_000' AND parameter = 'pH'").collect()}
    row = rows.filter("run_id = 'normal_000' AND minute = 9").first()
    last = [values[m] for m in range(5, 10)]
    assert row.ph_mean_5m == pytest.approx(statistics.mean(last)) and row.ph_std_5m == pytest.approx(statistics.stdev(last))
    assert row.ph_slope_5m == pytest.approx((last[-1] - last[0]) / 4)
    assert {r.target_class for r in rows.filter("scenario <> 'normal' AND minute >= 10").collect()} == {"storm_runoff"}
    assert {r.target_class for r in rows.filter("minute < 10").collect()} == {"normal"}


def test_train_predict_evaluate_store(rows, spark, tmp_path):
    names = features.feature_columns()
    training_files.write_training_csv(rows, names, f"{tmp_path}/csv")
    stored = training_files.read_training_csv(spark, names, f"{tmp_path}/csv")
    assert stored.count() == rows.count()
    train, test = training.split_by_run(stored, every=3)
    fitted = model.train_risk_model(train, names, numTrees=10, maxDepth=4, minInstancesPerNode=2)
    training_files.save_model(fitted, names, PARAMETERS, model.model_labels(fitted), f"{tmp_path}/model")
    again = training_files.load_model(f"{tmp_path}/model")
    judged = model.class_probabilities(again, test).select("run_id", "minute", "target_class", "prediction", "probabilities")
    summary = model.evaluation_summary(judged, "target_class").first()
    majority = max(r["count"] for r in test.groupBy("target_class").count().collect()) / test.count()
    assert summary.accuracy > majority and summary.test_rows == test.count()
    report = model.classification_report(judged, "target_class")
    importance = model.feature_importances(again, names)
    assert importance.count() == 20 and importance.first().importance > 0
    training_files.save_report({"per_class": report, "importances": importance}, f"{tmp_path}/report")
    text = "\n".join(r.value for r in training_files.report_markdown(report, importance).collect())
    assert "| normal | " in text and text.index("| Class |") < text.index("| Feature |")
    assert model.example_predictions(judged).count() == 2
    predicted = model.predict_risk(again, features_for(rows), computed_at=AT)
    assert predicted.count() == rows.count() and predicted.filter("risk_score < 0 OR risk_score > 1").count() == 0


def features_for(rows):
    return rows.withColumn("location_id", F.col("run_id")).withColumn("prediction_time", F.lit(AT).cast("timestamp"))


def test_report_against_hand_counts(spark):
    pairs = [("a", "a")] * 3 + [("a", "b")] + [("b", "b")] * 2 + [("c", "b")]
    judged = spark.createDataFrame(pairs, "label string, prediction string")
    got = {r["class"]: (r.precision, r.recall, round(r.f1_score, 4), r.support) for r in model.classification_report(judged).collect()}
    assert got == {"a": (1.0, 0.75, 0.8571, 4), "b": (0.5, 1.0, 0.6667, 2), "c": (0.0, 0.0, 0.0, 1)}
    matrix = {r.label: (r.predicted_a, r.predicted_b, r.predicted_c) for r in model.confusion_matrix(judged, ["a", "b", "c"]).collect()}
    assert matrix == {"a": (3, 1, 0), "b": (0, 2, 0), "c": (0, 1, 0)}
    summary = model.evaluation_summary(judged).first()
    assert (summary.accuracy, summary.macro_f1) == (0.7143, 0.5079)


def test_nodes_of_a_forest_give_its_numbers(spark):
    import random

    from gaugeflow.operators import forest, model

    rng = random.Random(2)
    rows = [(i, rng.random(), rng.choice([0.0, 1.0, 2.5]), 4.0) for i in range(400)]
    labelled = [(i, "high" if x + y > 2 else "low" if rng.random() < 0.8 else "normal", x, y, z) for i, x, y, z in rows]
    table = spark.createDataFrame(labelled, "id int, target_class string, x double, y double, z double")
    names = ["x", "y", "z"]
    fitted = model.train_risk_model(table, names, numTrees=7, maxDepth=4, minInstancesPerNode=1)
    nodes = forest.forest_nodes(spark, fitted)
    walked = {r["id"]: r["walked"] for r in forest.walk_forest(table, nodes, ["id"], names, 3, 7, 4).collect()}
    assert len(walked) == 400
    for r in model.class_probabilities(fitted, table).collect():
        assert walked[r["id"]] == pytest.approx(r["probabilities"], abs=1e-12)
    found = {r["feature"]: r["importance"] for r in forest.node_importances(nodes, names).collect()}
    weights = fitted.stages[-1].featureImportances.toArray()
    assert [found.get(n, 0.0) for n in names] == pytest.approx(list(weights), abs=1e-12)
    assert "z" not in found
