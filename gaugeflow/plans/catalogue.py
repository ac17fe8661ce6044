"""Registered queries: every operator over the whole given tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window, functions as F, types as T

from gaugeflow.functions import rules as rule_fns
from gaugeflow.functions.risk import parse_probabilities
from gaugeflow.functions.times import MICROS_PATTERN, MILLIS_PATTERN, SECONDS_PATTERN, iso_millis, parse_event_time
from gaugeflow.operators import aggregates, alarms, configs, features, forest, ingest, latest, model, topics, training
from gaugeflow.operators.alerts import alert_messages, derive_alerts, wire_view
from gaugeflow.operators.cooldown import apply_cooldown
from gaugeflow.operators.enrich import known_sensors, sensor_metadata, unknown_sensors
from gaugeflow.operators.notifications import render_notifications
from gaugeflow.operators.scoring import score_anomalies
from gaugeflow.plans import reads
from gaugeflow.plans.stations import ORDER, OUTCOMES, PARAMETERS, Stations, readings_from
from gaugeflow.session import prepare, scratch_dir
from gaugeflow.sources import tables
from gaugeflow.sources.training_files import load_model, read_training_csv, save_model, write_training_csv
from gaugeflow.sources.readings import read_readings_stream
from gaugeflow.streaming import aggregates as stream_aggregates, runtime, stateful

Query = Callable[[Stations], DataFrame]
QUERIES: dict[str, Query] = {}

AS_OF = "2024-01-20 00:00:00"
OVERVIEW_AS_OF = "2024-01-10 12:00:00"
EXPIRY_AS_OF = "2024-04-15 00:00:00"
LONG_COOLDOWN = 3 * 86_400
FEATURE_SPAN = "12 hours"
RISK_FEATURES = features.feature_columns(PARAMETERS, "6h")


def query(fn: Query) -> Query:
    QUERIES[fn.__name__] = fn
    return fn


def shown(df: DataFrame) -> DataFrame:
    """Comparable output: times and dates as text, doubles to six decimals."""
    columns = []
    for field in df.schema:
        column = F.col(f"`{field.name}`")
        if isinstance(field.dataType, (T.TimestampType, T.TimestampNTZType)):
            column = F.date_format(column, "yyyy-MM-dd HH:mm:ss.SSSSSS")
        elif isinstance(field.dataType, T.DateType):
            column = column.cast("string")
        elif isinstance(field.dataType, T.DoubleType):
            column = aggregates.steady_round(column, 6)
        elif isinstance(field.dataType, T.IntegerType):
            column = column.cast("long")
        columns.append(column.alias(field.name))
    return df.select(*columns)


def registered() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    def bind(fn: Query):
        return lambda spark, sf_dir: shown(fn(Stations(prepare(spark), sf_dir)))

    return {name: bind(fn) for name, fn in QUERIES.items()}


# --- ingest ----------------------------------------------------------------------------------


def raw_messages(s: Stations) -> DataFrame:
    """JSON messages of the event stream, some damaged in the ways real ones are."""
    moment = F.col("event_time")
    stamp = (
        F.when(F.col("k") < 50, F.date_format(moment, SECONDS_PATTERN))
        .when(F.col("k") < 75, F.date_format(moment, MILLIS_PATTERN))
        .otherwise(F.date_format(moment, MICROS_PATTERN))
    )
    stamp = F.when(F.col("k").between(12, 15), F.lit("garbage")).otherwise(stamp)
    number = (
        F.when(F.col("k").between(4, 7), F.lit("null"))
        .when(F.col("k").between(8, 11), F.lit('"x"'))
        .when(F.col("k").between(20, 23), F.lit("NaN"))
        .otherwise(F.col("value").cast("string"))
    )
    kind = F.when(F.col("k").between(16, 19), F.lit("")).otherwise(
        F.concat(F.lit('"sensor_type":"'), F.col("sensor_type"), F.lit('",'))
    )
    body = F.concat(
        F.lit('{"sensor_id":"'), F.col("sensor_id"), F.lit('",'), kind,
        F.lit('"value":'), number, F.lit(',"timestamp":"'), stamp, F.lit('"}'),
    )
    text = F.when(F.col("k") < 4, F.lit("not json")).otherwise(body)
    return s.readings().select("reading_id", text.cast("binary").alias("value"))


def parsed(s: Stations) -> DataFrame:
    return ingest.parse_messages(raw_messages(s), keep=("reading_id",))


@query
def valid_readings(s):
    return ingest.valid_readings(parsed(s)).drop("timestamp")


@query
def rejected_messages(s):
    _, rejected = ingest.split_valid(parsed(s))
    return rejected.select("reading_id", "sensor_id", "sensor_type", F.nanvl("value", F.lit(None)).alias("value"), "event_time")


@query
def timestamp_formats(s):
    moment, k = F.col("event_time"), F.col("k")
    text = (
        F.when(k < 25, F.date_format(moment, "yyyy-MM-dd HH:mm:ss"))
        .when(k < 50, F.date_format(moment, SECONDS_PATTERN))
        .when(k < 75, F.date_format(moment, MILLIS_PATTERN))
        .when(k < 95, F.date_format(moment, MICROS_PATTERN))
        .otherwise(F.concat(F.lit("at "), F.date_format(moment, SECONDS_PATTERN)))
    )
    parsed_time = parse_event_time(F.col("text"))
    return s.readings().select("reading_id", text.alias("text")).select(
        "reading_id", parsed_time.alias("event_time"), iso_millis(parsed_time).alias("iso")
    )


@query
def stamped_messages(s):
    """Ingest stamp, then the consumer's parse of it."""
    stamped = ingest.stamp_messages(s.readings(), F.col("arrived_at"))
    return ingest.valid_readings(ingest.parse_messages(stamped, keep=("key",)))


# --- enrichment and alerts -------------------------------------------------------------------


@query
def enriched_readings(s):
    return s.enriched()


@query
def unknown_sensor_readings(s):
    return unknown_sensors(s.readings(), sensor_metadata(s.configs())).select("reading_id", "sensor_id", "value")


@query
def known_sensor_readings(s):
    return known_sensors(s.readings(), sensor_metadata(s.configs())).select("reading_id", "sensor_id", "value")


ALERT_VIEW = (
    "alert_id", "sensor_id", "cluster_id", "local_sensor_id", "parameter", "value", "unit", "alert_type", "severity",
    "threshold_low", "threshold_high", "alarm_state", "message", "explanation", "event_time", "processed_at",
)


@query
def alerts(s):
    return s.alerts().select(*ALERT_VIEW)


@query
def alert_counts(s):
    return s.alerts().groupBy("cluster_id", "alert_type", "severity").agg(
        F.count("*").alias("alerts"), F.max("value").alias("max_value")
    )


@query
def alert_topic(s):
    """Alerts encoded for the topic and decoded again by the consumer."""
    return ingest.decode_alerts(alert_messages(s.alerts()))


@query
def alert_cooldown(s):
    return apply_cooldown(s.alerts().select("sensor_id", "alert_type", "event_time", "alert_id", "value"), LONG_COOLDOWN)


@query
def alert_cooldown_zero(s):
    """Without a cooldown nothing is held back."""
    return apply_cooldown(s.alerts().select("sensor_id", "alert_type", "event_time", "alert_id", "value"), 0)


@query
def alert_cooldown_split(s):
    """The same with every key cut into short chunks, as happens to hot keys."""
    narrow = s.alerts().select("sensor_id", "alert_type", "event_time", "alert_id", "value")
    return apply_cooldown(narrow, LONG_COOLDOWN, chunk="1 hour")


@query
def notifications(s):
    return render_notifications(wire_view(s.alerts()))


# --- scores ----------------------------------------------------------------------------------

SCORE_VIEW = (
    "reading_id", "sensor_id", "event_time", "value", "rolling_average", "rolling_stddev", "z_score",
    "rate_of_change", "threshold_component", "statistical_component", "rate_component", "anomaly_score",
    "anomaly_level", "explanation",
)


STORED_SCORE_VIEW = tuple(c for c in SCORE_VIEW if c != "reading_id")


@query
def anomaly_scores(s):
    return s.scored().select(*SCORE_VIEW)


@query
def anomaly_scores_past_rows(s):
    """Eleven rows before the current one, which lets the statistical branches fire."""
    scored = score_anomalies(
        s.enriched(), computed_at=F.col("ingestion_time"), window_rows=11, include_current=False, order=ORDER
    )
    return scored.select(*SCORE_VIEW)


@query
def anomaly_levels(s):
    return s.scored().groupBy("cluster_id", "anomaly_level", "explanation").agg(F.count("*").alias("readings"))


@query
def latest_readings(s):
    return latest.latest_readings(s.enriched(), ("reading_id",)).select(
        "cluster_id", "parameter", "sensor_id", "local_sensor_id", "event_time", "value", "unit", "quality_status", "updated_at"
    )


@query
def latest_scores(s):
    return latest.latest_scores(s.scored(), ("reading_id",)).select(
        "cluster_id", "parameter", "sensor_id", "event_time", "value", "anomaly_score", "anomaly_level",
        "rolling_average", "z_score", "rate_of_change", "explanation", "updated_at",
    )


@query
def dedup_readings(s):
    """Last arrival per sensor and (day-rounded) event time."""
    daily = s.readings().withColumn("event_time", F.date_trunc("day", "event_time"))
    return latest.dedup_readings(daily, ["arrived_at", "reading_id"])


@query
def retained_readings(s):
    return latest.retain(s.readings(), "event_time", 10 * 86_400, AS_OF).select("reading_id", "event_time")


# --- aggregates ------------------------------------------------------------------------------


@query
def hourly_aggregates(s):
    return aggregates.hourly_aggregates(s.enriched(), tie="reading_id").drop("updated_at")


@query
def daily_aggregates(s):
    return aggregates.daily_aggregates(s.enriched(), tie="reading_id").drop("updated_at")


def metrics(s: Stations) -> DataFrame:
    return aggregates.pipeline_metrics(s.scored())


@query
def pipeline_metrics(s):
    return metrics(s)


@query
def latest_minute_rollup(s):
    return aggregates.latest_minute_rollup(metrics(s))


@query
def performance_rollup(s):
    return aggregates.minute_rollup(metrics(s))


@query
def parameter_averages(s):
    return aggregates.parameter_averages(latest.latest_readings(s.enriched(), ("reading_id",)), s.rules())


@query
def system_status(s):
    scores = latest.latest_scores(s.scored(), ("reading_id",))
    return alarms.system_status(s.alerts(), scores, AS_OF, "1 day")


@query
def overview_counts(s):
    newest = latest.latest_readings(s.enriched(), ("reading_id",))
    return alarms.overview_counts(s.configs(), s.alerts(), newest, AS_OF, "1 day", ("click", "error"))


@query
def named_averages(s):
    newest = latest.latest_readings(s.enriched(), ("reading_id",))
    return alarms.named_average(newest, "click")


@query
def alarm_groups(s):
    return alarms.group_alarms(s.alerts(), AS_OF, "1 day")


# --- pages -----------------------------------------------------------------------------------

PAGE_SENSOR = "C3S8_error"
PAGE_DAY = "2024-01-01"


@query
def sensors_page(s):
    return reads.list_sensors(s.configs(), "C1")


@query
def latest_readings_page(s):
    newest = latest.latest_readings(s.enriched(), ("reading_id",))
    return reads.list_latest(newest, "C2").select("sensor_id", "event_time", "value", "quality_status")


@query
def readings_page(s):
    page = reads.readings_page(s.enriched(), s.configs(), PAGE_SENSOR, day=PAGE_DAY)
    return page.select("sensor_id", "event_time", "value", "quality_status")


@query
def first_sensor_readings(s):
    """Without a sensor, the first registered one of the cluster is shown."""
    chosen = reads.of_sensor(s.enriched(), s.configs(), None, "C2")
    return reads.newest_page(chosen, 5, "event_time").select("sensor_id", "event_time", "value")


@query
def alerts_page(s):
    page = reads.alerts_page(s.alerts(), cluster_id="C2", day="2024-01-05", severity="WARNING", limit=200)
    return page.select("alert_id", "sensor_id", "event_time", "severity")


@query
def recent_alerts(s):
    return reads.recent_alerts(s.alerts(), AS_OF, quiet="1 day").select("alert_id", "sensor_id", "event_time")


@query
def alarms_page(s):
    return reads.alarms(s.alerts(), day="2024-01-05", as_of="2024-01-06 00:00:00")


@query
def insights_page(s):
    page = reads.insights_page(s.scored(), s.configs(), PAGE_SENSOR, day=PAGE_DAY, limit=120)
    return page.select("sensor_id", "event_time", "anomaly_score", "anomaly_level")


@query
def insights_by_level(s):
    """Limit first, then level: of the newest 500 scores, those at WATCH."""
    newest = reads.newest_page(s.scored(), 500, *ORDER)
    return reads.matching(newest, anomaly_level="WATCH").select("reading_id", "anomaly_score")


@query
def performance_page(s):
    return reads.performance_page(metrics(s), day="2024-01-03", limit=120)


@query
def cluster_performance_page(s):
    page = reads.performance_page(metrics(s), cluster_id="C1", day="2024-01-03", limit=50)
    return page.select("cluster_id", "minute_start", "processed_reading_count", "alert_count", "avg_anomaly_score")


# --- registry --------------------------------------------------------------------------------


@query
def cluster_ids(s):
    return configs.cluster_ids(s.clusters(), s.configs())


@query
def known_clusters(s):
    seen = s.readings().select(F.substring("sensor_id", 1, 2).alias("cluster_id"), "reading_id")
    return configs.known_clusters(seen, s.clusters())


@query
def config_dump(s):
    return configs.dump_configs(s.clusters(), s.configs())


@query
def config_patch(s):
    """Every event patches the registry entry of its sensor; unknown sensors are added."""
    k = F.col("k")
    no_text = F.lit(None).cast("string")

    def one(name, value):
        return F.create_map(F.lit(name), value)

    def two(a, x, b, y):
        return F.create_map(F.lit(a), x, F.lit(b), y)

    patch = (
        F.when(k < 20, one("min", F.col("value").cast("string")))
        .when(k < 40, two("max", F.col("value").cast("string"), "unit", no_text))
        .when(k < 60, two("unit", F.concat(F.lit("u"), k.cast("string")), "measure_interval_s", k.cast("string")))
        .when(k < 80, one("config_interval_s", k.cast("string")))
        .when(k < 90, one("type", F.col("sensor_type")))
        .otherwise(F.from_json(F.lit("{}"), "map<string,string>"))
    )
    patches = s.readings().select(
        F.substring("sensor_id", 1, 2).alias("cluster_id"),
        F.expr("substring(sensor_id, 3)").alias("sensor_id"),
        patch.alias("patch"),
        "reading_id",
    )
    return configs.merge_configs(s.configs(), patches, updated_at=AS_OF, order="reading_id")


@query
def sensor_refs(s):
    station, k = F.col("user_id"), F.get_json_object("props", "$.k").cast("int")
    padded = F.format_string("%03d", station)
    ref = (
        F.when(k < 50, F.concat(F.lit("C"), (station % 3 + 1).cast("string"), F.lit("S"), padded))
        .when(k < 70, F.concat(F.lit(" c"), (station % 3 + 1).cast("string"), F.lit("s"), padded, F.lit(" ")))
        .when(k < 90, padded)
        .otherwise(F.concat(F.lit("S"), padded))
    )
    return configs.sensor_references(s.table("events").select("event_id", ref.alias("ref")))


@query
def clamped_values(s):
    ranged = s.readings().join(
        s.configs().select(
            F.concat("cluster_id", "sensor_id").alias("sensor_id"), "min_value", "max_value"
        ),
        "sensor_id",
    )
    return ranged.select(
        "reading_id", rule_fns.clamp(F.col("value"), F.col("min_value"), F.col("max_value")).alias("clamped")
    )


# --- features, labels, risk ------------------------------------------------------------------


@query
def value_states(s):
    return s.enriched().select(
        "reading_id", rule_fns.value_state().alias("state"), rule_fns.capped_distance().alias("distance")
    )


@query
def window_features(s):
    return features.window_features(s.enriched(), PARAMETERS, FEATURE_SPAN, suffix="12h", tie="reading_id")


@query
def sliding_features(s):
    return features.window_features(s.enriched(), PARAMETERS, FEATURE_SPAN, slide="4 hours", suffix="12h", tie="reading_id")


@query
def features_at(s):
    return features.features_at(s.enriched(), AS_OF, PARAMETERS, "24 hours", suffix="24h", tie="reading_id")


@query
def active_locations(s):
    return features.active_locations(s.enriched(), AS_OF, "1 hour")


@query
def trailing_measures(s):
    narrow = s.enriched().select("reading_id", "cluster_id", "parameter", "event_time", "value")
    trailing = features.trailing_measures(narrow, FEATURE_SPAN, tie="reading_id")
    return trailing.select("reading_id", "n", "mean", "std", "slope")


@query
def training_windows(s):
    return _training_rows(s)


def _training_rows(s: Stations) -> DataFrame:
    samples = s.hourly_samples()
    rows = training.training_windows(samples, s.rules(), PARAMETERS, suffix="5h")
    starts = samples.select("run_id", "event_start").distinct()
    label = training.horizon_class(F.col("scenario"), F.col("minute"), F.col("event_start"), 3)
    return rows.join(starts, "run_id").withColumn("target_class", label).drop("event_start")


@query
def horizon_labels(s):
    rows = s.enriched().select(
        "reading_id", "sensor_id", F.unix_micros("event_time").alias("at"), rule_fns.critical_breach().cast("int").alias("state")
    )
    day = 86_400 * 1_000_000
    return training.horizon_labels(rows, ["sensor_id"], "at", "state", 5 * day).select("reading_id", "label")


@query
def run_split(s):
    runs = s.enriched().select(F.concat_ws("-", "cluster_id", F.col("bucket_date").cast("string")).alias("run_id"), "value")
    train, test = training.split_by_run(runs)
    both = train.withColumn("part", F.lit("train")).unionByName(test.withColumn("part", F.lit("test")))
    return both.groupBy("run_id", "part").agg(F.count("*").alias("rows"))


@query
def first_per_class(s):
    rows = s.enriched().select("quality_status", "reading_id", "event_time", "value")
    return training.first_per_class(rows, "quality_status", ORDER)


@query
def training_files(s):
    """Training rows written as CSV with a header and read back under the declared schema."""
    names = features.feature_columns(PARAMETERS, "5h")
    path = scratch_dir(s.spark, "training-csv")
    write_training_csv(_training_rows(s), names, path)
    return read_training_csv(s.spark, names, path)


def predictions(s: Stations) -> DataFrame:
    return model.prediction_rows(s.outcome_shares(), OUTCOMES, computed_at=F.col("prediction_time"))


PREDICTION_VIEW = (
    "location_id", "prediction_date", "prediction_time", "risk_score", "risk_level", "predicted_event_type", "explanation"
)


def _opened(df: DataFrame) -> DataFrame:
    shares = [F.col("class_probabilities")[o].alias(f"p_{o}") for o in OUTCOMES]
    return df.select(*PREDICTION_VIEW, *shares)


@query
def risk_predictions(s):
    parsed_shares = parse_probabilities(F.col("class_probabilities"))
    return _opened(predictions(s).withColumn("class_probabilities", parsed_shares))


@query
def risk_bands(s):
    return predictions(s).groupBy("risk_level", "predicted_event_type").agg(
        F.count("*").alias("predictions"), F.max("risk_score").alias("max_score")
    )


@query
def predictions_page(s):
    return _opened(reads.predictions_page(predictions(s), day="2024-01-10"))


@query
def latest_prediction(s):
    newest = latest.latest_per_key(predictions(s), ["location_id"], ["prediction_time"])
    return _opened(reads.latest_prediction(newest, "C3"))


@query
def probability_texts(s):
    """Event properties as probability maps; damaged or non-object JSON gives the empty map."""
    k = F.col("k")
    text = (
        F.when(k < 10, F.lit(None))
        .when(k < 20, F.lit("oops"))
        .when(k < 30, F.lit("[0.5]"))
        .otherwise(F.concat(F.lit('{"normal":'), (k / 100).cast("string"), F.lit("}")))
    )
    mapped = s.readings().select("reading_id", parse_probabilities(text).alias("p"))
    return mapped.select("reading_id", F.size("p").alias("entries"), F.col("p")["normal"].alias("normal"))


def judged(s: Stations) -> DataFrame:
    """State of the value against the state of the recent mean, as a naive predictor."""
    return s.scored().select(
        rule_fns.value_state("value").alias("label"), rule_fns.value_state("rolling_average").alias("prediction")
    )


@query
def classification_report(s):
    return model.classification_report(judged(s)).drop("hits")


@query
def evaluation_summary(s):
    return model.evaluation_summary(judged(s))


@query
def confusion_matrix(s):
    return model.confusion_matrix(judged(s), ["normal", "warning", "critical"])


def _risk_rows(s: Stations) -> DataFrame:
    """Window features labelled with the next window's outcome: critical readings or not."""
    rows = features.window_features(s.enriched(), PARAMETERS, "6 hours", suffix="6h", min_readings=1, tie="reading_id")
    coming = F.lead(F.struct("prediction_time", "max_threshold_distance")).over(Window.partitionBy("location_id").orderBy("prediction_time"))
    follows = F.col("_coming.prediction_time") == F.col("prediction_time") + F.expr("INTERVAL 6 HOURS")
    labelled = rows.withColumn("_coming", coming).filter(follows)
    return labelled.withColumns(
        {
            "target_class": F.when(F.col("_coming.max_threshold_distance") > 0, "degraded").otherwise("normal"),
            "run_id": F.concat_ws("-", "location_id", F.to_date("prediction_time").cast("string")),
        }
    ).drop("_coming")


def _fitted(s: Stations):
    rows = _risk_rows(s)
    train, test = training.split_by_run(rows)
    return model.train_risk_model(train, RISK_FEATURES), test


@query
def train_and_predict(s):
    fitted, test = _fitted(s)
    return model.predict_risk(fitted, test, computed_at=F.col("prediction_time"))


@query
def feature_importance(s):
    fitted, _ = _fitted(s)
    return model.feature_importances(fitted, RISK_FEATURES)


@query
def forest_check(s):
    """The fitted forest against its own table of nodes: probabilities and importances that differ."""
    fitted, test = _fitted(s)
    nodes, classifier, labels = forest.forest_nodes(s.spark, fitted), fitted.stages[-1], model.model_labels(fitted)
    keys = ["location_id", "prediction_time"]
    walked = forest.walk_forest(test, nodes, keys, RISK_FEATURES, len(labels), classifier.getNumTrees, classifier.getMaxDepth())
    both = model.class_probabilities(fitted, test).select(*keys, "probabilities").join(walked, keys, "full")
    far = F.exists(F.zip_with("probabilities", "walked", lambda a, b: F.abs(a - b)), lambda x: x > 1e-9)
    rows = both.agg(F.count_if(F.coalesce(far, F.lit(True))).alias("differing_rows"))
    weights = [(name, float(w)) for name, w in zip(RISK_FEATURES, classifier.featureImportances.toArray())]
    known = s.spark.createDataFrame(weights, "feature string, weight double")
    own = known.join(forest.node_importances(nodes, RISK_FEATURES), "feature", "left")
    apart = F.abs(F.col("weight") - F.coalesce("importance", F.lit(0.0))) > 1e-9
    counted = own.agg(F.count_if(apart).alias("differing_importances"))
    measures = rows.select(F.lit("rows").alias("of"), F.col("differing_rows").alias("differing"))
    return measures.unionByName(counted.select(F.lit("importances").alias("of"), F.col("differing_importances").alias("differing")))


@query
def overview(s):
    """All parts of the overview page as lines: part, name, text, number."""
    scored, newest = s.scored(), latest.latest_readings(s.enriched(), ("reading_id",))
    parts = reads.overview(
        s.configs(), newest, latest.latest_scores(scored, ("reading_id",)), s.alerts(), aggregates.pipeline_metrics(scored), s.rules(),
        latest.latest_per_key(predictions(s), ["location_id"], ["prediction_time"]), OVERVIEW_AS_OF, "6 hours", ("click", "error"),
    )
    nothing = F.lit(None).cast("string")
    counts = ("active_sensor_count", "active_alert_count", "average_click", "average_error")
    numbers = F.explode(F.array(*[F.struct(F.lit(c).alias("name"), F.col(c).cast("double").alias("number")) for c in counts]))
    shown_as = {
        "status": (F.lit("system_status"), F.col("system_status"), F.col("active_alert_count")),
        "parameter_averages": (F.col("display_name"), F.col("unit"), F.col("average_value")),
        "latest_metric": (F.lit("processed_reading_count"), F.date_format("minute_start", "yyyy-MM-dd HH:mm"), F.col("processed_reading_count")),
        "latest_readings": (F.col("sensor_id"), F.col("quality_status"), F.col("value")),
        "latest_ai": (F.col("sensor_id"), F.col("anomaly_level"), F.col("anomaly_score")),
        "latest_ml_prediction": (F.col("location_id"), F.col("risk_level"), F.col("risk_score")),
        "recent_alerts": (F.col("alert_id"), F.col("severity"), F.col("value")),
    }
    lines = parts["counts"].select(numbers.alias("n")).select(F.lit("counts").alias("part"), "n.name", nothing.alias("text"), "n.number")
    for part, (name, text, number) in shown_as.items():
        lines = lines.unionByName(parts[part].select(F.lit(part).alias("part"), name.alias("name"), text.alias("text"), number.cast("double").alias("number")))
    return lines


# --- tables and streams ----------------------------------------------------------------------


@query
def stored_readings(s):
    """Two overlapping upsert batches into the keyed table; the newer row of a key wins."""
    root = scratch_dir(s.spark, "tables")
    first = s.enriched()
    second = first.filter("quality_status = 'alert'").withColumns(
        {"quality_status": F.lit("reviewed"), "ingestion_time": F.col("ingestion_time") + F.expr("INTERVAL 1 HOUR")}
    )
    tables.append_batch(first, root, "readings_by_sensor_day", 0)
    tables.append_batch(second, root, "readings_by_sensor_day", 1)
    return tables.read_table(s.spark, root, "readings_by_sensor_day")


@query
def expired_readings(s):
    """The stored table compacted at a later moment: what has outlived its retention is gone."""
    root, target = scratch_dir(s.spark, "tables"), scratch_dir(s.spark, "compacted")
    tables.append_batch(s.enriched(), root, "readings_by_cluster_parameter_day", 0)
    tables.compact_table(s.spark, root, "readings_by_cluster_parameter_day", target, EXPIRY_AS_OF)
    return tables.read_table(s.spark, target, "readings_by_cluster_parameter_day")


@query
def merged_readings(s):
    """Five batches into the keyed table, merged in place twice, the last batch replayed after it: the newer row of a key wins."""
    root, table, rows, k = scratch_dir(s.spark, "tables"), "readings_by_sensor_day", s.enriched(), F.col("k")
    again = lambda least, status, hours: rows.filter(F.col("quality_status") == "alert").filter(k >= least).withColumns(
        {"quality_status": F.lit(status), "ingestion_time": F.col("ingestion_time") + F.make_dt_interval(hours=F.lit(hours))}
    )
    batches = [rows.filter(k < 50), rows.filter(k >= 50), again(0, "reviewed", 1), again(40, "confirmed", 2), again(80, "closed", 3)]
    for number, batch in enumerate(batches):
        tables.append_batch(batch, root, table, number)
        if number in (2, 4):
            tables.merge_table(s.spark, root, table, number - 1, as_of=EXPIRY_AS_OF)
    tables.append_batch(batches[4], root, table, 4)
    return tables.read_table(s.spark, root, table, EXPIRY_AS_OF)


@query
def alert_tables(s):
    """Alerts through both of their tables."""
    root = scratch_dir(s.spark, "tables")
    runtime.alert_writer(root, F.col("ingestion_time"))(s.enriched(), 0)
    names = ("alerts_by_sensor_day", "alerts_by_cluster_day")
    both = [tables.read_table(s.spark, root, n).select(F.lit(n).alias("stored_in"), *ALERT_VIEW) for n in names]
    return both[0].unionByName(both[1])


@query
def prediction_tables(s):
    """Predictions through the history table and the latest one."""
    root = scratch_dir(s.spark, "tables")
    rows = predictions(s)
    names = ("ml_predictions_by_location_minute", "latest_ml_predictions_by_location")
    for name in names:
        tables.append_batch(rows, root, name, 0)
    view = [c for c in PREDICTION_VIEW if c != "prediction_date"]
    both = [tables.read_table(s.spark, root, n).select(F.lit(n).alias("stored_in"), *view) for n in names]
    return both[0].unionByName(both[1])


@query
def saved_model(s):
    """Predictions of the fitted forest before and after saving and loading it: how many differ."""
    fitted, test = _fitted(s)
    path = scratch_dir(s.spark, "model")
    save_model(fitted, RISK_FEATURES, PARAMETERS, model.model_labels(fitted), path, window_minutes=360)
    view = ("location_id", "prediction_time", "risk_score", "risk_level", "predicted_event_type", "class_probabilities")
    before, after = (model.predict_risk(m, test, computed_at=F.col("prediction_time")).select(*view) for m in (fitted, load_model(path)))
    counted = before.withColumn("n", F.lit(1)).unionByName(after.withColumn("n", F.lit(-1)))
    return counted.groupBy(*view).agg(F.sum("n").alias("n")).agg(F.count_if(F.col("n") != 0).alias("differing"))


def _stream(s: Stations) -> DataFrame:
    return s.enrich(readings_from(s.event_stream()))


def _drained(s: Stations, rows: DataFrame, table: str, mode: str = "append") -> DataFrame:
    runtime.use_rocksdb(s.spark)
    root = scratch_dir(s.spark, table)
    writer = runtime.fan_out(runtime.table_writer(root, table))
    runtime.start(rows, writer, table, f"{root}/checkpoints", mode, drain=True).awaitTermination()
    return tables.read_table(s.spark, root, table)


def _to_files(s: Stations, rows: DataFrame, name: str) -> DataFrame:
    runtime.use_rocksdb(s.spark)
    root = scratch_dir(s.spark, name)
    sink = rows.writeStream.format("parquet").option("path", f"{root}/rows").option("checkpointLocation", f"{root}/checkpoint")
    sink.trigger(availableNow=True).start().awaitTermination()
    return s.spark.read.schema(rows.schema).parquet(f"{root}/rows")


@query
def stream_hourly(s):
    rows = stream_aggregates.stream_hourly(_stream(s), tie=("reading_id",))
    return _drained(s, rows, "readings_hourly_by_cluster_parameter", "update").drop("updated_at")


@query
def stream_daily(s):
    rows = stream_aggregates.stream_daily(_stream(s), tie=("reading_id",))
    return _drained(s, rows, "readings_daily_by_cluster_parameter", "update").drop("updated_at")


@query
def stream_latest(s):
    runtime.use_rocksdb(s.spark)
    root = scratch_dir(s.spark, "stream-latest")
    writer = runtime.fan_out(runtime.reading_writer(root, ("reading_id",)), runtime.alert_writer(root))
    runtime.start(_stream(s), writer, "latest", f"{root}/checkpoints", drain=True).awaitTermination()
    return tables.read_table(s.spark, root, "latest_readings_by_cluster")


@query
def stream_scores(s):
    scored = stateful.stream_scores(_stream(s), order=ORDER, watermark="0 seconds", computed_at=F.col("ingestion_time"))
    return _to_files(s, scored, "stream-scores").select(*SCORE_VIEW)


@query
def stream_scores_in_batches(s):
    """The same through the writer of the pipeline, which puts late rows aside."""
    runtime.use_rocksdb(s.spark)
    root = scratch_dir(s.spark, "score-batches")
    writer = runtime.rolled_writer(root, runtime.score_writer(root, ("reading_id",)), F.col("ingestion_time"))
    rolled = stateful.stream_rolling(_stream(s), order=ORDER, watermark="0 seconds")
    runtime.start(rolled, runtime.fan_out(writer, skip_empty=False), "scores", f"{root}/checkpoints", drain=True).awaitTermination()
    return tables.read_table(s.spark, root, "ai_scores_by_sensor_day").select(*STORED_SCORE_VIEW)


FILES_PER_PART = 4


def _stream_of_parts(s: Stations, parts: list[DataFrame], name: str) -> DataFrame:
    """The parts one after the other, each a micro-batch, written as files of a watched folder."""
    path = f"{scratch_dir(s.spark, name)}/in"
    for part in parts:
        part.repartition(FILES_PER_PART).write.mode("append").parquet(path)
    return read_readings_stream(s.spark, "parquet", parts[0].schema, path, maxFilesPerTrigger=str(FILES_PER_PART))


def _out_of_order(s: Stations) -> DataFrame:
    """Events to the twentieth day without four in ten, then those with five more days, then the rest of the month."""
    events, k = s.table("events"), F.get_json_object("props", "$.k").cast("int")
    day = F.date_format("ts", "yyyy-MM-dd")
    part = F.when((day < "2024-01-21") & (k < 60), 1).when(day < "2024-01-26", 2).otherwise(3)
    parts = [events.filter(part == i) for i in (1, 2, 3)]
    return stateful.stream_rolling(s.enrich(readings_from(_stream_of_parts(s, parts, "events"))), order=ORDER, watermark="5 days")


@query
def stream_scores_unordered(s):
    """Scores of what came in time, of a stream whose micro-batches overlap in time, with a delay of five days."""
    return _to_files(s, stateful.on_time_scores(_out_of_order(s), F.col("ingestion_time")), "stream-unordered").select(*SCORE_VIEW)


@query
def stream_late_rows(s):
    """The rows of the same stream that came too late to be scored."""
    return _to_files(s, stateful.late_rows(_out_of_order(s)), "stream-late").select("reading_id", "sensor_id", "event_time", "value")


@query
def stream_dedup(s):
    """Readings of which three in ten are sent again later, each once."""
    sent = s.table("events")
    again = sent.filter(F.get_json_object("props", "$.k").cast("int") < 30)
    stream = readings_from(_stream_of_parts(s, [sent, again], "sent"))
    rows = stream_aggregates.stream_dedup(stream, ("reading_id", "sensor_id", "event_time"), "60 days")
    return _to_files(s, rows.select("reading_id", "sensor_id", "event_time", "value"), "stream-dedup")


@query
def topic_gaps(s):
    """Missing and repeated offsets of a topic of four partitions that lost one message in twenty and doubled another."""
    k, number = F.col("k"), F.col("reading_id")
    sent = s.readings().filter(k >= 5).withColumn("_copy", F.explode(F.when(k >= 95, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))))
    return topics.topic_gaps(sent.select((number % 4).alias("partition"), F.floor(number / 4).alias("offset")), 1_000)


@query
def stream_metrics(s):
    """Pipeline metrics written from the scored stream."""
    runtime.use_rocksdb(s.spark)
    root = scratch_dir(s.spark, "stream-metrics")
    scored = stateful.stream_scores(_stream(s), order=ORDER, watermark="0 seconds", computed_at=F.col("ingestion_time"))
    writer = runtime.fan_out(runtime.metrics_writer(root), skip_empty=False)
    runtime.start(scored, writer, "metrics", f"{root}/checkpoints", drain=True).awaitTermination()
    return tables.read_table(s.spark, root, "pipeline_metrics_by_cluster_minute")


def _ten_days_each(s: Stations, name: str) -> DataFrame:
    """The enriched events of the month as three micro-batches of ten days."""
    events, day = s.table("events"), F.date_format("ts", "yyyy-MM-dd")
    part = F.when(day < "2024-01-11", 1).when(day < "2024-01-21", 2).otherwise(3)
    return s.enrich(readings_from(_stream_of_parts(s, [events.filter(part == i) for i in (1, 2, 3)], name)))


@query
def stream_cooldown(s):
    """Alerts let through over three micro-batches; what a batch let through holds back the next one's."""
    rows = derive_alerts(_ten_days_each(s, "days"), F.col("ingestion_time"))
    narrow = rows.select("sensor_id", "alert_type", "event_time", "alert_id", "value")
    root = scratch_dir(s.spark, "stream-cooldown")
    writer = runtime.fan_out(runtime.cooldown_writer(f"{root}/sent", LONG_COOLDOWN))
    runtime.start(narrow, writer, "cooldown", f"{root}/checkpoints", drain=True).awaitTermination()
    return runtime.sent_alerts(s.spark, f"{root}/sent", narrow.schema).select(*narrow.columns)


@query
def stream_alarms(s):
    rows = derive_alerts(_stream(s), F.col("ingestion_time"))
    return _to_files(s, stateful.stream_alarms(rows, "2 days", "0 seconds"), "stream-alarms")


@query
def stream_episodes(s):
    """Alarm episodes of the alert stream that are over."""
    rows = derive_alerts(_stream(s), F.col("ingestion_time"))
    return _to_files(s, stream_aggregates.stream_episodes(rows, "2 days", "0 seconds"), "stream-episodes")


@query
def stream_features(s):
    rows = stream_aggregates.stream_features(_stream(s), PARAMETERS, FEATURE_SPAN, watermark="0 seconds", suffix="12h", tie="reading_id")
    return _to_files(s, rows, "stream-features")


@query
def stream_trailing_features(s):
    """Features of the day before each micro-batch's newest reading; three batches, ten days each."""
    stream = _ten_days_each(s, "days")
    root = scratch_dir(s.spark, "trailing")
    rows = lambda batch, batch_id: batch.write.mode("overwrite").parquet(f"{root}/features/batch_id={batch_id}")
    writer = runtime.trailing_feature_writer(f"{root}/readings", rows, PARAMETERS, "24 hours", suffix="24h", tie="reading_id")
    runtime.start(stream, writer, "trailing", f"{root}/checkpoints", drain=True).awaitTermination()
    return s.spark.read.parquet(f"{root}/features").drop("batch_id")


@query
def stream_alert_topic(s):
    """Alert messages leave as JSON files and are decoded by the consumer."""
    rows = alert_messages(derive_alerts(_stream(s), F.col("ingestion_time")))
    return ingest.decode_alerts(_to_files(s, rows, "stream-alerts"))


