"""Registered queries against their SQL on the smallest tables."""

import sys
from pathlib import Path

import duckdb
import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent / "tools"))

from check_queries import TABLES, normal  # noqa: E402

from __spark_entry__ import entry, oracle_sql, queries  # noqa: E402
from gaugeflow.plans.catalogue import registered  # noqa: E402

SF_DIR = "/root/testdata/sf0.001"
# Streams have their own tests; these train a forest.
SLOW = {"train_and_predict", "feature_importance", "saved_model", "forest_check"}
NAMES = [n for n in registered() if not n.startswith("stream_") and n not in SLOW]


@pytest.fixture(scope="module")
def duck():
    connection = duckdb.connect()
    for table in TABLES:
        connection.execute(f"CREATE VIEW {table} AS SELECT * FROM '{SF_DIR}/{table}.parquet'")
    return connection


@pytest.mark.parametrize("name", NAMES)
def test_query_equals_sql(spark, duck, name):
    frame = queries()[name](spark, SF_DIR)
    answer = duck.execute(oracle_sql()[name])
    columns = [d[0] for d in answer.description]
    assert sorted(frame.columns) == sorted(columns)
    assert normal([list(r) for r in frame.collect()], frame.columns) == normal(answer.fetchall(), columns)


def test_entry_has_rows(spark):
    assert entry(spark).count() > 0


def test_every_oracle_belongs_to_a_query():
    assert set(oracle_sql()) <= set(queries())


def test_overview_page_parts(spark):
    from pyspark.sql import functions as F

    from gaugeflow.operators import latest, model
    from gaugeflow.operators.aggregates import pipeline_metrics
    from gaugeflow.plans import reads
    from gaugeflow.plans.stations import OUTCOMES, Stations

    s = Stations(spark, SF_DIR)
    scored = s.scored()
    predictions = model.prediction_rows(s.outcome_shares(), OUTCOMES, computed_at=F.col("prediction_time"))
    parts = reads.overview(
        s.configs(),
        latest.latest_readings(s.enriched(), ("reading_id",)),
        latest.latest_scores(scored, ("reading_id",)),
        s.alerts(),
        pipeline_metrics(scored),
        s.rules(),
        latest.latest_per_key(predictions, ["location_id"], ["prediction_time"]),
        "2024-01-10 12:00:00",
    )
    sizes = {name: part.count() for name, part in parts.items()}
    assert sizes["status"] == sizes["counts"] == sizes["latest_metric"] == sizes["latest_ml_prediction"] == 1
    assert sizes["latest_readings"] == sizes["latest_ai"] > 0 and sizes["parameter_averages"] == 5
    assert sizes["recent_alerts"] <= 20
