import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

from gaugeflow.session import build_session  # noqa: E402


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = build_session(
        "tests",
        "local[8]",
        **{
            "spark.sql.shuffle.partitions": "4",
            "spark.ui.enabled": "false",
            "spark.ui.showConsoleProgress": "false",
            "spark.driver.memory": "6g",
            "spark.checkpoint.dir": str(tmp_path_factory.mktemp("checkpoints")),
        },
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture
def seed_rules(spark):
    from gaugeflow.constants import RULE_COLUMNS, SEED_RULES

    extra = [
        ("chlorine", "Chlorine", "mg/L", 1.0, 2.0, 0.5, 3.0, 1.0, 1.0, False),
        ("salinity", "Salinity", "ppt", 5.0, None, None, None, None, None, True),
        ("depth", "Depth", "m", 1.0, 2.0, 0.5, 3.0, 0.0, 0.0, True),
    ]
    return spark.createDataFrame([*SEED_RULES, *extra], RULE_COLUMNS)


@pytest.fixture
def registry(spark):
    from gaugeflow.schemas import SENSOR_CONFIG

    kinds = ["pH", "temperature", "turbidity", "conductivity", "dissolved_oxygen", "ORP", "chlorine", "salinity", "depth", "mud"]
    rows = [(c, f"S{i:03d}", 0.0, 100.0, kind, None, 2, 10, None) for c in ("C1", "C3") for i, kind in enumerate(kinds)]
    return spark.createDataFrame(rows, SENSOR_CONFIG)


@pytest.fixture
def enrich(spark, registry, seed_rules):
    """Readings ``(sensor_id, sensor_type, value, iso time)`` to enriched rows, through the JSON path."""
    import json

    from gaugeflow.operators.enrich import enrich_readings, parameter_rules, sensor_metadata
    from gaugeflow.operators.ingest import parse_messages, valid_readings

    def run(rows):
        fields = ("sensor_id", "sensor_type", "value", "timestamp")
        raw = spark.createDataFrame([(json.dumps(dict(zip(fields, r))),) for r in rows], "value string")
        valid = valid_readings(parse_messages(raw))
        return enrich_readings(valid, sensor_metadata(registry), parameter_rules(seed_rules), "2026-06-07T12:30:00Z")

    return run
