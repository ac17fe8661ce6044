import json

import pytest
from pyspark.sql import functions as F

from gaugeflow.operators.alerts import alert_messages, derive_alerts, wire_view
from gaugeflow.operators.notifications import render_notifications
from gaugeflow.operators.scoring import score_anomalies

T0 = "2026-06-07T12:00:00Z"


@pytest.mark.parametrize(
    "sensor, kind, value, status, alert",
    [
        ("C1S000", "pH", 10.0, "alert", ("HIGH_PH", "CRITICAL")),
        ("C1S000", "pH", 9.0, "normal", None),
        ("C1S000", "pH", 9.2, "alert", ("HIGH_PH", "WARNING")),
        ("C1S000", "pH", 9.5, "alert", ("HIGH_PH", "CRITICAL")),
        ("C1S000", "pH", 6.5, "normal", None),
        ("C1S000", "pH", 6.0, "alert", ("LOW_PH", "CRITICAL")),
        ("C1S002", "turbidity", -0.5, "alert", ("LOW_TURBIDITY", "WARNING")),
        ("C1S002", "turbidity", -1.0, "alert", ("LOW_TURBIDITY", "CRITICAL")),
        ("C1S004", "dissolved_oxygen", 2.0, "alert", ("LOW_DISSOLVED_OXYGEN", "CRITICAL")),
        ("C1S006", "chlorine", 99.0, "unconfigured", None),
        ("C1S007", "salinity", 1.0, "alert", ("LOW_SALINITY", "WARNING")),
        ("C1S007", "salinity", 1e9, "normal", None),
        ("C1S009", "mud", 1.0, "unconfigured", None),
    ],
)
def test_status_and_alert(enrich, sensor, kind, value, status, alert):
    enriched = enrich([(sensor, kind, value, T0)])
    assert enriched.first().quality_status == status
    found = [(a.alert_type, a.severity) for a in derive_alerts(enriched).collect()]
    assert found == ([alert] if alert else [])


def test_unknown_sensor_drops_out_and_calendar_columns(enrich):
    rows = enrich([("mock_sensor_01", "pH", 7.2, T0), ("C1S000", "pH", 7.2, T0)]).collect()
    assert [(r.sensor_id, str(r.bucket_date), r.bucket_month, r.bucket_year) for r in rows] == [
        ("C1S000", "2026-06-07", "2026-06", 2026)
    ]
    assert (rows[0].display_name, rows[0].unit, rows[0].local_sensor_id) == ("pH", "pH", "S000")


def test_alert_identity_and_message(spark, enrich):
    enriched = enrich([("C1S000", "pH", 10.0, T0)]).withColumn("sensor_id", F.lit("C1S002"))
    alerts = derive_alerts(enriched, "2026-06-07T12:00:01Z")
    key, value = alert_messages(alerts).first()
    message = json.loads(value)
    assert key == "C1S002"
    assert message["alert_id"] == "b93fb0cd5f08b47a5c666aee472aa025a853dfbadb184abc067e2c5dd4b55f7a"
    assert message["event_time"] == "2026-06-07T12:00:00.000Z"
    assert message["message"] == "pH value is above allowed threshold"
    assert list(message) == wire_view(alerts).columns


def score_of(enrich, values, **options):
    rows = [("C1S000", "pH", v, f"2026-06-07T12:00:{i:02d}Z") for i, v in enumerate(values)]
    return score_anomalies(enrich(rows), **options).orderBy("event_time").collect()


@pytest.mark.parametrize(
    "values, score, level, words",
    [
        ([10.0], 0.85, "CRITICAL", "critical water-quality threshold"),
        ([9.0], 0.0, "NORMAL", "consistent with the recent"),
        ([9.2], 0.60, "WARNING", "outside the allowed water-quality range"),
        ([7.0, 7.8], 0.35, "WATCH", "changed faster than expected"),
        ([7.0, 7.0, 7.0, 7.0, 8.9], 0.35, "WATCH", "changed faster than expected"),
        ([7.0, 7.0, 7.0, 7.0, 7.0], 0.0, "NORMAL", "consistent"),
    ],
)
def test_golden_scores(enrich, values, score, level, words):
    last = score_of(enrich, values)[-1]
    assert (last.anomaly_score, last.anomaly_level) == (score, level)
    assert words in last.explanation


def test_spike_statistics(enrich):
    last = score_of(enrich, [7.0, 7.0, 7.0, 7.0, 8.9])[-1]
    assert last.z_score == pytest.approx(1.7889, abs=1e-4)
    assert last.statistical_component == pytest.approx(0.1926, abs=1e-4)
    assert last.rate_component == 1.0
    assert last.raw_anomaly_score == pytest.approx(0.2578, abs=1e-4)


def test_longer_history_reaches_the_statistical_branch(enrich):
    values = [7.0, 7.1] * 6 + [7.55]
    last = score_of(enrich, values, window_rows=11, include_current=False)[-1]
    assert last.statistical_component > 0.5 and last.anomaly_level == "WATCH"
    assert "statistically unusual" in last.explanation


def test_disabled_rule_still_scores(enrich):
    scored = score_anomalies(enrich([("C1S006", "chlorine", 99.0, T0)])).first()
    assert (scored.quality_status, scored.anomaly_level) == ("unconfigured", "CRITICAL")


def test_zero_scale_switches_component_off(enrich):
    scored = score_anomalies(enrich([("C1S008", "depth", 2.5, T0)])).first()
    assert (scored.threshold_component, scored.anomaly_score) == (0.0, 0.0)


def test_notification_texts(spark, enrich):
    alerts = derive_alerts(enrich([("C1S000", "pH", 9.2, T0)]), T0)
    note = render_notifications(wire_view(alerts)).first()
    assert note.subject == "Water quality alert: HIGH_PH in cluster C1"
    assert note.body.split("\n")[2:9] == [
        "Alert type: HIGH_PH", "Severity: WARNING", "Sensor: C1S000", "Cluster: C1 / S000", "Parameter: pH",
        "Reading: 9.2 pH", "Threshold: expected range: 6.5 - 9.0",
    ]
    assert "Expected range: <code>6.5 to 9.0 pH</code>" in note.chat_message


def test_notification_defaults_and_escaping(spark):
    from gaugeflow.schemas import ALERT_MESSAGE

    row = {f.name: None for f in ALERT_MESSAGE} | {"message": "a<b & 'c'", "threshold_low": 1.0, "local_sensor_id": ""}
    note = render_notifications(spark.createDataFrame([tuple(row.values())], ALERT_MESSAGE)).first()
    assert note.cluster_text == "unknown" and note.threshold_text == "minimum allowed: 1.0"
    assert "<blockquote>a&lt;b &amp; &#x27;c&#x27;</blockquote>" in note.chat_message
    assert "Expected range: <code>at least 1.0</code>" in note.chat_message
