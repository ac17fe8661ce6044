import datetime as dt

from pyspark.sql import functions as F

from gaugeflow.functions.ids import blank_to_null
from gaugeflow.operators import ingest

MESSAGES = [
    '{"sensor_id":"C1S000","sensor_type":"pH","value":10,"timestamp":"2026-06-07T12:00:00Z"}',
    '{"sensor_id":"C1S000","sensor_type":"pH","value":9.2,"timestamp":"2026-06-07T12:00:06.123Z"}',
    '{"sensor_id":"C1S000","sensor_type":"pH","value":7.0,"timestamp":"2026-06-07T12:00:08.123456Z"}',
    '{"sensor_id":"C1S000","sensor_type":"pH","value":7.0,"timestamp":"2026-06-07 12:00:09"}',
]
BROKEN = [
    '{"sensor_id":"C1S000","sensor_type":"pH","value":null,"timestamp":"2026-06-07T12:00:00Z"}',
    '{"sensor_id":"C1S000","sensor_type":"pH","value":"x","timestamp":"2026-06-07T12:00:00Z"}',
    '{"sensor_id":"C1S000","sensor_type":"pH","value":NaN,"timestamp":"2026-06-07T12:00:00Z"}',
    '{"sensor_id":"C1S000","sensor_type":"pH","value":"NaN","timestamp":"2026-06-07T12:00:00Z"}',
    '{"sensor_id":"C1S000","sensor_type":"pH","value":1,"timestamp":"garbage"}',
    '{"sensor_id":"C1S000","value":1,"timestamp":"2026-06-07T12:00:00Z"}',
    "not json",
    "",
    None,
]


def raw(spark, texts):
    return spark.createDataFrame([(None if t is None else t.encode(),) for t in texts], "value binary")


def test_formats_parse_and_broken_messages_are_rejected(spark):
    valid, rejected = ingest.split_valid(ingest.parse_messages(raw(spark, MESSAGES + BROKEN)))
    micros = [r.at for r in valid.select(F.unix_micros("event_time").alias("at")).orderBy("at").collect()]
    start = int(dt.datetime(2026, 6, 7, 12, tzinfo=dt.timezone.utc).timestamp()) * 1_000_000
    assert micros == [start, start + 6_123_000, start + 8_123_456, start + 9_000_000]
    assert rejected.count() == len(BROKEN)


def test_json_is_parsed_once_per_row(spark):
    plan = ingest.valid_readings(ingest.parse_messages(raw(spark, MESSAGES)))
    text = plan._sc._jvm.PythonSQLUtils.explainString(plan._jdf.queryExecution(), "simple")
    assert text.count("from_json") == 1


def test_stamp_round_trip(spark):
    rows = spark.createDataFrame([("C1S000", "pH", 7.5)], "sensor_id string, sensor_type string, value double")
    stamped = ingest.stamp_messages(rows, "2026-06-07T12:00:00.5Z")
    assert stamped.first().value == (
        '{"sensor_id":"C1S000","sensor_type":"pH","value":7.5,"timestamp":"2026-06-07T12:00:00.500000Z"}'
    )
    assert ingest.valid_readings(ingest.parse_messages(stamped)).count() == 1


def test_decode_alerts_skips_undecodable(spark):
    texts = [b'{"alert_id":"a","value":1.5}', b"\xff\xfe", b"nonsense", None]
    decoded = ingest.decode_alerts(spark.createDataFrame([(t,) for t in texts], "value binary"))
    assert [(r.alert_id, r.value, r.unit) for r in decoded.collect()] == [("a", 1.5, None)]


def test_blank_becomes_null(spark):
    rows = spark.createDataFrame([("  ",), (" C1 ",), (None,)], "c string").select(blank_to_null(F.col("c")).alias("c"))
    assert [r.c for r in rows.collect()] == [None, "C1", None]
