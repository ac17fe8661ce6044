import pytest
from pyspark.sql import functions as F

from gaugeflow.operators import configs
from gaugeflow.plans import reads
from gaugeflow.schemas import SENSOR_CONFIG


@pytest.fixture
def small_registry(spark):
    rows = [("C1", "S002", 0.0, 1.0, "pH", "u", 2, 30, None), ("C1", "S001", 0.0, 1.0, "ORP", None, 2, 30, None), ("C9", "S001", 0.0, 1.0, "pH", None, 2, 30, None)]
    return spark.createDataFrame(rows, SENSOR_CONFIG)


@pytest.fixture
def clusters(spark):
    return spark.createDataFrame([("C1",), ("C2",)], "cluster_id string")


def test_cluster_union_and_listing(small_registry, clusters):
    assert [r.cluster_id for r in configs.cluster_ids(clusters, small_registry).collect()] == ["C1", "C2", "C9"]
    listed = [(r.sensor_id, r.parameter, r.status) for r in configs.sensor_listing(small_registry).collect()]
    assert listed == [("C1S001", "ORP", "active"), ("C1S002", "pH", "active"), ("C9S001", "pH", "active")]
    assert configs.first_sensor(small_registry).first().sensor_id == "C1S001"


def test_dump_keeps_empty_and_unlisted_clusters(small_registry, clusters):
    rows = configs.dump_configs(clusters, small_registry).collect()
    found = {(r.cluster_id, r.sensor_id): r.unit for r in rows}
    assert len(rows) == len(found) and set(found) == {("C1", "S001"), ("C1", "S002"), ("C2", None), ("C9", "S001")}
    assert found["C1", "S002"] == "u"


def test_patch_semantics(spark, small_registry):
    patches = spark.createDataFrame(
        [
            ("C1", "S002", {"min": "0.5"}, 1),
            ("C1", "S002", {"unit": None, "min": "0.7"}, 2),
            ("C1", "S001", {}, 1),
            ("C5", "S009", {"type": "pH"}, 1),
            ("C9", "S001", {"config_interval_s": "77", "max": "oops"}, 1),
        ],
        "cluster_id string, sensor_id string, patch map<string,string>, patch_time int",
    )
    got = {(r.cluster_id, r.sensor_id): r for r in configs.merge_configs(small_registry, patches, "2026-06-07T12:00:00Z").collect()}
    first = got["C1", "S002"]
    assert (first.min_value, first.max_value, first.unit, first.sensor_type) == (0.7, 1.0, None, "pH")
    assert got["C1", "S001"].sensor_type == "ORP" and got["C1", "S001"].updated_at is not None
    added = got["C5", "S009"]
    assert (added.sensor_type, added.min_value, added.config_interval_s) == ("pH", None, 10)
    assert (got["C9", "S001"].config_interval_s, got["C9", "S001"].max_value) == (77, None)


def test_sensor_references(spark):
    refs = spark.createDataFrame([("C1S001",), (" c2 ",), ("7",), ("C10S001",), ("s5",)], "ref string")
    got = {r.ref: r for r in configs.sensor_references(refs).collect()}
    assert (got["C1S001"].is_valid, got["C1S001"].ref_cluster, got["C1S001"].ref_sensor) == (True, "C1", "S001")
    assert (got[" c2 "].is_valid, got[" c2 "].as_cluster, got["7"].as_cluster) == (False, "C2", "C7")
    assert got["C10S001"].ref_cluster is None and got["s5"].as_sensor == "S5"


@pytest.fixture
def day(spark):
    rows = [(f"C{1 + i % 2}", f"C{1 + i % 2}S001", f"2026-06-07 10:{i:02d}:00", "WATCH" if i % 3 else "NORMAL", f"a{i}", "WARNING" if i % 2 else "CRITICAL") for i in range(40)]
    frame = spark.createDataFrame(rows, "cluster_id string, sensor_id string, event_time string, anomaly_level string, alert_id string, severity string")
    return frame.withColumn("event_time", F.col("event_time").cast("timestamp")).withColumn("bucket_date", F.to_date("event_time"))


def minutes(df):
    return [r.event_time.minute for r in df.collect()]


def test_newest_page_reads_ascending_and_never_cuts_unseen(day):
    assert minutes(reads.newest_page(day, 3, "event_time")) == [37, 38, 39]
    assert reads.page_size(0) == 1 and reads.page_size(9_999, maximum=None) == 9_999 and reads.page_size(900, 1_000) == 900
    with pytest.raises(ValueError, match="at most 500"):
        reads.page_size(501)
    with pytest.raises(ValueError, match="at most 500"):
        reads.alerts_page(day, day="2026-06-07", limit=600)
    assert reads.alerts_page(day, day="2026-06-07", limit=600, maximum=1_000).count() == 40


def test_default_sensor_is_the_first_registered(day, small_registry):
    page = reads.readings_page(day, small_registry, day="2026-06-07", limit=2)
    assert minutes(page) == [36, 38] and {r.sensor_id for r in page.collect()} == {"C1S001"}
    assert reads.readings_page(day, small_registry, "C2S001", day="2026-06-08").count() == 0


def test_limit_before_or_after_the_level_filter(day, small_registry):
    options = {"day": "2026-06-07", "anomaly_level": " watch ", "limit": 3}
    assert minutes(reads.insights_page(day, small_registry, "C1S001", **options)) == [34, 38]
    assert minutes(reads.insights_page(day, small_registry, "C1S001", limit_first=False, **options)) == [32, 34, 38]


def test_alert_filters_come_before_the_limit(day):
    page = reads.alerts_page(day, cluster_id=" ", day="2026-06-07", severity="CRITICAL", limit=2)
    assert minutes(page) == [38, 36]
    assert reads.alerts_page(day, day="2026-06-07", limit=None).count() == 40
    assert minutes(reads.recent_alerts(day, "2026-06-07T10:36:00Z", limit=2)) == [39, 38]
    assert reads.on_day(day, "bucket_date", None, "2026-06-07T23:00:00Z").count() == 40


def test_pages_are_distributed_top_k(day):
    plan = reads.newest_page(day, 3, "event_time")
    text = plan._sc._jvm.PythonSQLUtils.explainString(plan._jdf.queryExecution(), "simple")
    assert "TakeOrderedAndProject" in text
