"""SQL equivalents of the registered queries, over the same whole tables (DuckDB dialect)."""

from __future__ import annotations

from gaugeflow.constants import HORIZON_MINUTES, SCORE_SENTENCES
from gaugeflow.plans.stations import KINDS, OUTCOMES, PARAMETERS, RULES

ORACLE: dict[str, str] = {}


def _t(column: str) -> str:
    return f"strftime({column}, '%Y-%m-%d %H:%M:%S.%f')"


def _d(column: str) -> str:
    return f"strftime({column}, '%Y-%m-%d')"


def _iso(column: str) -> str:
    return f"strftime({column}, '%Y-%m-%dT%H:%M:%S.%gZ')"


def _r(column: str, digits: int = 6) -> str:
    name = column.split(".")[-1]
    return f"round({column}, {digits}) AS {name}"


def _value(v) -> str:
    if v is None:
        return "NULL"
    if isinstance(v, bool):
        return str(v).upper()
    return f"CAST({v} AS DOUBLE)" if isinstance(v, float) else f"'{v}'"


def _quoted(items) -> str:
    return ", ".join(f"'{x}'" for x in items)


_RULE_ROWS = ", ".join("(" + ", ".join(_value(v) for v in row) + ")" for row in RULES)
_CRITICAL = "coalesce(value <= critical_low, FALSE) OR coalesce(value >= critical_high, FALSE)"
_LOW = "coalesce(value < normal_low, FALSE)"
_HIGH = "coalesce(value > normal_high, FALSE)"


def _state(column: str) -> str:
    return f"""CASE WHEN coalesce({column} <= critical_low, FALSE) OR coalesce({column} >= critical_high, FALSE) THEN 'critical'
      WHEN coalesce({column} < normal_low, FALSE) OR coalesce({column} > normal_high, FALSE) THEN 'warning' ELSE 'normal' END"""


def _distance(column: str) -> str:
    return f"""least(1.0, (CASE WHEN coalesce({column} < normal_low, FALSE) THEN normal_low - {column}
      WHEN coalesce({column} > normal_high, FALSE) THEN {column} - normal_high ELSE 0.0 END)
      / coalesce(nullif(threshold_scale, 0), 1.0))"""


def _scores(name: str, frame: str) -> str:
    s = SCORE_SENTENCES
    return f"""
{name}_rolled AS (
  SELECT *, avg(value) OVER w AS rolling_average, coalesce(stddev_samp(value) OVER w, 0.0) AS rolling_stddev,
    lag(value) OVER (PARTITION BY sensor_id ORDER BY event_time, reading_id) AS previous_value
  FROM enriched
  WINDOW w AS (PARTITION BY sensor_id ORDER BY event_time, reading_id ROWS BETWEEN {frame})),
{name}_measured AS (
  SELECT *, coalesce(abs(value - previous_value), 0.0) AS rate_of_change,
    CASE WHEN {_LOW} THEN normal_low - value WHEN {_HIGH} THEN value - normal_high ELSE 0.0 END AS gap,
    CASE WHEN rolling_stddev > 0 THEN abs((value - rolling_average) / rolling_stddev) ELSE 0.0 END AS z_score,
    CASE WHEN {_CRITICAL} THEN 1.0 ELSE 0.0 END AS critical_component
  FROM {name}_rolled),
{name}_graded AS (
  SELECT *, CASE WHEN coalesce(threshold_scale, 1.0) > 0 THEN least(1.0, gap / coalesce(threshold_scale, 1.0)) ELSE 0.0 END AS threshold_component,
    least(1.0, greatest(0.0, (z_score - 1.5) / 1.5)) AS statistical_component,
    CASE WHEN coalesce(rate_change_scale, 1.0) > 0 THEN least(1.0, rate_of_change / coalesce(rate_change_scale, 1.0)) ELSE 0.0 END AS rate_component
  FROM {name}_measured),
{name}_summed AS (
  SELECT *, round(greatest(0.5 * threshold_component + 0.3 * statistical_component + 0.2 * rate_component,
      CASE WHEN critical_component > 0 THEN 0.85 ELSE 0.0 END, CASE WHEN threshold_component > 0 THEN 0.60 ELSE 0.0 END,
      CASE WHEN statistical_component > 0.5 THEN 0.45 ELSE 0.0 END, CASE WHEN rate_component > 0.5 THEN 0.35 ELSE 0.0 END), 4) AS anomaly_score
  FROM {name}_graded),
{name} AS (
  SELECT *, CASE WHEN anomaly_score >= 0.85 THEN 'CRITICAL' WHEN anomaly_score >= 0.60 THEN 'WARNING'
      WHEN anomaly_score >= 0.35 THEN 'WATCH' ELSE 'NORMAL' END AS anomaly_level,
    CASE WHEN critical_component > 0 THEN '{s["critical"]}'
      WHEN threshold_component > 0 AND statistical_component > 0.5 THEN '{s["threshold_statistical"]}'
      WHEN threshold_component > 0 THEN '{s["threshold"]}'
      WHEN statistical_component > 0.5 THEN '{s["statistical"]}'
      WHEN rate_component > 0.5 THEN '{s["rate"]}' ELSE '{s["default"]}' END AS explanation,
    ingestion_time AS computed_at
  FROM {name}_summed)"""


def _features(name: str, source: str, suffix: str, least_rows: int) -> str:
    """Wide features from measures ``location_id, slot, parameter, n, latest, mean, std, slope`` and bounds."""
    cells = ", ".join(
        f"coalesce(max({m}) FILTER (parameter = '{p}'), 0.0) AS {p}_{m}{'' if m in ('latest', 'threshold_distance') else '_' + suffix}"
        for p in PARAMETERS
        for m in ("latest", "mean", "std", "slope", "threshold_distance")
    )
    return f"""
{name}_judged AS (
  SELECT *, {_distance("latest")} AS threshold_distance, {_state("latest")} AS state
  FROM {source} WHERE n >= {least_rows}),
{name} AS (
  SELECT location_id, slot, {cells},
    CAST(count(*) FILTER (state = 'warning') AS DOUBLE) AS warning_count_{suffix},
    CAST(count(*) FILTER (state = 'critical') AS DOUBLE) AS critical_count_{suffix},
    max(threshold_distance) AS max_threshold_distance, avg(threshold_distance) AS avg_threshold_distance
  FROM {name}_judged GROUP BY ALL HAVING count(*) = {len(PARAMETERS)})"""


def _feature_view(suffix: str) -> str:
    names = [
        f"{p}_{m}" + ("" if m in ("latest", "threshold_distance") else f"_{suffix}")
        for p in PARAMETERS
        for m in ("latest", "mean", "std", "slope", "threshold_distance")
    ]
    names += [f"warning_count_{suffix}", f"critical_count_{suffix}", "max_threshold_distance", "avg_threshold_distance"]
    return ", ".join(_r(n) for n in names)


_MEASURES = """parameter, count(*) AS n, arg_max(value, (event_time, reading_id)) AS latest, avg(value) AS mean,
    coalesce(stddev_samp(value), 0.0) AS std,
    CASE WHEN max(event_time) > min(event_time) THEN (arg_max(value, (event_time, reading_id)) - arg_min(value, (event_time, reading_id)))
      / ((epoch_us(max(event_time)) - epoch_us(min(event_time))) / 60e6) ELSE 0.0 END AS slope,
    any_value(normal_low) AS normal_low, any_value(normal_high) AS normal_high, any_value(critical_low) AS critical_low,
    any_value(critical_high) AS critical_high, any_value(threshold_scale) AS threshold_scale"""

_USABLE = f"rule_enabled AND parameter IN ({_quoted(PARAMETERS)})"

BASE = f"""
configs AS (
  SELECT 'C' || (s_suppkey % 3 + 1) AS cluster_id, 'S' || s_suppkey || '_' || kind AS sensor_id,
    CAST(s_nationkey AS DOUBLE) AS min_value, s_nationkey + CAST(250 AS DOUBLE) AS max_value, kind AS sensor_type,
    CASE WHEN s_acctbal >= 5000 THEN upper(kind) END AS unit, s_nationkey + 1 AS measure_interval_s,
    10 AS config_interval_s, TIMESTAMP '2024-01-01 00:00:00' + to_seconds(s_suppkey) AS updated_at
  FROM (SELECT *, unnest([{_quoted(KINDS)}]) AS kind FROM supplier)),
clusters AS (SELECT 'C' || (r_regionkey + 1) AS cluster_id FROM region),
rules(parameter, display_name, unit, normal_low, normal_high, critical_low, critical_high, threshold_scale,
  rate_change_scale, enabled) AS (VALUES {_RULE_ROWS}),
readings AS (
  SELECT event_id AS reading_id, 'C' || (user_id % 3 + 1) || 'S' || user_id || '_' || event_type AS sensor_id,
    'C' || (user_id % 3 + 1) AS station_cluster, 'S' || user_id || '_' || event_type AS station_sensor,
    event_type AS sensor_type, value, ts AS event_time,
    ts + to_seconds(CAST(json_extract(props, '$.k') AS INTEGER)) AS arrived_at, CAST(json_extract(props, '$.k') AS INTEGER) AS k
  FROM events),
joined AS (
  SELECT e.reading_id, e.k, e.sensor_id, c.cluster_id, c.sensor_id AS local_sensor_id, e.sensor_type, e.event_time,
    c.sensor_type AS parameter, coalesce(u.display_name, c.sensor_type) AS display_name, e.value,
    coalesce(c.unit, u.unit) AS unit, coalesce(u.enabled, FALSE) AS rule_enabled, u.normal_low, u.normal_high,
    u.critical_low, u.critical_high, u.threshold_scale, u.rate_change_scale, e.arrived_at AS ingestion_time
  FROM readings e JOIN configs c ON e.sensor_id = c.cluster_id || c.sensor_id
  LEFT JOIN rules u ON c.sensor_type = u.parameter),
enriched AS (
  SELECT *, CASE WHEN NOT rule_enabled THEN 'unconfigured' WHEN {_LOW} OR {_HIGH} THEN 'alert' ELSE 'normal' END AS quality_status,
    CAST(event_time AS DATE) AS bucket_date, strftime(event_time, '%Y-%m') AS bucket_month,
    CAST(year(event_time) AS BIGINT) AS bucket_year
  FROM joined),
directed AS (
  SELECT *, CASE WHEN {_LOW} THEN 'LOW' ELSE 'HIGH' END AS direction FROM enriched WHERE quality_status = 'alert'),
typed AS (
  SELECT *, direction || '_' || upper(regexp_replace(parameter, '[^A-Za-z0-9]+', '_', 'g')) AS alert_type,
    CASE WHEN {_CRITICAL} THEN 'CRITICAL' ELSE 'WARNING' END AS severity,
    normal_low AS threshold_low, normal_high AS threshold_high, 'ACTIVE' AS alarm_state,
    display_name || CASE direction WHEN 'LOW' THEN ' value is below allowed threshold' ELSE ' value is above allowed threshold' END AS message,
    display_name || CASE direction WHEN 'LOW' THEN ' is below the configured lower threshold.' ELSE ' is above the configured upper threshold.' END AS explanation,
    ingestion_time AS processed_at
  FROM directed),
alerts AS (
  SELECT *, sha256(sensor_id || '|' || alert_type || '|' || {_iso("event_time")} || '|' || CAST(value AS VARCHAR)) AS alert_id FROM typed)"""

SCORES = _scores("scored", "4 PRECEDING AND CURRENT ROW")
METRICS = """
metrics AS (
  SELECT cluster_id, date_trunc('minute', computed_at) AS minute_start, count(*) AS processed_reading_count,
    count(*) FILTER (quality_status = 'alert') AS alert_count, avg(anomaly_score) AS avg_anomaly_score,
    max(anomaly_score) AS max_anomaly_score, avg(lag_ms) AS avg_event_latency_ms, max(lag_ms) AS max_event_latency_ms,
    max(computed_at) AS updated_at
  FROM (SELECT *, CAST((floor(epoch_us(computed_at) / 1e6) - floor(epoch_us(event_time) / 1e6)) * 1000 AS DOUBLE) AS lag_ms FROM scored)
  GROUP BY ALL),
rollup_rows AS (
  SELECT minute_start, CAST(minute_start AS DATE) AS metric_date, CAST(sum(processed_reading_count) AS BIGINT) AS processed_reading_count,
    CAST(sum(alert_count) AS BIGINT) AS alert_count, CAST(round(CAST(avg(avg_anomaly_score) AS DECIMAL(18, 10)), 4) AS DOUBLE) AS avg_anomaly_score,
    max(max_anomaly_score) AS max_anomaly_score, CAST(round(CAST(avg(avg_event_latency_ms) AS DECIMAL(24, 10)), 3) AS DOUBLE) AS avg_event_latency_ms,
    max(max_event_latency_ms) AS max_event_latency_ms, max(updated_at) AS updated_at,
    sum(avg_anomaly_score * processed_reading_count) / sum(processed_reading_count) AS weighted_anomaly_score,
    sum(avg_event_latency_ms * processed_reading_count) / sum(processed_reading_count) AS weighted_event_latency_ms
  FROM metrics GROUP BY minute_start)"""
LATEST = """
newest_readings AS (
  SELECT * FROM enriched
  QUALIFY row_number() OVER (PARTITION BY cluster_id, parameter, sensor_id ORDER BY event_time DESC, reading_id DESC) = 1)"""
LATEST_SCORES = """
newest_scores AS (
  SELECT * FROM scored
  QUALIFY row_number() OVER (PARTITION BY cluster_id, parameter, sensor_id ORDER BY event_time DESC, reading_id DESC) = 1)"""
ROLLUP_VIEW = f"""{_t("minute_start")} AS minute_start, {_d("metric_date")} AS metric_date, processed_reading_count, alert_count,
  {_r("avg_anomaly_score")}, {_r("max_anomaly_score")}, {_r("avg_event_latency_ms")}, {_r("max_event_latency_ms")},
  {_t("updated_at")} AS updated_at, {_r("weighted_anomaly_score")}, {_r("weighted_event_latency_ms")}"""
METRIC_VIEW = f"""cluster_id, {_t("minute_start")} AS minute_start, processed_reading_count, alert_count,
  {_r("avg_anomaly_score")}, {_r("max_anomaly_score")}, {_r("avg_event_latency_ms")}, {_r("max_event_latency_ms")},
  {_t("updated_at")} AS updated_at, {_d("minute_start")} AS metric_date"""


def _half_up(sql: str) -> str:
    """Round on decimals: six-digit ties must not depend on the last bit of a float sum."""
    done, at = "", 0
    while (start := sql.find("round(", at)) >= 0:
        depth, end = 1, start + 6
        while depth:
            depth += {"(": 1, ")": -1}.get(sql[end], 0)
            end += 1
        inner = sql[start + 6 : end - 1]
        if inner.endswith(", 6)") or not inner.endswith(", 6"):
            done, at = done + sql[at : start + 6], start + 6
            continue
        done += sql[at:start] + f"CAST(round(CAST({_half_up(inner[:-3])} AS DECIMAL(34, 10)), 6) AS DOUBLE)"
        at = end
    return done + sql[at:]


def _add(name: str, final: str, *ctes: str, recursive: bool = False) -> None:
    head = "WITH RECURSIVE " if recursive else "WITH "
    ORACLE[name] = _half_up(head + ",".join([BASE, *ctes]) + "\n" + final)


# --- ingest ----------------------------------------------------------------------------------

MESSAGES = f"""
raw AS (
  SELECT reading_id, CASE WHEN k < 4 THEN 'not json' ELSE
    '{{"sensor_id":"' || sensor_id || '",' || CASE WHEN k BETWEEN 16 AND 19 THEN '' ELSE '"sensor_type":"' || sensor_type || '",' END ||
    '"value":' || CASE WHEN k BETWEEN 4 AND 7 THEN 'null' WHEN k BETWEEN 8 AND 11 THEN '"x"' WHEN k BETWEEN 20 AND 23 THEN '"NaN"'
      ELSE CAST(value AS VARCHAR) END || ',"timestamp":"' ||
    CASE WHEN k BETWEEN 12 AND 15 THEN 'garbage' WHEN k < 50 THEN strftime(event_time, '%Y-%m-%dT%H:%M:%SZ')
      WHEN k < 75 THEN {_iso("event_time")} ELSE strftime(event_time, '%Y-%m-%dT%H:%M:%S.%fZ') END || '"}}' END AS text
  FROM readings),
fields AS (
  SELECT reading_id, CASE WHEN json_valid(text) THEN CAST(text AS JSON) END AS j FROM raw),
parsed AS (
  SELECT reading_id, json_extract_string(j, '$.sensor_id') AS sensor_id, json_extract_string(j, '$.sensor_type') AS sensor_type,
    nullif(TRY_CAST(json_extract_string(j, '$.value') AS DOUBLE), CAST('NaN' AS DOUBLE)) AS value,
    TRY_CAST(json_extract_string(j, '$.timestamp') AS TIMESTAMP) AS event_time
  FROM fields)"""
_COMPLETE = "sensor_id IS NOT NULL AND sensor_type IS NOT NULL AND value IS NOT NULL AND event_time IS NOT NULL"
_PARSED_VIEW = f"reading_id, sensor_id, sensor_type, {_r('value')}, {_t('event_time')} AS event_time"
_add("valid_readings", f"SELECT {_PARSED_VIEW} FROM parsed WHERE {_COMPLETE}", MESSAGES)
_add("rejected_messages", f"SELECT {_PARSED_VIEW} FROM parsed WHERE NOT ({_COMPLETE})", MESSAGES)
_add(
    "timestamp_formats",
    f"""SELECT reading_id, {_t("slot")} AS event_time, {_iso("slot")} AS iso FROM (
  SELECT reading_id, TRY_CAST(CASE WHEN k < 25 THEN strftime(event_time, '%Y-%m-%d %H:%M:%S')
    WHEN k < 50 THEN strftime(event_time, '%Y-%m-%dT%H:%M:%SZ') WHEN k < 75 THEN {_iso("event_time")}
    WHEN k < 95 THEN strftime(event_time, '%Y-%m-%dT%H:%M:%S.%fZ')
    ELSE 'at ' || strftime(event_time, '%Y-%m-%dT%H:%M:%SZ') END AS TIMESTAMP) AS slot FROM readings)""",
)
_add(
    "stamped_messages",
    f"""SELECT sensor_id AS key, sensor_id, sensor_type, {_r("value")},
  strftime(arrived_at, '%Y-%m-%dT%H:%M:%S.%fZ') AS timestamp, {_t("arrived_at")} AS event_time FROM readings""",
)

# --- enrichment and alerts -------------------------------------------------------------------

_add(
    "enriched_readings",
    f"""SELECT reading_id, k, sensor_id, cluster_id, local_sensor_id, sensor_type, {_t("event_time")} AS event_time, parameter,
  display_name, {_r("value")}, unit, quality_status, rule_enabled, normal_low, normal_high, critical_low, critical_high,
  threshold_scale, rate_change_scale, {_t("ingestion_time")} AS ingestion_time, {_d("bucket_date")} AS bucket_date,
  bucket_month, bucket_year FROM enriched""",
)
_KNOWN = "(SELECT cluster_id || sensor_id FROM configs)"
for _name, _how in (("unknown_sensor_readings", "NOT IN"), ("known_sensor_readings", "IN")):
    _add(_name, f"SELECT reading_id, sensor_id, {_r('value')} FROM readings WHERE sensor_id {_how} {_KNOWN}")
_add(
    "alerts",
    f"""SELECT alert_id, sensor_id, cluster_id, local_sensor_id, parameter, {_r("value")}, unit, alert_type, severity, threshold_low,
  threshold_high, alarm_state, message, explanation, {_t("event_time")} AS event_time, {_t("processed_at")} AS processed_at FROM alerts""",
)
_add(
    "alert_counts",
    "SELECT cluster_id, alert_type, severity, count(*) AS alerts, round(max(value), 6) AS max_value FROM alerts GROUP BY ALL",
)
_WIRE = f"""SELECT alert_id, sensor_id, cluster_id, local_sensor_id, parameter, {_r("value")}, unit, alert_type, severity, threshold_low,
  threshold_high, message, {_iso("event_time")} AS event_time, {_iso("processed_at")} AS processed_at FROM alerts"""
for _name in ("alert_topic", "stream_alert_topic"):
    _add(_name, _WIRE)
_add("alert_cooldown_zero", f"SELECT sensor_id, alert_type, {_t('event_time')} AS event_time, alert_id, {_r('value')} FROM alerts")
_ALERT_VIEW = f"""alert_id, sensor_id, cluster_id, local_sensor_id, parameter, {_r("value")}, unit, alert_type, severity, threshold_low,
  threshold_high, alarm_state, message, explanation, {_t("event_time")} AS event_time, {_t("processed_at")} AS processed_at"""
_add(
    "alert_tables",
    f"""SELECT 'alerts_by_sensor_day' AS stored_in, {_ALERT_VIEW} FROM alerts
UNION ALL SELECT 'alerts_by_cluster_day' AS stored_in, {_ALERT_VIEW} FROM alerts""",
)
_COOLDOWN = """
ordered AS (
  SELECT *, row_number() OVER (PARTITION BY sensor_id, alert_type ORDER BY event_time, alert_id) AS rn FROM alerts),
walk AS (
  SELECT sensor_id, alert_type, alert_id, value, event_time, rn, event_time AS sent, TRUE AS emitted FROM ordered WHERE rn = 1
  UNION ALL
  SELECT o.sensor_id, o.alert_type, o.alert_id, o.value, o.event_time, o.rn,
    CASE WHEN o.event_time >= w.sent + INTERVAL 3 DAY THEN o.event_time ELSE w.sent END, o.event_time >= w.sent + INTERVAL 3 DAY
  FROM walk w JOIN ordered o ON o.sensor_id = w.sensor_id AND o.alert_type = w.alert_type AND o.rn = w.rn + 1)"""
for _name in ("alert_cooldown", "alert_cooldown_split", "stream_cooldown"):
    _add(
        _name,
        f"SELECT sensor_id, alert_type, {_t('event_time')} AS event_time, alert_id, {_r('value')} FROM walk WHERE emitted",
        _COOLDOWN,
        recursive=True,
    )
_READING = "CAST(value AS VARCHAR) || coalesce(' ' || nullif(unit, ''), '')"
_PLACE = "cluster_id || ' / ' || local_sensor_id"
_RANGE = "CAST(threshold_low AS VARCHAR) || '{}' || CAST(threshold_high AS VARCHAR)"
_add(
    "notifications",
    f"""SELECT alert_id, sensor_id, alert_type, 'Water quality alert: ' || alert_type || ' in cluster ' || cluster_id AS subject,
  concat_ws(chr(10), 'Water quality alert', '', 'Alert type: ' || alert_type, 'Severity: ' || severity, 'Sensor: ' || sensor_id,
    'Cluster: ' || {_PLACE}, 'Parameter: ' || parameter, 'Reading: ' || {_READING},
    'Threshold: expected range: ' || {_RANGE.format(" - ")}, 'Event time: ' || {_iso("event_time")},
    'Processed at: ' || {_iso("processed_at")}, '', message) AS body,
  concat_ws(chr(10), '<b>Water Quality Alert</b>', '', '<blockquote>' || message || '</blockquote>', '', '<b>Summary</b>',
    'Severity: <code>' || severity || '</code>', 'Alert type: <code>' || alert_type || '</code>',
    'Reading: <code>' || parameter || ': ' || {_READING} || '</code>',
    'Expected range: <code>' || {_RANGE.format(" to ")} || coalesce(' ' || nullif(unit, ''), '') || '</code>', '',
    '<b>Cluster</b>', {_PLACE}, 'Sensor: <code>' || sensor_id || '</code>', '', '<b>Timing</b>',
    'Event time: <code>' || {_iso("event_time")} || '</code>', 'Processed at: <code>' || {_iso("processed_at")} || '</code>') AS chat_message,
  {_READING} AS reading_text, {_PLACE} AS cluster_text, 'expected range: ' || {_RANGE.format(" - ")} AS threshold_text
  FROM alerts""",
)

# --- scores ----------------------------------------------------------------------------------

_SCORE_VIEW = f"""reading_id, sensor_id, {_t("event_time")} AS event_time, {_r("value")}, {_r("rolling_average")}, {_r("rolling_stddev")},
  {_r("z_score")}, {_r("rate_of_change")}, {_r("threshold_component")}, {_r("statistical_component")}, {_r("rate_component")},
  {_r("anomaly_score")}, anomaly_level, explanation"""
_add("anomaly_scores", f"SELECT {_SCORE_VIEW} FROM scored", SCORES)
_add("stream_scores", f"SELECT {_SCORE_VIEW} FROM scored", SCORES)
_add("stream_scores_in_batches", f"SELECT {_SCORE_VIEW.removeprefix('reading_id, ')} FROM scored", SCORES)
_LATE = """
parts AS (
  SELECT *, CASE WHEN event_time < TIMESTAMP '2024-01-21' AND k < 60 THEN 1 WHEN event_time < TIMESTAMP '2024-01-26' THEN 2 ELSE 3 END AS part FROM enriched),
marks AS (
  SELECT max(epoch_us(event_time)) FILTER (part < 2) // 1000 - 432000000 AS at_2, max(epoch_us(event_time)) FILTER (part < 3) // 1000 - 432000000 AS at_3,
    max(epoch_us(event_time)) // 1000 - 432000000 AS at_end FROM parts),
placed AS (
  SELECT parts.*, epoch_us(event_time) // 1000 AS stamp, at_end,
    coalesce((part = 2 AND epoch_us(event_time) // 1000 <= at_2) OR (part = 3 AND epoch_us(event_time) // 1000 <= at_3), FALSE) AS late FROM parts, marks),
punctual AS (SELECT * FROM placed WHERE NOT late AND stamp <= at_end)"""
_add("stream_scores_unordered", f"SELECT {_SCORE_VIEW} FROM scored", _LATE, SCORES.replace("FROM enriched", "FROM punctual"))
_add("stream_late_rows", f"SELECT reading_id, sensor_id, {_t('event_time')} AS event_time, {_r('value')} FROM placed WHERE late", _LATE)
_add("stream_dedup", f"SELECT reading_id, sensor_id, {_t('event_time')} AS event_time, {_r('value')} FROM readings")
_add(
    "topic_gaps",
    """SELECT partition, 'gap' AS kind, before + 1 AS first_offset, o - 1 AS last_offset, o - before - 1 AS rows
FROM (SELECT partition, o, lag(o) OVER (PARTITION BY partition ORDER BY o) AS before FROM sent) WHERE o > before + 1
UNION ALL SELECT partition, 'repeat', o, o, 1::BIGINT FROM sent WHERE k >= 95""",
    "sent AS (SELECT reading_id % 4 AS partition, reading_id // 4 AS o, k FROM readings WHERE k >= 5)",
)
_add("anomaly_scores_past_rows", f"SELECT {_SCORE_VIEW} FROM past", _scores("past", "11 PRECEDING AND 1 PRECEDING"))
_add(
    "anomaly_levels",
    "SELECT cluster_id, anomaly_level, explanation, count(*) AS readings FROM scored GROUP BY ALL",
    SCORES,
)
_LATEST_VIEW = f"""SELECT cluster_id, parameter, sensor_id, local_sensor_id, {_t("event_time")} AS event_time, {_r("value")}, unit,
  quality_status, {_t("ingestion_time")} AS updated_at FROM newest_readings"""
for _name in ("latest_readings", "stream_latest"):
    _add(_name, _LATEST_VIEW, LATEST)
_add(
    "latest_scores",
    f"""SELECT cluster_id, parameter, sensor_id, {_t("event_time")} AS event_time, {_r("value")}, {_r("anomaly_score")}, anomaly_level,
  {_r("rolling_average")}, {_r("z_score")}, {_r("rate_of_change")}, explanation, {_t("computed_at")} AS updated_at FROM newest_scores""",
    SCORES,
    LATEST_SCORES,
)
_add(
    "dedup_readings",
    f"""SELECT reading_id, sensor_id, sensor_type, {_r("value")}, {_t("day")} AS event_time, {_t("arrived_at")} AS arrived_at, k FROM (
  SELECT *, date_trunc('day', event_time)::TIMESTAMP AS day FROM readings
  QUALIFY row_number() OVER (PARTITION BY sensor_id, date_trunc('day', event_time) ORDER BY arrived_at DESC, reading_id DESC) = 1)""",
)
_add(
    "retained_readings",
    f"""SELECT reading_id, {_t("event_time")} AS event_time FROM readings
WHERE event_time > TIMESTAMP '2024-01-20 00:00:00' - INTERVAL 10 DAY""",
)

# --- aggregates ------------------------------------------------------------------------------

_STATS = f"""count(*) AS reading_count, round(avg(value), 6) AS avg_value, round(min(value), 6) AS min_value,
  round(max(value), 6) AS max_value, round(arg_max(value, (event_time, reading_id)), 6) AS last_value"""
for _name in ("hourly_aggregates", "stream_hourly"):
    _add(
        _name,
        f"""SELECT cluster_id, parameter, unit, {_t("start")} AS window_start, strftime(start, '%Y-%m') AS bucket_month, {_STATS}
FROM (SELECT *, date_trunc('hour', event_time) AS start FROM enriched) GROUP BY cluster_id, parameter, unit, start""",
    )
for _name in ("daily_aggregates", "stream_daily"):
    _add(
        _name,
        f"""SELECT cluster_id, parameter, unit, {_d("bucket_date")} AS day, bucket_year, {_STATS}
FROM enriched GROUP BY cluster_id, parameter, unit, bucket_date, bucket_year""",
    )
for _name in ("pipeline_metrics", "stream_metrics"):
    _add(_name, f"SELECT {METRIC_VIEW} FROM metrics", SCORES, METRICS)
_add("performance_rollup", f"SELECT {ROLLUP_VIEW} FROM rollup_rows", SCORES, METRICS)
_add(
    "latest_minute_rollup",
    f"SELECT {ROLLUP_VIEW} FROM rollup_rows WHERE minute_start = (SELECT max(minute_start) FROM metrics)",
    SCORES,
    METRICS,
)
_add(
    "parameter_averages",
    """SELECT n.parameter, coalesce(any_value(u.display_name), n.parameter) AS display_name,
  coalesce(nullif(arg_max(coalesce(n.unit, ''), (n.event_time, n.sensor_id)), ''), any_value(u.unit)) AS unit,
  CAST(round(CAST(avg(n.value) AS DECIMAL(24, 10)), 3) AS DOUBLE) AS average_value
FROM newest_readings n LEFT JOIN rules u USING (parameter) GROUP BY n.parameter""",
    LATEST,
)
_RECENT = "event_time >= TIMESTAMP '2024-01-20 00:00:00' - INTERVAL 1 DAY"
_add(
    "system_status",
    f"""SELECT CASE WHEN (SELECT coalesce(bool_or(severity = 'CRITICAL'), FALSE) FROM alerts WHERE {_RECENT})
    OR (SELECT bool_or(anomaly_level = 'CRITICAL') FROM newest_scores) THEN 'CRITICAL'
  WHEN EXISTS (FROM alerts WHERE {_RECENT}) OR (SELECT bool_or(anomaly_level IN ('WATCH', 'WARNING')) FROM newest_scores) THEN 'WARNING'
  ELSE 'NORMAL' END AS system_status, (SELECT count(*) FROM alerts WHERE {_RECENT}) AS active_alert_count""",
    SCORES,
    LATEST_SCORES,
)
_add(
    "overview_counts",
    f"""SELECT (SELECT count(*) FROM configs) AS active_sensor_count,
  (SELECT count(*) FROM alerts WHERE {_RECENT}) AS active_alert_count,
  (SELECT CAST(round(CAST(avg(value) AS DECIMAL(24, 10)), 3) AS DOUBLE) FROM newest_readings WHERE parameter = 'click') AS average_click,
  (SELECT CAST(round(CAST(avg(value) AS DECIMAL(24, 10)), 3) AS DOUBLE) FROM newest_readings WHERE parameter = 'error') AS average_error""",
    LATEST,
)
_add(
    "named_averages",
    "SELECT CAST(round(CAST(avg(value) AS DECIMAL(24, 10)), 3) AS DOUBLE) AS average_value FROM newest_readings WHERE parameter = 'click'",
    LATEST,
)


def _alarm_groups(where: str, as_of: str, quiet: str) -> str:
    return f"""SELECT sensor_id, arg_max(parameter, event_time) AS parameter, alert_type,
  CASE WHEN bool_or(severity = 'CRITICAL') THEN 'CRITICAL' ELSE 'WARNING' END AS severity,
  CASE WHEN max(event_time) >= TIMESTAMP '{as_of}' - INTERVAL {quiet} THEN 'ACTIVE' ELSE 'RESOLVED' END AS state,
  {_t("min(event_time)")} AS first_seen, {_t("max(event_time)")} AS last_seen, count(*) AS alert_count,
  round(arg_max(value, event_time), 6) AS latest_value, arg_max(message, event_time) AS message,
  arg_max(explanation, event_time) AS explanation FROM alerts WHERE {where} GROUP BY sensor_id, alert_type"""


_add("alarm_groups", _alarm_groups("TRUE", "2024-01-20 00:00:00", "1 DAY"))
_add("alarms_page", _alarm_groups("bucket_date = DATE '2024-01-05'", "2024-01-06 00:00:00", "5 MINUTE"))

# --- pages -----------------------------------------------------------------------------------

_add(
    "sensors_page",
    f"""SELECT cluster_id, cluster_id || sensor_id AS sensor_id, min_value, max_value, sensor_type, unit,
  CAST(measure_interval_s AS BIGINT) AS measure_interval_s, CAST(config_interval_s AS BIGINT) AS config_interval_s,
  {_t("updated_at")} AS updated_at, sensor_id AS local_sensor_id, sensor_type AS parameter, 'active' AS status,
  {_t("updated_at")} AS last_seen_at FROM configs WHERE cluster_id = 'C1'""",
)
_add(
    "latest_readings_page",
    f"SELECT sensor_id, {_t('event_time')} AS event_time, {_r('value')}, quality_status FROM newest_readings WHERE cluster_id = 'C2'",
    LATEST,
)
_SENSOR_DAY = "sensor_id = 'C3S8_error' AND bucket_date = DATE '2024-01-01'"
_add(
    "readings_page",
    f"""SELECT sensor_id, {_t("event_time")} AS event_time, {_r("value")}, quality_status FROM enriched
WHERE {_SENSOR_DAY} ORDER BY enriched.event_time DESC LIMIT 200""",
)
_add(
    "first_sensor_readings",
    f"""SELECT sensor_id, {_t("event_time")} AS event_time, {_r("value")} FROM enriched WHERE sensor_id =
  (SELECT cluster_id || sensor_id FROM configs WHERE cluster_id = 'C2' ORDER BY sensor_id LIMIT 1)
ORDER BY enriched.event_time DESC LIMIT 5""",
)
_add(
    "alerts_page",
    f"""SELECT alert_id, sensor_id, {_t("event_time")} AS event_time, severity FROM alerts
WHERE cluster_id = 'C2' AND bucket_date = DATE '2024-01-05' AND severity = 'WARNING'
ORDER BY alerts.event_time DESC, sensor_id, alert_id LIMIT 200""",
)
_add(
    "recent_alerts",
    f"""SELECT alert_id, sensor_id, {_t("event_time")} AS event_time FROM alerts WHERE alerts.{_RECENT}
ORDER BY alerts.event_time DESC, sensor_id, alert_id LIMIT 20""",
)
_add(
    "insights_page",
    f"""SELECT sensor_id, {_t("event_time")} AS event_time, {_r("anomaly_score")}, anomaly_level FROM scored
WHERE {_SENSOR_DAY} ORDER BY scored.event_time DESC LIMIT 120""",
    SCORES,
)
_add(
    "insights_by_level",
    f"""SELECT reading_id, {_r("anomaly_score")} FROM (SELECT * FROM scored ORDER BY event_time DESC, reading_id DESC LIMIT 500)
WHERE anomaly_level = 'WATCH'""",
    SCORES,
)
_add(
    "performance_page",
    f"""SELECT {ROLLUP_VIEW} FROM rollup_rows WHERE rollup_rows.metric_date = DATE '2024-01-03'
ORDER BY rollup_rows.minute_start DESC LIMIT 120""",
    SCORES,
    METRICS,
)
_add(
    "cluster_performance_page",
    f"""SELECT cluster_id, {_t("minute_start")} AS minute_start, processed_reading_count, alert_count, {_r("avg_anomaly_score")}
FROM metrics WHERE cluster_id = 'C1' AND CAST(metrics.minute_start AS DATE) = DATE '2024-01-03'
ORDER BY metrics.minute_start DESC LIMIT 50""",
    SCORES,
    METRICS,
)

# --- registry --------------------------------------------------------------------------------

_add("cluster_ids", "SELECT cluster_id FROM clusters UNION SELECT cluster_id FROM configs")
_add(
    "known_clusters",
    "SELECT station_cluster AS cluster_id, reading_id FROM readings WHERE station_cluster IN (SELECT cluster_id FROM clusters)",
)
_add(
    "config_dump",
    """SELECT coalesce(c.cluster_id, s.cluster_id) AS cluster_id, s.sensor_id, s.min_value AS "min", s.max_value AS "max",
  s.sensor_type AS "type", s.unit, CAST(s.measure_interval_s AS BIGINT) AS measure_interval_s,
  CAST(s.config_interval_s AS BIGINT) AS config_interval_s FROM clusters c FULL JOIN configs s ON c.cluster_id = s.cluster_id""",
)
_add(
    "config_patch",
    f"""SELECT coalesce(c.cluster_id, p.cluster_id) AS cluster_id, coalesce(c.sensor_id, p.sensor_id) AS sensor_id,
  CASE WHEN p.min_id IS NOT NULL THEN p.min_to ELSE c.min_value END AS min_value,
  CASE WHEN p.max_id IS NOT NULL THEN p.max_to ELSE c.max_value END AS max_value,
  CASE WHEN p.type_id IS NOT NULL THEN p.type_to ELSE c.sensor_type END AS sensor_type,
  CASE WHEN p.unit_id IS NOT NULL THEN nullif(p.unit_to, '') ELSE c.unit END AS unit,
  CAST(CASE WHEN p.measure_id IS NOT NULL THEN p.measure_to ELSE c.measure_interval_s END AS BIGINT) AS measure_interval_s,
  CAST(CASE WHEN p.config_id IS NOT NULL THEN p.config_to WHEN c.sensor_id IS NULL THEN 10 ELSE c.config_interval_s END AS BIGINT) AS config_interval_s,
  {_t("CASE WHEN p.sensor_id IS NULL THEN c.updated_at ELSE TIMESTAMP '2024-01-20 00:00:00' END")} AS updated_at
FROM configs c FULL JOIN (
  SELECT station_cluster AS cluster_id, station_sensor AS sensor_id,
    max(reading_id) FILTER (k < 20) AS min_id, arg_max(value, reading_id) FILTER (k < 20) AS min_to,
    max(reading_id) FILTER (k BETWEEN 20 AND 39) AS max_id, arg_max(value, reading_id) FILTER (k BETWEEN 20 AND 39) AS max_to,
    max(reading_id) FILTER (k BETWEEN 20 AND 59) AS unit_id,
    arg_max(CASE WHEN k < 40 THEN '' ELSE 'u' || k END, reading_id) FILTER (k BETWEEN 20 AND 59) AS unit_to,
    max(reading_id) FILTER (k BETWEEN 40 AND 59) AS measure_id, arg_max(k, reading_id) FILTER (k BETWEEN 40 AND 59) AS measure_to,
    max(reading_id) FILTER (k BETWEEN 60 AND 79) AS config_id, arg_max(k, reading_id) FILTER (k BETWEEN 60 AND 79) AS config_to,
    max(reading_id) FILTER (k BETWEEN 80 AND 89) AS type_id, arg_max(sensor_type, reading_id) FILTER (k BETWEEN 80 AND 89) AS type_to
  FROM readings GROUP BY ALL) p ON c.cluster_id = p.cluster_id AND c.sensor_id = p.sensor_id""",
)
ORACLE["sensor_refs"] = """WITH refs AS (
  SELECT event_id, CASE WHEN k < 50 THEN 'C' || c || 'S' || n WHEN k < 70 THEN ' c' || c || 's' || n || ' '
    WHEN k < 90 THEN n ELSE 'S' || n END AS ref
  FROM (SELECT event_id, user_id % 3 + 1 AS c, printf('%03d', user_id) AS n, CAST(json_extract(props, '$.k') AS INTEGER) AS k FROM events)),
tidied AS (SELECT *, upper(trim(ref)) AS tidy, regexp_matches(ref, '^C\\dS\\d{3}$') AS is_valid FROM refs)
SELECT event_id, ref, is_valid, CASE WHEN is_valid THEN substr(ref, 1, 2) END AS ref_cluster,
  CASE WHEN is_valid THEN substr(ref, 3) END AS ref_sensor,
  CASE WHEN starts_with(tidy, 'C') THEN tidy ELSE 'C' || tidy END AS as_cluster,
  CASE WHEN starts_with(tidy, 'S') THEN tidy ELSE 'S' || tidy END AS as_sensor FROM tidied"""
_add(
    "clamped_values",
    """SELECT r.reading_id, round(greatest(c.min_value, least(c.max_value, r.value)), 6) AS clamped
FROM readings r JOIN configs c ON r.sensor_id = c.cluster_id || c.sensor_id""",
)

# --- features, labels, risk ------------------------------------------------------------------

_add(
    "value_states",
    f"SELECT reading_id, {_state('value')} AS state, round({_distance('value')}, 6) AS distance FROM enriched",
)


def _slots(name: str, length: str, starts: str) -> str:
    return f"""
{name} AS (
  SELECT cluster_id AS location_id, start + INTERVAL {length} AS slot, {_MEASURES}
  FROM (SELECT *, {starts} AS start FROM enriched WHERE {_USABLE}) GROUP BY cluster_id, start, parameter)"""


_FEATURE_SELECT = f"SELECT location_id, {_t('slot')} AS prediction_time, "
_HALF_DAY = _slots("slots", "12 HOUR", "time_bucket(INTERVAL 12 HOUR, event_time, TIMESTAMP '1970-01-01')")
_add("window_features", _FEATURE_SELECT + _feature_view("12h") + " FROM wide", _HALF_DAY, _features("wide", "slots", "12h", 2))
_add(
    "stream_features",
    _FEATURE_SELECT + _feature_view("12h") + " FROM wide WHERE slot <= (SELECT max(event_time) FROM enriched)",
    _HALF_DAY,
    _features("wide", "slots", "12h", 2),
)
_OVERLAP = _slots(
    "slots",
    "12 HOUR",
    "unnest([time_bucket(INTERVAL 4 HOUR, event_time, TIMESTAMP '1970-01-01') - INTERVAL (h) HOUR FOR h IN [0, 4, 8]])",
)
_add("sliding_features", _FEATURE_SELECT + _feature_view("12h") + " FROM wide", _OVERLAP, _features("wide", "slots", "12h", 2))
_MOMENT = "event_time BETWEEN TIMESTAMP '2024-01-20 00:00:00' - INTERVAL {} HOUR AND TIMESTAMP '2024-01-20 00:00:00'"
_add(
    "features_at",
    _FEATURE_SELECT + _feature_view("24h") + " FROM wide",
    f"""
slots AS (SELECT cluster_id AS location_id, TIMESTAMP '2024-01-20 00:00:00' AS slot, {_MEASURES}
  FROM enriched WHERE {_USABLE} AND {_MOMENT.format(24)} GROUP BY cluster_id, parameter)""",
    _features("wide", "slots", "24h", 2),
)
_add(
    "stream_trailing_features",
    _FEATURE_SELECT + _feature_view("24h") + " FROM wide",
    f"""
moments AS (
  SELECT max(event_time) AS moment FROM enriched
  GROUP BY CASE WHEN event_time < TIMESTAMP '2024-01-11' THEN 1 WHEN event_time < TIMESTAMP '2024-01-21' THEN 2 ELSE 3 END),
slots AS (SELECT cluster_id AS location_id, moment AS slot, {_MEASURES}
  FROM enriched, moments WHERE {_USABLE} AND event_time BETWEEN moment - INTERVAL 24 HOUR AND moment GROUP BY cluster_id, moment, parameter)""",
    _features("wide", "slots", "24h", 2),
)
_add("active_locations", f"SELECT DISTINCT cluster_id AS location_id FROM enriched WHERE {_MOMENT.format(1)}")
_add(
    "trailing_measures",
    f"""SELECT reading_id, n, {_r("mean")}, {_r("std")},
  round(CASE WHEN elapsed > 0 THEN (latest - earliest) / (elapsed / 60e6) ELSE 0.0 END, 6) AS slope FROM (
  SELECT reading_id, count(*) OVER w AS n, avg(value) OVER w AS mean, coalesce(stddev_samp(value) OVER w, 0.0) AS std,
    arg_max(value, event_time) OVER w AS latest, arg_min(value, event_time) OVER w AS earliest,
    epoch_us(event_time) - epoch_us(min(event_time) OVER w) AS elapsed FROM enriched
  WINDOW w AS (PARTITION BY cluster_id, parameter ORDER BY event_time RANGE BETWEEN INTERVAL 12 HOUR PRECEDING AND CURRENT ROW))""",
)
SAMPLES = f"""
hourly AS (
  SELECT cluster_id || '-' || {_d("bucket_date")} AS run_id, CAST(hour(event_time) AS BIGINT) AS minute, parameter, avg(value) AS value
  FROM enriched WHERE parameter IN ({_quoted(PARAMETERS)}) GROUP BY ALL),
runs AS (SELECT run_id, max(value) AS peak, arg_max(minute, value) AS event_start FROM hourly GROUP BY run_id),
samples AS (
  SELECT h.*, r.event_start, CASE WHEN r.peak >= 120 THEN 'spike' ELSE 'normal' END AS scenario FROM hourly h JOIN runs r USING (run_id)),
sample_rows AS (
  SELECT s.run_id AS location_id, s.minute AS slot, s.parameter, count(*) OVER w AS n, s.value AS latest, avg(s.value) OVER w AS mean,
    coalesce(stddev_samp(s.value) OVER w, 0.0) AS std,
    CASE WHEN s.minute > first(s.minute) OVER w THEN (s.value - first(s.value) OVER w) / (s.minute - first(s.minute) OVER w) ELSE 0.0 END AS slope,
    u.normal_low, u.normal_high, u.critical_low, u.critical_high, u.threshold_scale
  FROM samples s LEFT JOIN rules u USING (parameter)
  WINDOW w AS (PARTITION BY s.run_id, s.parameter ORDER BY s.minute ROWS BETWEEN 4 PRECEDING AND CURRENT ROW)),
sample_slots AS (SELECT * FROM sample_rows WHERE slot >= 5)"""
for _name in ("training_windows", "training_files"):
    _add(
        _name,
        f"""SELECT r.run_id, CASE WHEN r.peak >= 120 THEN 'spike' ELSE 'normal' END AS scenario, slot AS minute, {_feature_view("5h")},
  CASE WHEN r.peak >= 120 AND slot >= r.event_start - 3 THEN 'spike' ELSE 'normal' END AS target_class
FROM wide JOIN runs r ON wide.location_id = r.run_id""",
        SAMPLES,
        _features("wide", "sample_slots", "5h", 1),
    )
_add(
    "horizon_labels",
    f"""SELECT reading_id, CAST(max(state) OVER (PARTITION BY sensor_id ORDER BY slot
    RANGE BETWEEN 1 FOLLOWING AND 432000000000 FOLLOWING) AS BIGINT) AS label
FROM (SELECT reading_id, sensor_id, epoch_us(event_time) AS slot, CAST({_CRITICAL} AS INTEGER) AS state FROM enriched)""",
)
_add(
    "run_split",
    f"""SELECT run_id, CASE WHEN (row_number() OVER (ORDER BY run_id) - 1) % 5 = 0 THEN 'test' ELSE 'train' END AS part, n AS rows
FROM (SELECT cluster_id || '-' || {_d("bucket_date")} AS run_id, count(*) AS n FROM enriched GROUP BY ALL)""",
)
_add(
    "first_per_class",
    f"""SELECT quality_status, reading_id, {_t("event_time")} AS event_time, {_r("value")} FROM enriched
QUALIFY row_number() OVER (PARTITION BY quality_status ORDER BY enriched.event_time, reading_id) = 1""",
)
_SHARES = ", ".join(f"p_{o}" for o in OUTCOMES)
_RANKED = " ".join(
    f"WHEN p_{o} >= greatest({', '.join('p_' + x for x in OUTCOMES if x != 'normal')}) THEN '{o}'"
    for o in OUTCOMES
    if o != "normal"
)
RISK = f"""
outcomes AS (
  SELECT cluster_id AS location_id, date_trunc('hour', event_time) + INTERVAL 1 HOUR AS prediction_time,
    CASE WHEN quality_status <> 'alert' THEN 'normal' ELSE (CASE WHEN {_LOW} THEN 'low' ELSE 'high' END)
      || (CASE WHEN {_CRITICAL} THEN '_critical' ELSE '_warning' END) END AS outcome FROM enriched),
shares AS (
  SELECT location_id, prediction_time, {", ".join(f"count(*) FILTER (outcome = '{o}') / count(*) AS p_{o}" for o in OUTCOMES)}
  FROM outcomes GROUP BY ALL),
leveled AS (
  SELECT *, round(1.0 - p_normal, 4) AS risk_score, CASE WHEN round(1.0 - p_normal, 4) < 0.35 THEN 'LOW'
    WHEN round(1.0 - p_normal, 4) < 0.60 THEN 'MEDIUM' WHEN round(1.0 - p_normal, 4) < 0.85 THEN 'HIGH' ELSE 'CRITICAL' END AS risk_level
  FROM shares),
predictions AS (
  SELECT *, CASE WHEN risk_level = 'LOW' THEN 'none' ELSE CASE {_RANKED} END END AS predicted_event_type FROM leveled)"""
_PREDICTION_VIEW = f"""location_id, {_d("prediction_time")} AS prediction_date, {_t("prediction_time")} AS prediction_time, {_r("risk_score")},
  risk_level, predicted_event_type,
  CASE WHEN risk_level = 'LOW' THEN 'Model sees low near-term degradation risk from the recent readings.'
    ELSE 'Model predicts ' || lower(risk_level) || ' risk of ' || replace(predicted_event_type, '_', ' ')
      || ' within the next {HORIZON_MINUTES} minutes.' END AS explanation,
  {", ".join(f"round(p_{o}, 4) AS p_{o}" for o in OUTCOMES)}"""
_add("risk_predictions", f"SELECT {_PREDICTION_VIEW} FROM predictions", RISK)
_add(
    "risk_bands",
    "SELECT risk_level, predicted_event_type, count(*) AS predictions, max(risk_score) AS max_score FROM predictions GROUP BY ALL",
    RISK,
)
_add(
    "predictions_page",
    f"""SELECT {_PREDICTION_VIEW} FROM (SELECT * FROM predictions WHERE CAST(prediction_time AS DATE) = DATE '2024-01-10'
  ORDER BY prediction_time DESC, location_id DESC LIMIT 160)""",
    RISK,
)
_add(
    "latest_prediction",
    f"""SELECT {_PREDICTION_VIEW} FROM (SELECT * FROM predictions WHERE location_id = 'C3' ORDER BY prediction_time DESC LIMIT 1)""",
    RISK,
)
_add(
    "probability_texts",
    """SELECT reading_id, CAST(CASE WHEN k < 30 THEN 0 ELSE 1 END AS BIGINT) AS entries,
  CASE WHEN k >= 30 THEN round(k / 100, 6) END AS normal FROM readings""",
)
JUDGED = f"""
judged AS (SELECT {_state("value")} AS label, {_state("rolling_average")} AS prediction FROM scored),
classes AS (SELECT DISTINCT label AS class FROM judged UNION SELECT DISTINCT prediction FROM judged),
tallies AS (
  SELECT class, (SELECT count(*) FROM judged WHERE label = class) AS support,
    (SELECT count(*) FROM judged WHERE prediction = class) AS claimed,
    (SELECT count(*) FROM judged WHERE label = class AND prediction = class) AS hits FROM classes)"""
_F1 = "coalesce(2 * hits / nullif(claimed + support, 0), 0.0)"
_add(
    "classification_report",
    f"""SELECT class, round(coalesce(hits / nullif(claimed, 0), 0.0), 6) AS precision, round(coalesce(hits / nullif(support, 0), 0.0), 6) AS recall,
  round({_F1}, 6) AS f1_score, support FROM tallies""",
    SCORES,
    JUDGED,
)
_add(
    "evaluation_summary",
    f"""SELECT CAST(sum(support) AS BIGINT) AS test_rows, round(sum(hits) / sum(support), 4) AS accuracy, round(avg({_F1}), 4) AS macro_f1
FROM tallies""",
    SCORES,
    JUDGED,
)
_add(
    "confusion_matrix",
    "SELECT label, "
    + ", ".join(f"count(*) FILTER (prediction = '{x}') AS predicted_{x}" for x in ("normal", "warning", "critical"))
    + " FROM judged GROUP BY label",
    SCORES,
    JUDGED,
)

# --- tables and streams ----------------------------------------------------------------------

_add(
    "stream_alarms",
    f"""SELECT sensor_id, alert_type, 'ACTIVE' AS state, arg_min(severity, event_time) AS severity, {_t("min(event_time)")} AS first_seen,
  {_t("min(event_time)")} AS last_seen, CAST(1 AS BIGINT) AS alert_count FROM episodes GROUP BY sensor_id, alert_type, episode
UNION ALL
SELECT sensor_id, alert_type, 'RESOLVED' AS state, CASE WHEN bool_or(severity = 'CRITICAL') THEN 'CRITICAL' ELSE 'WARNING' END AS severity,
  {_t("min(event_time)")} AS first_seen, {_t("max(event_time)")} AS last_seen, count(*) AS alert_count
FROM episodes GROUP BY sensor_id, alert_type, episode
HAVING any_value(episode) < max(episodes) OR (epoch_us(max(event_time)) + 172800000000) // 1000 + 1 <= (SELECT epoch_us(max(event_time)) // 1000 FROM alerts)""",
    """
gaps AS (
  SELECT *, CASE WHEN event_time - lag(event_time) OVER (PARTITION BY sensor_id, alert_type ORDER BY event_time, alert_id) > INTERVAL 2 DAY
    THEN 1 ELSE 0 END AS opens FROM alerts),
numbered AS (
  SELECT *, sum(opens) OVER (PARTITION BY sensor_id, alert_type ORDER BY event_time, alert_id) AS episode FROM gaps),
episodes AS (SELECT *, max(episode) OVER (PARTITION BY sensor_id, alert_type) AS episodes FROM numbered)""",
)

_add("forest_check", "SELECT 'rows' AS of, CAST(0 AS BIGINT) AS differing UNION ALL SELECT 'importances', CAST(0 AS BIGINT)")
_add(
    "stream_episodes",
    f"""SELECT sensor_id, alert_type, CASE WHEN bool_or(severity = 'CRITICAL') THEN 'CRITICAL' ELSE 'WARNING' END AS severity,
  {_t("min(event_time)")} AS first_seen, {_t("max(event_time)")} AS last_seen, count(*) AS alert_count
FROM numbered GROUP BY sensor_id, alert_type, episode
HAVING epoch_us(max(event_time)) + 172800000000 <= (SELECT epoch_us(max(event_time)) // 1000 * 1000 FROM alerts)""",
    """
gaps AS (
  SELECT *, CASE WHEN event_time - lag(event_time) OVER (PARTITION BY sensor_id, alert_type ORDER BY event_time, alert_id) >= INTERVAL 2 DAY
    THEN 1 ELSE 0 END AS opens FROM alerts),
numbered AS (
  SELECT *, sum(opens) OVER (PARTITION BY sensor_id, alert_type ORDER BY event_time, alert_id) AS episode FROM gaps)""",
)

_add(
    "stored_readings",
    f"""SELECT sensor_id, {_d("bucket_date")} AS bucket_date, {_t("event_time")} AS event_time, cluster_id, local_sensor_id, parameter,
  {_r("value")}, unit, CASE quality_status WHEN 'alert' THEN 'reviewed' ELSE quality_status END AS quality_status,
  {_t("CASE quality_status WHEN 'alert' THEN ingestion_time + INTERVAL 1 HOUR ELSE ingestion_time END")} AS ingestion_time FROM enriched""",
)
_add(
    "expired_readings",
    f"""SELECT cluster_id, parameter, {_d("bucket_date")} AS bucket_date, {_t("event_time")} AS event_time, sensor_id, local_sensor_id,
  {_r("value")}, unit, quality_status, {_t("ingestion_time")} AS ingestion_time FROM enriched
  WHERE event_time > TIMESTAMP '2024-04-15 00:00:00' - INTERVAL 90 DAY""",
)
_HOURS = "CASE WHEN quality_status <> 'alert' THEN 0 WHEN k >= 80 THEN 3 WHEN k >= 40 THEN 2 ELSE 1 END"
_add(
    "merged_readings",
    f"""SELECT sensor_id, {_d("bucket_date")} AS bucket_date, {_t("event_time")} AS event_time, cluster_id, local_sensor_id, parameter,
  {_r("value")}, unit, CASE {_HOURS} WHEN 0 THEN quality_status WHEN 1 THEN 'reviewed' WHEN 2 THEN 'confirmed' ELSE 'closed' END AS quality_status,
  {_t(f"ingestion_time + to_hours({_HOURS})")} AS ingestion_time FROM enriched
  WHERE event_time > TIMESTAMP '2024-04-15 00:00:00' - INTERVAL 90 DAY""",
)
_STORED_PREDICTION = _PREDICTION_VIEW.split(" AS explanation,")[0] + " AS explanation"
_add(
    "prediction_tables",
    f"""SELECT stored_in, * EXCLUDE (stored_in, prediction_date) FROM (
  SELECT 'ml_predictions_by_location_minute' AS stored_in, {_STORED_PREDICTION} FROM predictions
  UNION ALL
  SELECT 'latest_ml_predictions_by_location' AS stored_in, {_STORED_PREDICTION}
  FROM (SELECT * FROM predictions QUALIFY row_number() OVER (PARTITION BY location_id ORDER BY prediction_time DESC) = 1))""",
    RISK,
)
ORACLE["saved_model"] = "SELECT 0 AS differing"
_NOW = "alerts.bucket_date = DATE '2024-01-10' AND alerts.event_time >= TIMESTAMP '2024-01-10 12:00:00' - INTERVAL 6 HOUR"
_MEAN = "CAST(round(CAST(avg(value) AS DECIMAL(24, 10)), 3) AS DOUBLE)"
_add(
    "overview",
    f"""SELECT 'counts' AS part, 'active_sensor_count' AS name, NULL AS text, CAST(count(*) AS DOUBLE) AS number FROM configs
UNION ALL SELECT 'counts', 'active_alert_count', NULL, count(*) FROM alerts WHERE {_NOW}
UNION ALL SELECT 'counts', 'average_click', NULL, {_MEAN} FROM newest_readings WHERE parameter = 'click'
UNION ALL SELECT 'counts', 'average_error', NULL, {_MEAN} FROM newest_readings WHERE parameter = 'error'
UNION ALL SELECT 'status', 'system_status', CASE
    WHEN (SELECT coalesce(bool_or(severity = 'CRITICAL'), FALSE) FROM alerts WHERE {_NOW}) OR (SELECT bool_or(anomaly_level = 'CRITICAL') FROM newest_scores) THEN 'CRITICAL'
    WHEN EXISTS (FROM alerts WHERE {_NOW}) OR (SELECT bool_or(anomaly_level IN ('WATCH', 'WARNING')) FROM newest_scores) THEN 'WARNING'
    ELSE 'NORMAL' END, (SELECT count(*) FROM alerts WHERE {_NOW})
UNION ALL SELECT 'parameter_averages', coalesce(any_value(u.display_name), n.parameter),
    coalesce(nullif(arg_max(coalesce(n.unit, ''), (n.event_time, n.sensor_id)), ''), any_value(u.unit)), CAST(round(CAST(avg(n.value) AS DECIMAL(24, 10)), 3) AS DOUBLE)
  FROM newest_readings n LEFT JOIN rules u USING (parameter) GROUP BY n.parameter
UNION ALL SELECT 'latest_metric', 'processed_reading_count', strftime(minute_start, '%Y-%m-%d %H:%M'), processed_reading_count
  FROM rollup_rows WHERE minute_start = (SELECT max(minute_start) FROM metrics WHERE CAST(minute_start AS DATE) = DATE '2024-01-10')
UNION ALL SELECT 'latest_readings', sensor_id, quality_status, round(value, 6) FROM newest_readings
UNION ALL SELECT 'latest_ai', sensor_id, anomaly_level, round(anomaly_score, 6) FROM newest_scores
UNION ALL SELECT 'latest_ml_prediction', location_id, risk_level, risk_score FROM (FROM predictions ORDER BY prediction_time DESC, location_id LIMIT 1)
UNION ALL SELECT 'recent_alerts', alert_id, severity, round(value, 6)
  FROM (FROM alerts WHERE {_NOW} ORDER BY event_time DESC, sensor_id, alert_id LIMIT 20)""",
    SCORES,
    METRICS,
    LATEST,
    LATEST_SCORES,
    RISK,
)
