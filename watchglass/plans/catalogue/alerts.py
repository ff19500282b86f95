"""ANL*, JON* and NOT*: triage, dashboards, joins and routing over alerts."""

from __future__ import annotations

from pyspark.sql import functions as F

from ...operators import analytics as a
from ...operators import joins, routing
from ...operators import correlate as c
from ...operators.rules import ruleset_from_dicts
from ...sources.sinks import encode_alerts
from .common import ALERTS_SQL, EVENT_FIELDS, NOW, NOW_SQL, base_alerts, events, plain_times
from .correlations import COUNT, KIND_RULES, _COUNT_SQL

_SINCE = {s: f"fired_at > {NOW_SQL} - INTERVAL {s}" for s in ("36 HOUR", "7 DAY", "24 HOUR", "2 DAY")}


def _on_alerts(fn):
    return lambda spark, sf: plain_times(fn(base_alerts(spark, sf)))


def _stored(fn):
    """Alerts as the alert table stores them: arrays as JSON text."""
    return lambda spark, sf: plain_times(fn(encode_alerts(base_alerts(spark, sf))))


def _on_detections(fn):
    def run(spark, sf):
        found = a.detections(base_alerts(spark, sf), source_ip="$.user_id", hostname="$.event_type")
        return plain_times(fn(a.between(found, F.lit(NOW) - F.expr("INTERVAL 10 DAY"), NOW)))

    return run


# The dashboard's table in SQL, limited to its ten days.
_DETECTIONS_SQL = ALERTS_SQL + f""",
detections AS (
  SELECT fired_at AS timestamp, rule_name, severity, CAST(user_id AS VARCHAR) AS source_ip, event_id,
    CASE rule_id WHEN 'r-error' THEN 'credential_access' WHEN 'r-signup' THEN 'persistence'
      WHEN 'r-purchase' THEN 'exfiltration' WHEN 'r-click' THEN 'discovery' END AS mitre_tactic,
    CASE rule_id WHEN 'r-error' THEN 'T1110' WHEN 'r-purchase' THEN 'T1567.002'
      WHEN 'r-click' THEN 'T1046' END AS mitre_technique,
    CASE WHEN rule_id <> 'r-error' THEN event_type END AS hostname
  FROM alerts WHERE fired_at BETWEEN {NOW_SQL} - INTERVAL 10 DAY AND {NOW_SQL}
)
"""


def _d(select: str) -> str:
    return f"WITH {_DETECTIONS_SQL} {select}"


def _al(select: str) -> str:
    return f"WITH {ALERTS_SQL} {select}"


def _detections_view(df):
    return df.select(
        "timestamp", "rule_name", "severity", "mitre_tactic", "mitre_technique", "source_ip", "hostname",
        F.get_json_object("raw_event", "$.event_id").cast("bigint").alias("event_id"),
    )


def _recent(n):
    def run(df):
        return _detections_view(df).orderBy(F.desc("timestamp"), F.desc("event_id"), "rule_name").limit(n)

    return run


def _latency(spark, sf):
    from ...operators import matching
    from .common import alert_events, rules

    df = matching.matches(alert_events(spark, sf), rules().rules, EVENT_FIELDS, keep=["event_time", "fires"])
    return a.time_to_detection(df, "event_time", "fires").select(F.round("seconds", 6).alias("seconds"))


def _rows_since(spark, sf):
    return a.rows_since(events(spark, sf), "event_time", NOW, "3 DAY")


def _alerts_with_events(spark, sf):
    ev = events(spark, sf).withColumn("partition_date", F.to_date("event_time"))
    rs = ruleset_from_dicts([*KIND_RULES, COUNT])
    found = c.correlate(ev, rs, EVENT_FIELDS)
    out = joins.alerts_with_events(
        found, ev, F.col("user_id"), event_columns=["event_id", "event_type"]
    )
    return plain_times(out.select("rule_id", "correlation_key", "window_start", "event_id", "event_type"))


ROUTING = routing.Notifications.from_dict({
    "channels": [
        {"name": "oncall", "type": "email", "labels": {"email_address": "oncall@example.com"}},
        {"name": "soc", "type": "slack"},
        {"name": "pager", "type": "pagerduty"},
    ],
    "routes": [
        {"match": {"severity": "critical"}, "channels": ["oncall", "pager"]},
        {"match": {"rule_name": "new_signup"}, "channels": ["soc"]},
        {"match": {"severity": "high", "rule_name": "big_purchase"}, "channels": ["soc", "oncall"]},
        {"match": {"severity": "low", "rule_name": "error_burst"}, "channels": ["soc"]},
    ],
})

_ROUTED_SQL = ALERTS_SQL + """,
routed AS (
  SELECT *, 0 AS route FROM alerts WHERE severity = 'critical'
  UNION ALL SELECT *, 1 FROM alerts WHERE rule_name = 'new_signup'
  UNION ALL SELECT *, 2 FROM alerts WHERE severity = 'high' AND rule_name = 'big_purchase'
)
"""


def _routed(spark, sf):
    found = base_alerts(spark, sf).withColumn(
        "event_id", F.get_json_object(F.get("matched_events", F.lit(0)), "$.event_id").cast("bigint")
    )
    return routing.routed(found, ROUTING)


def _routes(spark, sf):
    return _routed(spark, sf).select("route", "rule_id", "event_id")


def _channels(spark, sf):
    return routing.to_channels(_routed(spark, sf), ROUTING).select("route", "channel", "channel_type", "event_id")


def _rate_limit(spark, sf):
    out = routing.rate_limited(_routed(spark, sf).select("route", "rule_id", "event_id", "fired_at"), 7200)
    return plain_times(out.select("route", "fired_at"))


_RATE_SQL = """WITH RECURSIVE """ + _ROUTED_SQL + """,
seconds AS (
  SELECT route, CAST(floor(epoch(fired_at)) AS BIGINT) AS s, min(fired_at) AS fired_at FROM routed GROUP BY 1, 2
),
kept AS (
  SELECT route, min(s) AS s FROM seconds GROUP BY 1
  UNION ALL
  SELECT k.route, (SELECT min(x.s) FROM seconds x WHERE x.route = k.route AND x.s >= k.s + 7200)
  FROM kept k WHERE k.s IS NOT NULL
)
SELECT route, fired_at FROM seconds JOIN kept USING (route, s)
"""

QUERIES = {
    "anl_top_rules": (
        _on_alerts(lambda d: a.top_rules(d, NOW, "36 HOUR")),
        _al(f"SELECT rule_id, rule_title, count(*) AS hits FROM alerts WHERE {_SINCE['36 HOUR']}"
            " GROUP BY 1, 2 ORDER BY hits DESC, rule_id LIMIT 10"),
    ),
    "anl_critical_today": (
        lambda spark, sf: plain_times(
            a.critical_today(base_alerts(spark, sf), F.lit(NOW) - F.expr("INTERVAL 1 SECOND"))
            .select("fired_at", "rule_id", "rule_title", "correlation_key", F.array_join("tags", ",").alias("tag_text"))
        ),
        _al("SELECT fired_at, rule_id, rule_title, CAST(NULL AS VARCHAR) AS correlation_key, tag_text FROM alerts"
            " WHERE severity = 'critical' AND fired_at > TIMESTAMP '2024-01-30 00:00:00'"),
    ),
    "anl_noisiest_keys": (
        lambda spark, sf: plain_times(a.noisiest_keys(
            c.correlate(events(spark, sf), ruleset_from_dicts([*KIND_RULES, COUNT]), EVENT_FIELDS),
            "cor-count", NOW, "7 DAY",
        )),
        f"SELECT correlation_key, count(*) AS fires, min(window_end) AS first_seen, max(window_end) AS last_seen"
        f" FROM ({_COUNT_SQL}) WHERE window_end > {NOW_SQL} - INTERVAL 7 DAY"
        " GROUP BY 1 ORDER BY fires DESC, correlation_key LIMIT 25",
    ),
    "anl_with_tag": (
        _stored(lambda d: a.with_tag(d, "attack.t1110", None)),
        _al("SELECT fired_at, rule_id, rule_title, severity FROM alerts WHERE rule_id = 'r-error'"),
    ),
    "anl_first_event": (
        _stored(lambda d: a.offending_events(d, "r-signup", NOW, "2 DAY").select(
            "rule_id", "rule_title", F.get_json_object("event", "$.event_id").cast("bigint").alias("event_id"))),
        _al(f"SELECT rule_id, rule_title, event_id FROM alerts WHERE rule_id = 'r-signup' AND {_SINCE['2 DAY']}"),
    ),
    "anl_hourly_by_severity": (
        _on_alerts(lambda d: a.hourly_by_severity(d, NOW)),
        _al(f"SELECT date_trunc('hour', fired_at) AS hour, severity, count(*) AS n FROM alerts"
            f" WHERE {_SINCE['24 HOUR']} GROUP BY 1, 2"),
    ),
    "anl_detections": (
        _on_detections(_detections_view),
        _d("SELECT timestamp, rule_name, severity, mitre_tactic,"
           " mitre_technique, source_ip, hostname, event_id FROM detections"),
    ),
    "anl_total": (_on_detections(a.total), _d("SELECT count(*) AS value FROM detections")),
    "anl_severity_tiles": (
        _on_detections(a.severity_tiles),
        _d("SELECT count(*) FILTER (severity = 'critical') AS critical, count(*) FILTER (severity = 'high') AS high,"
           " count(*) FILTER (severity = 'medium') AS medium, count(*) FILTER (severity = 'low') AS low FROM detections"),
    ),
    "anl_active_rules": (
        _on_detections(a.active_rules), _d("SELECT count(DISTINCT rule_name) AS value FROM detections"),
    ),
    "anl_health": (
        _on_detections(a.health),
        _d("SELECT CASE WHEN count(*) > 0 THEN 'Healthy' ELSE 'No Data' END AS value FROM detections"),
    ),
    "anl_heatmap": (
        _on_detections(a.severity_heatmap),
        _d("SELECT time_bucket(INTERVAL 5 MINUTE, timestamp) AS timestamp, severity, count(*) AS count"
           " FROM detections GROUP BY 1, 2"),
    ),
    "anl_top_firing": (
        _on_detections(a.top_firing),
        _d("SELECT rule_name, severity, mitre_tactic, mitre_technique, count(*) AS fire_count,"
           " max(timestamp) AS last_fired FROM detections GROUP BY 1, 2, 3, 4"
           " ORDER BY fire_count DESC, rule_name, severity LIMIT 20"),
    ),
    "anl_top_sources": (
        _on_detections(a.top_sources),
        _d("SELECT source_ip, count(*) AS count FROM detections GROUP BY 1 ORDER BY count DESC, source_ip LIMIT 10"),
    ),
    "anl_rate_per_minute": (
        lambda spark, sf: plain_times(a.rate_per_minute(events(spark, sf).withColumnRenamed("event_time", "timestamp"))),
        "SELECT date_trunc('minute', ts) AS timestamp, count(*) AS events_per_minute FROM events GROUP BY 1",
    ),
    "anl_recent": (
        _on_detections(_recent(100)),
        _d("SELECT timestamp, rule_name, severity, mitre_tactic, mitre_technique, source_ip, hostname, event_id"
           " FROM detections ORDER BY timestamp DESC, event_id DESC, rule_name LIMIT 100"),
    ),
    "anl_choices_severity": (
        _on_detections(lambda d: a.choices(d, "severity")), _d("SELECT DISTINCT severity FROM detections"),
    ),
    "anl_choices_rule": (
        _on_detections(lambda d: a.choices(d, "rule_name")), _d("SELECT DISTINCT rule_name FROM detections"),
    ),
    "anl_of_rule": (
        _on_detections(lambda d: a.of_rule(d, "big_purchase", 500).select("timestamp", "source_ip")),
        _d("SELECT timestamp, source_ip FROM detections WHERE rule_name = 'big_purchase'"
           " ORDER BY timestamp DESC, source_ip LIMIT 500"),
    ),
    "anl_time_to_detection": (
        _latency, _al("SELECT round(avg(epoch(fired_at) - epoch(ts)), 6) AS seconds FROM alerts"),
    ),
    "anl_rows_since": (
        _rows_since, f"SELECT count(*) AS value FROM events WHERE ts > {NOW_SQL} - INTERVAL 3 DAY",
    ),
    "jon_alerts_with_events": (
        _alerts_with_events,
        f"SELECT a.rule_id, a.correlation_key, a.window_start, e.event_id, e.event_type FROM ({_COUNT_SQL}) a"
        " JOIN events e ON CAST(e.user_id AS VARCHAR) = a.correlation_key"
        " AND CAST(e.ts AS DATE) BETWEEN CAST(a.window_start AS DATE) AND CAST(a.window_end AS DATE)",
    ),
    "not_routes": (_routes, f"WITH {_ROUTED_SQL} SELECT route, rule_id, event_id FROM routed"),
    "not_channels": (
        _channels,
        f"""WITH {_ROUTED_SQL}, pairs(route, channel, channel_type) AS (VALUES
          (0, 'oncall', 'email'), (0, 'pager', 'pagerduty'), (1, 'soc', 'slack'),
          (2, 'soc', 'slack'), (2, 'oncall', 'email'))
        SELECT route, channel, channel_type, event_id FROM routed JOIN pairs USING (route)""",
    ),
    "not_rate_limit": (_rate_limit, _RATE_SQL),
}
