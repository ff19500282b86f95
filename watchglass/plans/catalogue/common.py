"""Tables, rules and result helpers that the registered queries share."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from ...functions.fields import FieldMap
from ...operators import matching
from ...operators.rules import Ruleset, ruleset_from_dicts
from ...sources.events import table_events

# The tables cover 30 days from 2024-01-01; "now" in the triage queries.
NOW = dt.datetime(2024, 1, 31)
NOW_SQL = "TIMESTAMP '2024-01-31 00:00:00'"

EVENT_FIELDS = FieldMap(
    aliases={"event": "event_type", "user": "user_id", "latency_ms": "value"},
    json_columns=("props",),
)


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def events(spark: SparkSession, sf: str) -> DataFrame:
    return table_events(table(spark, sf, "events"))


def plain_times(df: DataFrame) -> DataFrame:
    """Timestamps without time zone, as the SQL side returns them (session is UTC)."""
    return df.select(*[
        F.col(f.name).cast("timestamp_ntz").alias(f.name)
        if isinstance(f.dataType, T.TimestampType) else F.col(f.name)
        for f in df.schema.fields
    ])


def one_rule(detection: dict, **spec) -> Ruleset:
    return ruleset_from_dicts([{"title": "probe", "detection": detection, **spec}])


def rows_matching(df: DataFrame, detection: dict, key: str, fields: FieldMap | None = None, **options) -> DataFrame:
    """Keys of the rows that a single rule matches."""
    rules = one_rule(detection).rules
    return matching.explode_hits(df, rules, fields, keep=[key], **options).select(key)


# Five rules over `events`, used by the matching and alert queries.
RULE_SPECS = [
    {
        "title": "Error Burst", "id": "r-error", "level": "critical",
        "tags": ["attack.t1110", "attack.credential_access"],
        "fields": ["event_id", "user_id"],
        "detection": {"sel": {"event": "error", "latency_ms|gte": 40}, "condition": "sel"},
    },
    {
        "title": "New Signup", "id": "r-signup", "level": "low", "tags": ["attack.persistence"],
        "detection": {"sel": {"event": "SIGNUP"}, "condition": "sel"},
    },
    {
        "title": "Big Purchase", "id": "r-purchase", "level": "high",
        "tags": ["attack.exfiltration", "attack.t1567.002"],
        "detection": {"sel": {"event": "purchase", "value|gt": 30}, "condition": "sel"},
    },
    {
        "title": "Odd View", "id": "r-view",
        "detection": {"sel": {"event": "view", "props.k": [1, 2, 3]}, "condition": "sel"},
    },
    {
        "title": "Click outside the nineties", "id": "r-click", "level": "informational",
        "tags": ["attack.discovery", "attack.t1046"],
        "detection": {
            "sel": {"event": "click"}, "nineties": {"props.k|startswith": "9"},
            "condition": "sel and not nineties",
        },
    },
]

# The same matches in SQL: one row per (event, rule).
MATCHES_SQL = """
hits AS (
  SELECT *, 'r-error' AS rule_id, 'Error Burst' AS rule_title, 'error_burst' AS rule_name,
         'critical' AS severity, 'attack.t1110,attack.credential_access' AS tag_text
  FROM events WHERE event_type = 'error' AND value >= 40
  UNION ALL
  SELECT *, 'r-signup', 'New Signup', 'new_signup', 'low', 'attack.persistence'
  FROM events WHERE event_type = 'signup'
  UNION ALL
  SELECT *, 'r-purchase', 'Big Purchase', 'big_purchase', 'high',
         'attack.exfiltration,attack.t1567.002'
  FROM events WHERE event_type = 'purchase' AND value > 30
  UNION ALL
  SELECT *, 'r-view', 'Odd View', 'odd_view', 'medium', ''
  FROM events WHERE event_type = 'view'
    AND CAST(json_extract_string(props, '$.k') AS INTEGER) BETWEEN 1 AND 3
  UNION ALL
  SELECT *, 'r-click', 'Click outside the nineties', 'click_outside_the_nineties',
         'informational', 'attack.discovery,attack.t1046'
  FROM events WHERE event_type = 'click'
    AND NOT starts_with(json_extract_string(props, '$.k'), '9')
)
"""

# Alerts fire a whole number of seconds after their event, so that delay is testable.
ALERTS_SQL = MATCHES_SQL + """,
alerts AS (
  SELECT *, ts + to_seconds(event_id % 60) AS fired_at FROM hits
)
"""


def rules() -> Ruleset:
    return ruleset_from_dicts(RULE_SPECS)


def alert_events(spark: SparkSession, sf: str) -> DataFrame:
    ev = events(spark, sf)
    return ev.withColumn("fires", F.timestamp_micros(F.unix_micros("event_time") + F.col("event_id") % 60 * 1000000))


def base_alerts(spark: SparkSession, sf: str) -> DataFrame:
    """Single-event alerts over `events`."""
    return matching.alerts(alert_events(spark, sf), rules().rules, EVENT_FIELDS, fired_at="fires")
