"""Fixed schemas of what the engine emits."""

from __future__ import annotations

from pyspark.sql import types as T

# Severity names, lowest first; a rule without a level is medium.
SEVERITIES = ("informational", "low", "medium", "high", "critical")
DEFAULT_SEVERITY = "medium"

ALERT_COLUMNS = (
    "rule_id", "rule_title", "severity", "fired_at", "window_start",
    "window_end", "correlation_key", "matched_events", "tags",
)

ALERT_SCHEMA = T.StructType([
    T.StructField("rule_id", T.StringType()),
    T.StructField("rule_title", T.StringType()),
    T.StructField("severity", T.StringType()),
    T.StructField("fired_at", T.TimestampType()),
    T.StructField("window_start", T.TimestampType()),
    T.StructField("window_end", T.TimestampType()),
    T.StructField("correlation_key", T.StringType()),
    T.StructField("matched_events", T.ArrayType(T.StringType())),
    T.StructField("tags", T.ArrayType(T.StringType())),
])

DEAD_LETTER_SCHEMA = T.StructType([
    T.StructField("reason", T.StringType()),
    T.StructField("rule_id", T.StringType()),
    T.StructField("event", T.StringType()),
    T.StructField("error", T.StringType()),
    T.StructField("trace", T.StringType()),
])

# Reasons a record is sent to the dead-letter sink.
REASON_NOT_JSON = "non-JSON message"
REASON_PREDICATE = "predicate raised"

# Columns of an alert that a correlation over alerts may group by.
ALERT_KEY_FIELDS = ("rule_id", "rule_title", "severity", "correlation_key")
