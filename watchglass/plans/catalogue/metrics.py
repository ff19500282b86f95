"""MET*: metric series and health conditions over `events`."""

from __future__ import annotations

from pyspark.sql import functions as F

from ...operators import matching, metrics as m
from .common import EVENT_FIELDS, MATCHES_SQL, events, plain_times, rules


def _on(fn):
    return lambda spark, sf: plain_times(fn(events(spark, sf)))


def _labels(spark, sf):
    matched = matching.matches(events(spark, sf), rules().rules, EVENT_FIELDS, keep=["event_id"])
    logs = matching.match_records(matched, F.to_json(F.struct("event_id")))
    noise = logs.select(F.lit('{"event": "OTHER", "rule_name": "none"}').alias("record"))
    counted = m.labelled_counter(logs.unionByName(noise), "record", matching.MATCH_MARKER)
    return counted.groupBy("rule_name").agg(F.count(F.lit(1)).alias("n"))


def _sum_by_rule(spark, sf):
    matched = matching.matches(events(spark, sf), rules().rules, EVENT_FIELDS, keep=["event_time", "user_id"])
    points = m.align(matched, "event_time", 3600, "sum", series=["rule_name", "user_id"])
    return plain_times(m.reduce_sum(points, ["rule_name"]))


def _rate_by_rule(spark, sf):
    matched = matching.matches(events(spark, sf), rules().rules, EVENT_FIELDS, keep=["event_time", "user_id"])
    points = m.align(matched, "event_time", 60, "rate", series=["rule_name", "user_id"])
    out = m.reduce_sum(points, ["rule_name"])
    return plain_times(out.select("period", "rule_name", F.round("value", 9).alias("value")))


def _max_by_type(df):
    points = m.align(df, "event_time", 3600, "max", value=F.col("value"), series=["event_type", "user_id"])
    out = m.reduce_sum(points, ["event_type"])
    return out.select("period", "event_type", F.round("value", 4).alias("value"))


def _ingested(df):
    """Each event reaches the store up to a minute after it happened."""
    return df.withColumn(
        "ingest_time", F.timestamp_micros(F.unix_micros("event_time") + F.col("event_id") % 60 * 1000000)
    )


def _unhealthy(df):
    kinds = df.select(F.col("event_type").alias("component")).distinct()
    named = df.withColumnRenamed("event_type", "component")
    high = m.breaches(
        m.align(named, "event_time", 3600, "max", value=F.col("value"), series=["component"]),
        300, seconds=3600, hold=7200, series=["component"],
    )
    silent = m.absences(named, "event_time", seconds=8 * 3600, series=["component"])
    return m.any_condition(kinds, high, silent)


_HOURS_OVER = """
over AS (
  SELECT event_type, date_trunc('hour', ts) AS h, max(value) AS v FROM events GROUP BY 1, 2 HAVING max(value) > {t}
),
runs AS (
  SELECT *, epoch(h) / 3600 - row_number() OVER (PARTITION BY event_type ORDER BY h) AS run FROM over
),
breach AS (
  SELECT event_type, min(h) AS breach_start, max(h) + INTERVAL 1 HOUR AS breach_end, max(v) AS peak
  FROM runs GROUP BY event_type, run
)
"""
_GAPS = """
gaps AS (
  SELECT event_type, ts AS gap_start, lead(ts) OVER (PARTITION BY event_type ORDER BY ts) AS gap_end FROM events
)
"""

QUERIES = {
    "met_label": (_labels, f"WITH {MATCHES_SQL} SELECT rule_name, count(*) AS n FROM hits GROUP BY 1"),
    "met_rate": (
        _on(lambda d: m.align(d, "event_time", 60, "rate").select("period", F.round("value", 9).alias("value"))),
        "SELECT date_trunc('minute', ts) AS period, round(count(*) / 60.0, 9) AS value FROM events GROUP BY 1",
    ),
    "met_rate_by_rule": (
        _rate_by_rule,
        f"WITH {MATCHES_SQL} SELECT date_trunc('minute', ts) AS period, rule_name,"
        " round(count(*) / 60.0, 9) AS value FROM hits GROUP BY 1, 2",
    ),
    "met_sum": (
        _sum_by_rule,
        f"WITH {MATCHES_SQL} SELECT date_trunc('hour', ts) AS period, rule_name, count(*) AS value FROM hits GROUP BY 1, 2",
    ),
    "met_max": (
        _on(_max_by_type),
        "SELECT period, event_type, round(sum(v), 4) AS value FROM (SELECT date_trunc('hour', ts) AS period, event_type,"
        " user_id, max(value) AS v FROM events GROUP BY 1, 2, 3) GROUP BY 1, 2",
    ),
    "met_mean": (
        _on(lambda d: m.align(d, "event_time", 86400, "mean", value=F.col("value"), series=["event_type"])
            .select("period", "event_type", F.round("value", 6).alias("value"))),
        "SELECT date_trunc('day', ts) AS period, event_type, round(avg(value), 6) AS value FROM events GROUP BY 1, 2",
    ),
    "met_threshold": (
        _on(lambda d: m.breaches(
            m.align(d, "event_time", 3600, "max", value=F.col("value"), series=["event_type"]),
            60, seconds=3600, hold=7200, series=["event_type"])),
        f"WITH {_HOURS_OVER.format(t=60)} SELECT * FROM breach WHERE breach_end - breach_start >= INTERVAL 2 HOUR",
    ),
    "met_absence": (
        _on(lambda d: m.absences(d, "event_time", seconds=7200, series=["event_type"])),
        f"WITH {_GAPS} SELECT * FROM gaps WHERE gap_end - gap_start > INTERVAL 2 HOUR",
    ),
    "met_freshness": (
        _on(lambda d: m.freshness(_ingested(d), "ingest_time", "event_time")),
        "SELECT date_trunc('minute', ts + to_seconds(event_id % 60)) AS period,"
        " CAST(max(event_id % 60) AS DOUBLE) AS lag_seconds FROM events GROUP BY 1",
    ),
    "met_any_condition": (
        _on(_unhealthy),
        f"""WITH {_HOURS_OVER.format(t=300)}, {_GAPS}
        SELECT DISTINCT event_type AS component,
          event_type IN (SELECT event_type FROM breach WHERE breach_end - breach_start >= INTERVAL 2 HOUR)
          OR event_type IN (SELECT event_type FROM gaps WHERE gap_end - gap_start > INTERVAL 8 HOUR) AS unhealthy
        FROM events""",
    ),
}
