"""Triage queries and dashboard panels over alerts, detections and events."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, functions as F, types as T

from .routing import rule_name

Moment = "Column | dt.datetime | None"


def _now(now: Moment) -> Column:
    if now is None:
        return F.current_timestamp()
    return now if isinstance(now, Column) else F.lit(now)


def _since(now: Moment, span: str, column: str = "fired_at") -> Column:
    return F.col(column) > _now(now) - F.expr(f"INTERVAL {span}")


def tag_array(alerts: DataFrame, column: str = "tags") -> Column:
    """Tags as an array, whether stored as an array or as JSON text."""
    if isinstance(alerts.schema[column].dataType, T.StringType):
        return F.from_json(column, "array<string>")
    return F.col(column)


def top_rules(alerts: DataFrame, now: Moment = None, span: str = "1 HOUR", n: int = 10) -> DataFrame:
    return (
        alerts.where(_since(now, span)).groupBy("rule_id", "rule_title")
        .agg(F.count(F.lit(1)).alias("hits"))
        .orderBy(F.desc("hits"), "rule_id").limit(n)
    )


def critical_today(alerts: DataFrame, now: Moment = None, severity: str = "critical") -> DataFrame:
    return (
        alerts.where((F.col("severity") == severity) & (F.col("fired_at") > F.date_trunc("DAY", _now(now))))
        .select("fired_at", "rule_id", "rule_title", "correlation_key", "tags")
        .orderBy(F.desc("fired_at"), "rule_id", "correlation_key")
    )


def noisiest_keys(
    alerts: DataFrame, rule_id: str, now: Moment = None, span: str = "7 DAY", n: int = 25
) -> DataFrame:
    return (
        alerts.where((F.col("rule_id") == rule_id) & _since(now, span)).groupBy("correlation_key")
        .agg(
            F.count(F.lit(1)).alias("fires"),
            F.min("fired_at").alias("first_seen"),
            F.max("fired_at").alias("last_seen"),
        )
        .orderBy(F.desc("fires"), "correlation_key").limit(n)
    )


def with_tag(alerts: DataFrame, tag: str, n: int | None = 50) -> DataFrame:
    out = (
        alerts.where(F.array_contains(tag_array(alerts), tag))
        .select("fired_at", "rule_id", "rule_title", "severity")
        .orderBy(F.desc("fired_at"), "rule_id")
    )
    return out if n is None else out.limit(n)


def first_event(alerts: DataFrame, column: str = "matched_events") -> Column:
    """First matched event as JSON text, whether stored as an array or JSON text."""
    if isinstance(alerts.schema[column].dataType, T.StringType):
        return F.get_json_object(column, "$[0]")
    return F.get(F.col(column), F.lit(0))


def offending_events(
    alerts: DataFrame, rule_id: str, now: Moment = None, span: str = "1 HOUR"
) -> DataFrame:
    return (
        alerts.where((F.col("rule_id") == rule_id) & _since(now, span))
        .select("rule_id", "rule_title", first_event(alerts).alias("event"), "fired_at")
        .orderBy(F.desc("fired_at"), "event")
    )


def hourly_by_severity(alerts: DataFrame, now: Moment = None, span: str = "24 HOUR") -> DataFrame:
    return (
        alerts.where(_since(now, span))
        .groupBy(F.date_trunc("HOUR", "fired_at").alias("hour"), "severity")
        .agg(F.count(F.lit(1)).alias("n"))
        .orderBy(F.desc("hour"), "severity")
    )


# -- detections: alerts with fields of their event ---------------------------

def mitre_technique(tags: Column) -> Column:
    hits = F.filter(tags, lambda t: t.rlike(r"^attack\.t\d"))
    return F.upper(F.regexp_extract(F.get(hits, F.lit(0)), r"^attack\.(t\d+(?:\.\d+)?)", 1))


def mitre_tactic(tags: Column) -> Column:
    hits = F.filter(tags, lambda t: t.rlike(r"^attack\.[a-z][a-z_-]*$"))
    return F.regexp_extract(F.get(hits, F.lit(0)), r"^attack\.(.*)$", 1)


def detections(
    alerts: DataFrame,
    *,
    source_ip: str = "$.source_ip",
    destination_ip: str = "$.destination_ip",
    hostname: str = "$.hostname",
) -> DataFrame:
    """The dashboard's table: alert fields beside fields of the first matched event."""
    tags = tag_array(alerts)
    raw = first_event(alerts)
    return alerts.select(
        F.col("fired_at").alias("timestamp"),
        rule_name("rule_title").alias("rule_name"),
        "severity",
        mitre_tactic(tags).alias("mitre_tactic"),
        mitre_technique(tags).alias("mitre_technique"),
        F.get_json_object(raw, source_ip).alias("source_ip"),
        F.get_json_object(raw, destination_ip).alias("destination_ip"),
        F.get_json_object(raw, hostname).alias("hostname"),
        raw.alias("raw_event"),
    )


def between(df: DataFrame, start: Moment, end: Moment, column: str = "timestamp") -> DataFrame:
    """The dashboard's time filter, both ends included."""
    return df.where(F.col(column).between(_now(start), _now(end)))


def total(df: DataFrame) -> DataFrame:
    return df.agg(F.count(F.lit(1)).alias("value"))


def severity_tiles(df: DataFrame) -> DataFrame:
    """Counts of the four severity tiles in one pass."""
    return df.agg(*[
        F.count_if(F.col("severity") == s).alias(s) for s in ("critical", "high", "medium", "low")
    ])


def active_rules(df: DataFrame) -> DataFrame:
    return df.agg(F.count_distinct("rule_name").alias("value"))


def health(df: DataFrame) -> DataFrame:
    return df.agg(F.when(F.count(F.lit(1)) > 0, "Healthy").otherwise("No Data").alias("value"))


def severity_heatmap(df: DataFrame, bucket: str = "5 minutes") -> DataFrame:
    return (
        df.groupBy(F.window("timestamp", bucket).start.alias("timestamp"), "severity")
        .agg(F.count(F.lit(1)).alias("count"))
    )


def top_firing(df: DataFrame, n: int = 20) -> DataFrame:
    return (
        df.groupBy("rule_name", "severity", "mitre_tactic", "mitre_technique")
        .agg(F.count(F.lit(1)).alias("fire_count"), F.max("timestamp").alias("last_fired"))
        .orderBy(F.desc("fire_count"), "rule_name", "severity").limit(n)
    )


def top_sources(df: DataFrame, n: int = 10, column: str = "source_ip") -> DataFrame:
    return (
        df.groupBy(column).agg(F.count(F.lit(1)).alias("count"))
        .orderBy(F.desc("count"), column).limit(n)
    )


def rate_per_minute(df: DataFrame) -> DataFrame:
    return df.groupBy(F.window("timestamp", "1 minute").start.alias("timestamp")).agg(
        F.count(F.lit(1)).alias("events_per_minute")
    )


def recent(df: DataFrame, n: int = 100) -> DataFrame:
    ties = [c for c in df.columns if c != "timestamp"]
    return df.orderBy(F.desc("timestamp"), *ties).limit(n)


def choices(df: DataFrame, column: str) -> DataFrame:
    """Distinct values of a dashboard filter."""
    return df.select(column).distinct().orderBy(column)


def of_rule(df: DataFrame, name: str, n: int = 500) -> DataFrame:
    return recent(df.where(F.col("rule_name") == name), n)


def time_to_detection(df: DataFrame, event_time: str, fired_at: str = "fired_at") -> DataFrame:
    """Mean seconds from the event to its alert."""
    lag = (F.unix_micros(fired_at) - F.unix_micros(event_time)) / 1000000
    return df.agg(F.avg(lag).alias("seconds"))


def rows_since(df: DataFrame, column: str, now: Moment = None, span: str = "1 HOUR") -> DataFrame:
    return total(df.where(_since(now, span, column)))
