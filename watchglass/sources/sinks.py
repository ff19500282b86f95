"""Encodings and writers for raw events, alerts and dead letters."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..schema import ALERT_COLUMNS

REASON_NO_TIME = "event without a time"


def encode_alerts(alerts: DataFrame) -> DataFrame:
    """Alert rows with the two arrays as JSON text, as the alert table stores them."""
    return alerts.select(*[
        F.to_json(c).alias(c) if c in ("matched_events", "tags") else F.col(c) for c in ALERT_COLUMNS
    ])


def alert_messages(alerts: DataFrame) -> DataFrame:
    """Kafka records: JSON value, severity and rule_id as headers."""
    def header(name: str):
        return F.struct(F.lit(name).alias("key"), F.col(name).cast("binary").alias("value"))

    encoded = encode_alerts(alerts)
    return encoded.select(
        F.col("rule_id").alias("key"),
        F.to_json(F.struct(*ALERT_COLUMNS)).alias("value"),
        F.array(header("severity"), header("rule_id")).alias("headers"),
    )


def append_alerts(alerts: DataFrame, path: str) -> None:
    """Append to the alert table, one folder per day of `fired_at`."""
    (
        encode_alerts(alerts).withColumn("fired_date", F.to_date("fired_at"))
        .write.mode("append").partitionBy("fired_date").parquet(path)
    )


def letter_messages(letters: DataFrame) -> DataFrame:
    """Dead letters as topic messages: key, JSON value with all fields, the reason as header."""
    reason = F.struct(F.lit("reason").alias("key"), F.col("reason").cast("binary").alias("value"))
    fields = ("reason", "rule_id", "event", "error", "trace")
    return letters.select(
        F.coalesce("rule_id", F.lit("")).alias("key"),
        F.to_json(F.struct(*fields), {"ignoreNullFields": "false"}).alias("value"),
        F.array(reason).alias("headers"),
    )


def append_dead_letters(letters: DataFrame, path: str) -> None:
    letters.write.mode("append").json(path)


def dated_events(events: DataFrame, time: str, letters_path: str | None) -> DataFrame:
    """data and dt of parsed events, as the hot table stores them.

    An event without a time belongs to no day. Both writers of the hot table either send
    it to the dead letters or, without a path for these, fail; none is lost silently.
    """
    day = F.to_date(time)
    parsed = events.where(F.col("data").isNotNull())
    if letters_path is None:
        told = F.raise_error(F.lit(f"an event has no {time}, and there is no path for dead letters")).cast("date")
        return parsed.select("data", F.coalesce(day, told).alias("dt"))
    return parsed.where(F.col(time).isNotNull()).select("data", day.alias("dt"))


def no_time_letters(events: DataFrame, time: str) -> DataFrame:
    """Dead letters for parsed events without a time."""
    none = F.lit(None).cast("string")
    return events.where(F.col("data").isNotNull() & F.col(time).isNull()).select(
        F.lit(REASON_NO_TIME).alias("reason"), none.alias("rule_id"), F.to_json("data").alias("event"),
        F.lit(f"the event has no {time}").alias("error"), none.alias("trace"),
    )


def append_events(events: DataFrame, path: str, time: str = "ingest_time", letters_path: str | None = None) -> None:
    """Append parsed events to the hot table, one folder per day; see `dated_events`."""
    if letters_path is not None:
        append_dead_letters(no_time_letters(events, time), letters_path)
    dated_events(events, time, letters_path).write.mode("append").partitionBy("dt").parquet(path)


def backup_alerts(alerts: DataFrame, path: str) -> None:
    """Alerts as gzip-compressed JSON lines, times to the microsecond."""
    (
        alerts.write.mode("overwrite").option("compression", "gzip")
        .option("timestampFormat", "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX").json(path)
    )
