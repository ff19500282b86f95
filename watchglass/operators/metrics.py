"""Time-series metrics: alignment, reduction and health conditions.

Raw rows are reduced to one row per series and period first. Only those points
reach a window function, so its input is bounded by the length of the time
range and not by the number of events.
"""

from __future__ import annotations

from typing import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

# Limits of the health conditions.
BACKLOG_LIMIT = 10_000
BREACH_SECONDS = 60
ABSENT_SECONDS = 600

LABEL_PATTERN = r'"rule_name":\s*"([^"]+)"'


def labelled_counter(logs: DataFrame, message: str, marker: str, pattern: str = LABEL_PATTERN) -> DataFrame:
    """Log lines that hold `marker`, with the label their text names in `rule_name`."""
    return logs.where(F.contains(F.col(message), F.lit(marker))).withColumn(
        "rule_name", F.regexp_extract(message, pattern, 1)
    )


def _aligned(how: str, value: Column | None, seconds: int) -> Column:
    if how == "rate":
        amount = F.count(F.lit(1)) if value is None else F.sum(value)
        return amount / F.lit(float(seconds))
    if how == "sum":
        return F.count(F.lit(1)) if value is None else F.sum(value)
    return {"max": F.max, "mean": F.avg}[how](value)


def align(
    df: DataFrame,
    time: str,
    seconds: int,
    how: str,
    *,
    value: Column | None = None,
    series: Sequence[str] = (),
) -> DataFrame:
    """One point (`period`, `value`) per series and period: rate, sum, max or mean."""
    return df.groupBy(
        F.window(time, f"{seconds} seconds").start.alias("period"), *series
    ).agg(_aligned(how, value, seconds).alias("value"))


def reduce_sum(points: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Sum the points of all series that share a period and the `by` labels."""
    return points.groupBy("period", *by).agg(F.sum("value").alias("value"))


def breaches(
    points: DataFrame,
    limit: float,
    *,
    seconds: int = 60,
    hold: int = BREACH_SECONDS,
    series: Sequence[str] = (),
) -> DataFrame:
    """Runs of consecutive periods over the limit that last at least `hold` seconds."""
    over = points.where(F.col("value") > limit)
    order = Window.partitionBy(*series).orderBy("period")
    slot = (F.unix_seconds("period") / seconds).cast("bigint")
    runs = over.withColumn("__run", slot - F.row_number().over(order))
    return (
        runs.groupBy(*series, "__run")
        .agg(
            F.min("period").alias("breach_start"),
            F.timestamp_seconds(F.unix_seconds(F.max("period")) + seconds).alias("breach_end"),
            F.max("value").alias("peak"),
        )
        .drop("__run")
        .where(F.unix_seconds("breach_end") - F.unix_seconds("breach_start") >= hold)
    )


def absences(
    df: DataFrame,
    time: str,
    *,
    seconds: int = ABSENT_SECONDS,
    series: Sequence[str] = (),
    until: Column | None = None,
) -> DataFrame:
    """Stretches of more than `seconds` without a row; `until` closes the last one.

    A gap that long spans a whole minute, so the first and last row of each
    minute are enough to find it exactly.
    """
    if seconds < 60:
        raise ValueError("absences are found between minutes: use 60 seconds or more")
    minutes = df.groupBy(*series, F.date_trunc("MINUTE", time).alias("__minute")).agg(
        F.min(time).alias("__first"), F.max(time).alias("gap_start")
    )
    order = Window.partitionBy(*series).orderBy("__minute")
    following = F.lead("__first").over(order)
    end = following if until is None else F.coalesce(following, until)
    gap = F.unix_micros("gap_end") - F.unix_micros("gap_start")
    return (
        minutes.withColumn("gap_end", end)
        .where(gap > F.lit(seconds * 1_000_000))
        .select(*series, "gap_start", "gap_end")
    )


def freshness(df: DataFrame, ingest_time: str, event_time: str) -> DataFrame:
    """Largest seconds from event to ingestion, per minute of ingestion."""
    lag = (F.unix_micros(ingest_time) - F.unix_micros(event_time)) / 1000000
    return df.groupBy(F.window(ingest_time, "60 seconds").start.alias("period")).agg(
        F.max(lag).alias("lag_seconds")
    )


def any_condition(components: DataFrame, *conditions: DataFrame, key: str = "component") -> DataFrame:
    """A component is unhealthy when any condition has a row for it."""
    hits = conditions[0].select(key)
    for c in conditions[1:]:
        hits = hits.unionByName(c.select(key))
    flags = hits.groupBy(key).agg(F.lit(True).alias("unhealthy"))
    return components.join(flags, key, "left").withColumn(
        "unhealthy", F.coalesce("unhealthy", F.lit(False))
    )
