"""Joins of alerts with events, and of events with value lists."""

from __future__ import annotations

from typing import Sequence

from pyspark.sql import Column, DataFrame, functions as F


def alerts_with_events(
    alerts: DataFrame,
    events: DataFrame,
    key: Column,
    *,
    date: str = "partition_date",
    event_columns: Sequence[str],
) -> DataFrame:
    """Alerts joined with the events of their key on the days of their window.

    The day range becomes one row per alert and day, so the join is an equality
    on (key, day) and the day column prunes event partitions. A hot key is
    split over its days, and within one by Spark's skew join.
    """
    per_day = alerts.where(F.col("correlation_key").isNotNull()).select(
        "*", F.explode(F.sequence(F.to_date("window_start"), F.to_date("window_end"))).alias("__day")
    ).withColumnRenamed("correlation_key", "__key")
    side = events.select(
        key.cast("string").alias("__key"), F.col(date).cast("date").alias("__day"), *event_columns
    )
    joined = side.join(per_day, ["__key", "__day"])
    return joined.drop("__day").withColumnRenamed("__key", "correlation_key")


def in_value_list(
    events: DataFrame,
    field: Column,
    values: DataFrame,
    name: str,
) -> DataFrame:
    """Events whose field is in list `name` of a (name, value) table, any case.

    For lists too long to be literals in a rule. Catalyst broadcasts the list
    when it is small; with a longer one, Spark's skew join splits the events of
    a value that many of them share.
    """
    wanted = values.where(F.col("name") == name).select(F.lower("value").alias("__value")).distinct()
    keyed = events.withColumn("__value", F.lower(field.cast("string")))
    return keyed.join(wanted, ["__value"], "left_semi").drop("__value")
