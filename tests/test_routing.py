"""Notification routes and metric conditions."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from watchglass.operators import metrics, routing

CHANNELS = [{"name": "a", "type": "email"}, {"name": "b", "type": "slack"}]


@pytest.mark.parametrize("spec,words", [
    ({"channels": [{"name": "a", "type": "fax"}], "routes": []}, "no known type"),
    ({"channels": CHANNELS + CHANNELS[:1], "routes": []}, "two channels"),
    ({"channels": CHANNELS, "routes": [{"match": {"host": "x"}, "channels": ["a"]}]}, "match key"),
    ({"channels": CHANNELS, "routes": [{"match": {}, "channels": ["z"]}]}, "unknown channel"),
    ({"channels": CHANNELS, "routes": [{"match": {}, "channels": []}]}, "reach nobody"),
])
def test_bad_configs(spec, words):
    with pytest.raises(ValueError, match=words):
        routing.Notifications.from_dict(spec)


def test_routes_and_channels(spark):
    config = routing.Notifications.from_dict({"channels": CHANNELS, "routes": [
        {"match": {"severity": "high"}, "channels": ["a", "b"]},
        {"match": {"severity": "high", "rule_name": "it_s_on"}, "channels": ["b"]},
        {"match": {}, "channels": ["a"]},
    ]})
    alerts = spark.createDataFrame([("It's on!", "high"), ("Other", "high"), ("Other", "low")], "rule_title string, severity string")
    out = routing.routed(alerts, config)
    assert sorted((r.rule_title, r.severity, r.route) for r in out.collect()) == [
        ("It's on!", "high", 0), ("It's on!", "high", 1), ("It's on!", "high", 2),
        ("Other", "high", 0), ("Other", "high", 2), ("Other", "low", 2)]
    assert sorted((r.route, r.channel) for r in routing.to_channels(out, config).collect()) == [
        (0, "a"), (0, "a"), (0, "b"), (0, "b"), (1, "b"), (2, "a"), (2, "a"), (2, "a")]


def test_rate_limit_with_one_hot_route(spark):
    df = spark.range(50_000).selectExpr("0 AS route", "CAST(id AS STRING) AS rule_id", "timestamp_seconds(id DIV 50) AS fired_at")
    got = sorted(int(r.fired_at.timestamp()) for r in routing.rate_limited(df).collect())
    assert got == [0, 300, 600, 900]


def test_breach_needs_consecutive_periods(spark):
    points = spark.createDataFrame([(0, 5.0), (60, 20.0), (120, 30.0), (180, 1.0), (240, 11.0)], "s long, value double").select(
        F.timestamp_seconds("s").alias("period"), "value")
    runs = metrics.breaches(points, 10).collect()
    assert sorted((int(r.breach_start.timestamp()), int(r.breach_end.timestamp()), r.peak) for r in runs) == [
        (60, 180, 30.0), (240, 300, 11.0)]
    assert metrics.breaches(points, 10, hold=120).count() == 1


def test_absence_with_an_open_end(spark):
    df = spark.createDataFrame([(0,), (30,), (630,), (1231,), (1232,)], "s long").select(F.timestamp_seconds("s").alias("t"))
    gaps = metrics.absences(df, "t").collect()
    assert [(int(r.gap_start.timestamp()), int(r.gap_end.timestamp())) for r in gaps] == [(630, 1231)]
    open_ = metrics.absences(df, "t", until=F.timestamp_seconds(F.lit(5000))).collect()
    assert len(open_) == 2
    with pytest.raises(ValueError):
        metrics.absences(df, "t", seconds=30)
