"""Tiers, retention, sinks."""

from __future__ import annotations

import datetime as dt
import gzip
import json

import pytest
from pyspark.sql import functions as F

from watchglass.operators.shaping import parse_events
from watchglass.sources import sinks, tiers

TODAY = dt.date(2024, 2, 20)


@pytest.fixture
def hot(spark, tmp_path):
    rows = [(json.dumps({"n": i, "u": "é"}), TODAY - dt.timedelta(days=i % 20)) for i in range(100)]
    df = parse_events(spark.createDataFrame(rows, "value string, day date"))
    path = str(tmp_path / "hot")
    sinks.append_events(df, path, time="day")
    return path


def test_scan_needs_days_and_prunes(spark, hot):
    with pytest.raises(ValueError):
        tiers.scan_hot(spark, hot)
    one = tiers.scan_hot(spark, hot, TODAY, TODAY)
    assert one.count() == 5
    plan = one._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(dt" in plan


def test_rollover_moves_a_day_and_those_missed(spark, hot, tmp_path):
    cold = str(tmp_path / "cold")
    (tmp_path / "hot" / "dt=__HIVE_DEFAULT_PARTITION__").mkdir()
    assert tiers.expire(spark, hot, TODAY, 10, exported_to=cold) == []
    assert tiers.rollover(spark, hot, cold, TODAY, age_days=13) == 35
    day = TODAY - dt.timedelta(days=13)
    assert tiers.partition_days(spark, cold) == [TODAY - dt.timedelta(days=d) for d in range(19, 12, -1)]
    assert day not in tiers.partition_days(spark, hot)
    view = tiers.create_events_view(spark, hot, cold, TODAY - dt.timedelta(days=30), TODAY)
    assert view.count() == 100
    got = spark.sql("SELECT try_variant_get(data, '$.u', 'string') AS u, partition_date FROM events_all"
                    f" WHERE partition_date = DATE '{day}'").collect()
    assert [r.u for r in got] == ["é"] * 5
    plan = view.where(F.col("partition_date") == F.lit(day))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("PartitionFilters: [isnotnull(dt") == 2
    files = list((tmp_path / "cold" / f"dt={day}").glob("*.parquet"))
    assert files and all("zstd" in f.name for f in files)
    assert tiers.rollover(spark, hot, cold, TODAY, age_days=13) == 0
    with pytest.raises(ValueError):
        tiers.rollover(spark, hot, cold, TODAY, age_days=14)


def counts(spark, hot, cold):
    first, last = TODAY - dt.timedelta(days=40), TODAY
    return (
        tiers.scan_hot(spark, hot, first, last, cold_path=cold).count(), tiers.scan_cold(spark, cold, first, last).count()
    )


def test_a_second_rollover_adds(spark, hot, tmp_path):
    cold = str(tmp_path / "cold")
    assert tiers.rollover(spark, hot, cold, TODAY) == 35
    day = TODAY - dt.timedelta(days=13)
    more = parse_events(spark.createDataFrame([(json.dumps({"n": 1000 + i}), day) for i in range(3)], "value string, day date"))
    sinks.append_events(more, hot, time="day")
    assert tiers.expire(spark, hot, TODAY, 10, exported_to=cold) == []  # it holds rows that were not exported
    assert tiers.rollover(spark, hot, cold, TODAY) == 3
    assert tiers.scan_cold(spark, cold, day, day).count() == 8 and counts(spark, hot, cold) == (65, 38)
    assert tiers.pending_moves(spark, cold) == [] and not any((tmp_path / "cold" / "_staging").iterdir())


@pytest.mark.parametrize("published,deleted", [(0, 0), (1, 0), (2, 1), (2, 2)])
def test_a_move_that_stops_is_finished_by_the_next(spark, hot, tmp_path, published, deleted):
    """At every stop each row is there once, in one tier."""
    cold, day = str(tmp_path / "cold"), TODAY - dt.timedelta(days=13)
    for i in range(2):
        more = parse_events(spark.createDataFrame([(json.dumps({"n": i}), day)], "value string, day date"))
        sinks.append_events(more, hot, time="day")
    tiers.rollover(spark, hot, cold, TODAY - dt.timedelta(days=1))  # the days before
    move = tiers.stage_move(spark, hot, cold, day, files=2)
    assert (move.rows, len(move.cold)) == (7, 2) and counts(spark, hot, cold) == (72, 30)
    tiers.commit_move(spark, cold, move)
    assert counts(spark, hot, cold) == (65, 37)
    (tmp_path / "cold" / f"dt={day}").mkdir(exist_ok=True)
    for name in move.cold[:published]:
        (tmp_path / "cold" / "_staging" / move.id / name).rename(tmp_path / "cold" / f"dt={day}" / name)
    for name in move.hot[:deleted]:
        (tmp_path / "hot" / name).unlink()
    assert counts(spark, hot, cold) == (65, 37)
    late = parse_events(spark.createDataFrame([(json.dumps({"n": 7}), day)], "value string, day date"))
    sinks.append_events(late, hot, time="day")
    assert tiers.rollover(spark, hot, cold, TODAY) == 1  # only what came meanwhile
    assert counts(spark, hot, cold) == (65, 38) and tiers.pending_moves(spark, cold) == []
    tiers.finish_move(spark, hot, cold, move)
    assert counts(spark, hot, cold) == (65, 38)


def test_a_move_that_was_not_committed_is_not_seen(spark, hot, tmp_path):
    cold = str(tmp_path / "cold")
    tiers.rollover(spark, hot, cold, TODAY)
    tiers.stage_move(spark, hot, cold, TODAY)
    assert counts(spark, hot, cold) == (65, 35)


def test_odd_folders_are_reported(spark, hot, tmp_path):
    (tmp_path / "hot" / "dt=__HIVE_DEFAULT_PARTITION__").mkdir()
    assert tiers.odd_partitions(spark, hot) == ["dt=__HIVE_DEFAULT_PARTITION__"]
    with pytest.warns(UserWarning, match="name no day"):
        tiers.expire(spark, hot, TODAY, 14)


def test_events_without_a_time(spark, tmp_path):
    rows = parse_events(spark.createDataFrame([('{"n": 1}', TODAY), ('{"n": 2}', None), ("torn", None)], "value string, day date"))
    with pytest.raises(Exception, match="no path for dead letters"):
        sinks.append_events(rows, str(tmp_path / "a"), time="day")
    sinks.append_events(rows, str(tmp_path / "b"), time="day", letters_path=str(tmp_path / "letters"))
    assert tiers.scan_hot(spark, str(tmp_path / "b"), TODAY, TODAY).count() == 1
    assert [r.event for r in spark.read.json(str(tmp_path / "letters")).collect()] == ['{"n":2}']


def test_expire(spark, hot):
    dropped = tiers.expire(spark, hot, TODAY, tiers.HOT_RETENTION_DAYS)
    assert dropped == [TODAY - dt.timedelta(days=d) for d in (19, 18, 17, 16, 15)]
    assert len(tiers.partition_days(spark, hot)) == 15
    assert tiers.expire(spark, hot + "-absent", TODAY, 1) == []


def test_storage_classes(spark):
    ages = spark.createDataFrame([(d,) for d in (0, 29, 30, 89, 90, 364, 365)], "age int")
    got = [r.c for r in ages.orderBy("age").select(tiers.storage_class(F.col("age")).alias("c")).collect()]
    assert got == ["STANDARD"] * 2 + ["NEARLINE"] * 2 + ["COLDLINE"] * 2 + ["ARCHIVE"]


def test_alert_table_and_backup(spark, tmp_path):
    from watchglass.operators.analytics import first_event, with_tag
    from watchglass.schema import ALERT_SCHEMA

    rows = [("r", "R", "high", dt.datetime(2024, 1, d, 23, 59), None, None, None, ['{"a":1}', "{}"], ["attack.t1110"])
            for d in (1, 2)]
    alerts = spark.createDataFrame(rows, ALERT_SCHEMA)
    sinks.append_alerts(alerts, str(tmp_path / "alerts"))
    stored = spark.read.parquet(str(tmp_path / "alerts"))
    assert sorted(p.name for p in (tmp_path / "alerts").glob("fired_date=*")) == ["fired_date=2024-01-01", "fired_date=2024-01-02"]
    assert {r.e for r in stored.select(first_event(stored).alias("e")).collect()} == {'{"a":1}'}
    assert with_tag(stored, "attack.t1110").count() == 2
    sinks.backup_alerts(stored, str(tmp_path / "backup"))
    lines = [x for f in (tmp_path / "backup").glob("*.json.gz") for x in gzip.open(f, "rt").read().splitlines()]
    assert len(lines) == 2 and json.loads(lines[0])["rule_id"] == "r"
    assert tiers.expire(spark, str(tmp_path / "alerts"), dt.date(2024, 2, 1), tiers.ALERT_RETENTION_DAYS, "fired_date") == [dt.date(2024, 1, 1)]


def test_checkpoint_dir_follows_the_setting(spark, tmp_path):
    from watchglass.plans import durable

    class Context:
        master = "spark://host:7077"

        def getCheckpointDir(self):
            return None

    class Conf:
        def get(self, *_):
            return None

    class Session:
        sparkContext, conf = Context(), Conf()

    with pytest.raises(RuntimeError):
        durable.checkpoint_dir(Session())
    assert durable.checkpoint_dir(spark)
