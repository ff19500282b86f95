"""SRC*, SNK* and RET*: tiers, encodings and retention over `events`."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from ...operators import shaping
from ...operators.matching import not_json_letters
from ...sources import sinks, tiers
from ...sources.events import messages
from ..durable import materialize
from .common import ALERTS_SQL, NOW_SQL, base_alerts, events, plain_times

_TODAY = dt.date(2024, 1, 31)


def _tiers(spark, sf):
    """Events as two tiers: the last 14 days hot, the days before them cold."""
    rows = events(spark, sf).select(
        F.try_parse_json(F.to_json(F.struct("event_id", "user_id", "event_type"))).alias("data"),
        F.to_date("event_time").alias("dt"),
    )
    edge = F.lit(_TODAY - dt.timedelta(days=14))
    return rows.where(F.col("dt") >= edge), tiers.export_rows(rows.where(F.col("dt") < edge))


def _events_all(spark, sf):
    view = tiers.events_all(*_tiers(spark, sf))
    return view.select(
        F.try_variant_get("data", "$.event_id", "bigint").alias("event_id"),
        F.try_variant_get("data", "$.event_type", "string").alias("event_type"),
        "partition_date",
    )


def _messages(spark, sf):
    """Records as a topic delivers them, with a repeated header."""
    records = events(spark, sf).select(
        F.encode(F.to_json(F.struct("event_id", "event_type")), "UTF-8").alias("value"),
        F.array(
            F.struct(F.lit("source").alias("key"), F.encode(F.lit("old"), "UTF-8").alias("value")),
            F.struct(F.lit("source").alias("key"), F.encode("event_type", "UTF-8").alias("value")),
        ).alias("headers"),
        F.col("event_time").alias("timestamp"),
    )
    parsed = shaping.parse_events(messages(records))
    return plain_times(parsed.select(
        F.try_variant_get("data", "$.event_id", "bigint").alias("event_id"),
        F.try_element_at("attributes", F.lit("source")).alias("source"), "ingest_time",
    ))


def _duplicate_keys(spark, sf):
    """Documents that give a key twice; the last one counts."""
    text = F.concat(F.lit('{"k": "first", "n": '), F.col("event_id"), F.lit(', "k": "'), F.col("event_type"), F.lit('"}'))
    parsed = shaping.parse_events(events(spark, sf).select(text.cast("binary").alias("value")))
    return parsed.select(
        F.try_variant_get("data", "$.n", "bigint").alias("event_id"),
        F.try_variant_get("data", "$.k", "string").alias("k"),
    )


def _letter_messages(spark, sf):
    text = F.concat(F.lit("torn "), F.col("event_id"))
    parsed = shaping.parse_events(events(spark, sf).select(text.cast("binary").alias("value")))
    out = sinks.letter_messages(not_json_letters(parsed))
    return out.select(
        F.get_json_object("value", "$.event").alias("event"),
        F.get("headers", F.lit(0))["value"].cast("string").alias("reason"),
        (F.get_json_object("value", "$.rule_id").isNull() & F.contains("value", F.lit('"rule_id":null'))).alias("no_rule"),
    )


def _encoded(spark, sf):
    rows = sinks.encode_alerts(base_alerts(spark, sf))
    return rows.select(
        "rule_id", F.col("tags"),
        F.get_json_object(F.get_json_object("matched_events", "$[0]"), "$.event_id").cast("bigint").alias("event_id"),
    )


def _alert_messages(spark, sf):
    out = sinks.alert_messages(base_alerts(spark, sf))
    header = lambda i: F.get("headers", F.lit(i))
    return out.select(
        "key", header(0)["key"].alias("first_header"), header(0)["value"].cast("string").alias("severity"),
        header(1)["value"].cast("string").alias("rule_id"),
        F.get_json_object("value", "$.rule_title").alias("rule_title"),
    )


def _retention(spark, sf):
    days = events(spark, sf).select(F.to_date("event_time").alias("dt")).distinct()
    return tiers.retention_plan(days, F.lit(_TODAY))


def _classes(spark, sf):
    days = events(spark, sf).select(
        F.date_sub(F.to_date("event_time"), F.col("user_id").cast("int") * 3).alias("dt")
    ).distinct()
    return tiers.retention_plan(days, F.lit(_TODAY)).select("dt", "storage_class")


def _late(spark, sf):
    rows = events(spark, sf).select(
        F.to_date("event_time").alias("event_date"),
        F.date_add(F.to_date("event_time"), (F.col("event_id") % 20).cast("int")).alias("ingest_date"),
    )
    return tiers.late_arrivals(rows, "ingest_date", "event_date")


def _rollover(spark, sf):
    """Rows per tier and day after the days of age 13 and more have moved to a cold tier in use."""
    import uuid

    from ..durable import checkpoint_dir

    hot, cold = _tiers(spark, sf)
    root = f"{checkpoint_dir(spark)}/tiers-{uuid.uuid4().hex}"
    hot.write.partitionBy("dt").parquet(f"{root}/hot")
    cold.write.partitionBy("dt").parquet(f"{root}/cold")
    tiers.rollover(spark, f"{root}/hot", f"{root}/cold", _TODAY)
    first, last = _TODAY - dt.timedelta(days=40), _TODAY
    count = lambda df, tier: df.groupBy(F.lit(tier).alias("tier"), "dt").agg(F.count(F.lit(1)).alias("n"))
    return count(tiers.scan_hot(spark, f"{root}/hot", first, last), "hot").unionByName(
        count(tiers.scan_cold(spark, f"{root}/cold", first, last), "cold")
    )


def _tables(spark, hot=None, cold=None):
    """Paths of a hot and a cold table in the shared folder, with the given rows."""
    import uuid

    from ..durable import checkpoint_dir

    root = f"{checkpoint_dir(spark)}/tiers-{uuid.uuid4().hex}"
    if hot is not None:
        hot.write.partitionBy("dt").parquet(f"{root}/hot")
    if cold is not None:
        cold.write.partitionBy("dt").parquet(f"{root}/cold")
    return f"{root}/hot", f"{root}/cold"


def _tier_counts(spark, hot, cold, phase):
    """Rows, and the sum of their ids, by tier and day, each tier as its readers see it."""
    first, last = _TODAY - dt.timedelta(days=60), _TODAY
    rows = lambda data, tier: data.select(
        F.lit(tier).alias("tier"), "dt", F.try_variant_get("data", "$.event_id", "bigint").alias("id")
    )
    cold_rows = tiers.scan_cold(spark, cold, first, last).withColumn("data", F.try_parse_json("data"))
    both = rows(tiers.scan_hot(spark, hot, first, last, cold_path=cold), "hot").unionByName(rows(cold_rows, "cold"))
    return both.groupBy(F.lit(phase).alias("phase"), "tier", "dt").agg(
        F.count(F.lit(1)).alias("n"), F.sum("id").alias("ids")
    )


def _id(data="data"):
    return F.try_variant_get(data, "$.event_id", "bigint")


def _rollover_twice(spark, sf):
    """A third of each hot day arrives after the day has been exported, and is exported as well."""
    hot, cold = _tiers(spark, sf)
    late = _id() % 3 == 0
    paths = _tables(spark, hot.where(~late), cold)
    tiers.rollover(spark, *paths, _TODAY)
    hot.where(late).write.mode("append").partitionBy("dt").parquet(paths[0])
    before = materialize(_tier_counts(spark, *paths, "late rows"))
    tiers.rollover(spark, *paths, _TODAY)
    return before.unionByName(_tier_counts(spark, *paths, "second export"))


def _rollover_resumed(spark, sf):
    """A move that stops in the midst of deleting its hot day, and the run that finishes it."""
    hot, cold = _tiers(spark, sf)
    paths = _tables(spark, hot.repartition(8), cold)
    day = _TODAY - dt.timedelta(days=13)
    move = tiers.stage_move(spark, *paths, day)
    staged = materialize(_tier_counts(spark, *paths, "staged"))
    tiers.commit_move(spark, paths[1], move)
    for name in move.hot[::2]:
        tiers._delete(spark, f"{paths[0]}/{name}")
    stopped = materialize(_tier_counts(spark, *paths, "stopped"))
    tiers.rollover(spark, *paths, _TODAY)
    return staged.unionByName(stopped).unionByName(_tier_counts(spark, *paths, "finished"))


def _expire(spark, sf):
    """Days that stay after 10: all exported ones go, a day with rows that were not exported stays."""
    hot, cold = _tiers(spark, sf)
    paths = _tables(spark, hot, cold)
    tiers.rollover(spark, *paths, _TODAY, age_days=12)
    late = hot.where((F.col("dt") == F.lit(_TODAY - dt.timedelta(days=12))) & (_id() % 5 == 0))
    late.write.mode("append").partitionBy("dt").parquet(paths[0])
    tiers.expire(spark, paths[0], _TODAY, 10, exported_to=paths[1])
    tiers.expire(spark, paths[1], _TODAY, 20)
    return _tier_counts(spark, *paths, "expired")


def _backup(spark, sf):
    """Alerts written as compressed JSON lines and read back."""
    import uuid

    from ...schema import ALERT_SCHEMA
    from ..durable import checkpoint_dir

    path = f"{checkpoint_dir(spark)}/backup-{uuid.uuid4().hex}"
    sinks.backup_alerts(base_alerts(spark, sf), path)
    back = spark.read.schema(ALERT_SCHEMA).json(path)
    return plain_times(back.select("rule_id", "severity", "fired_at", F.array_join("tags", ",").alias("tag_text")))


def _replayed(spark, sf):
    """Events as files of JSON lines, read back by path."""
    import uuid

    from ...sources.events import file_events
    from ..durable import checkpoint_dir

    path = f"{checkpoint_dir(spark)}/replay-{uuid.uuid4().hex}"
    rows = events(spark, sf).select("event_type", F.to_json(F.struct("event_id", "event_type")).alias("value"))
    rows.write.partitionBy("event_type").text(path)
    return file_events(spark, path).select(
        _id().alias("event_id"),
        F.regexp_extract("path", "event_type=([^/]+)/", 1).alias("folder"),
        F.try_variant_get("data", "$.event_type", "string").alias("event_type"),
    )


def _raw_events(spark, sf):
    """Events to the hot table; those without a time, every seventh, to the dead letters."""
    import uuid

    from ..durable import checkpoint_dir

    root = f"{checkpoint_dir(spark)}/raw-{uuid.uuid4().hex}"
    rows = events(spark, sf).select(
        F.try_parse_json(F.to_json(F.struct("event_id"))).alias("data"),
        F.when(F.col("event_id") % 7 != 0, F.col("event_time")).alias("ingest_time"),
    )
    sinks.append_events(rows, f"{root}/hot", letters_path=f"{root}/letters")
    first, last = _TODAY - dt.timedelta(days=60), _TODAY
    stored = tiers.scan_hot(spark, f"{root}/hot", first, last).select(_id().alias("event_id"), "dt", F.lit("").alias("reason"))
    letters = spark.read.schema("reason string, rule_id string, event string, error string, trace string").json(f"{root}/letters")
    return stored.unionByName(letters.select(
        F.get_json_object("event", "$.event_id").cast("bigint").alias("event_id"),
        F.lit(None).cast("date").alias("dt"), "reason",
    ))


def _tiers_sql(*phases):
    """SQL of `_tier_counts` for phases (name, condition of rows that are there, last cold day)."""
    return " UNION ALL ".join(
        f"SELECT '{name}' AS phase, {tier} AS tier, CAST(ts AS DATE) AS dt, count(*) AS n,"
        f" CAST(sum(event_id) AS BIGINT) AS ids FROM events WHERE {where} GROUP BY 1, 2, 3"
        for name, tier, where in phases
    )


def _cold_until(day, but="FALSE"):
    return f"CASE WHEN CAST(ts AS DATE) <= DATE '{day}' AND NOT ({but}) THEN 'cold' ELSE 'hot' END"


QUERIES = {
    "ret_rollover_twice": (
        _rollover_twice,
        _tiers_sql(
            ("late rows", _cold_until("2024-01-18", "CAST(ts AS DATE) >= DATE '2024-01-17' AND event_id % 3 = 0"), "TRUE"),
            ("second export", _cold_until("2024-01-18"), "TRUE"),
        ),
    ),
    "ret_rollover_resumed": (
        _rollover_resumed,
        _tiers_sql(
            ("staged", _cold_until("2024-01-16"), "TRUE"),
            ("stopped", _cold_until("2024-01-18", "CAST(ts AS DATE) = DATE '2024-01-17'"), "TRUE"),
            ("finished", _cold_until("2024-01-18"), "TRUE"),
        ),
    ),
    "ret_expire": (
        _expire,
        _tiers_sql((
            "expired", "tier",
            "tier = 'hot' OR CAST(ts AS DATE) >= DATE '2024-01-11'",
        )).replace("FROM events", "FROM (SELECT *, " + _cold_until("2024-01-19") + " AS tier FROM events UNION ALL"
                   " SELECT *, 'hot' FROM events WHERE CAST(ts AS DATE) = DATE '2024-01-19' AND event_id % 5 = 0)"),
    ),
    "snk_backup": (
        _backup,
        f"WITH {ALERTS_SQL} SELECT rule_id, severity, fired_at, tag_text FROM alerts",
    ),
    "snk_raw_events": (
        _raw_events,
        "SELECT event_id, CASE WHEN event_id % 7 <> 0 THEN CAST(ts AS DATE) END AS dt,"
        " CASE WHEN event_id % 7 <> 0 THEN '' ELSE 'event without a time' END AS reason FROM events",
    ),
    "src_replayed_files": (
        _replayed, "SELECT event_id, event_type AS folder, event_type FROM events",
    ),
    "src_events_all": (
        _events_all, "SELECT event_id, event_type, CAST(ts AS DATE) AS partition_date FROM events",
    ),
    "src_messages": (_messages, "SELECT event_id, event_type AS source, ts AS ingest_time FROM events"),
    "src_duplicate_keys": (_duplicate_keys, "SELECT event_id, event_type AS k FROM events"),
    "snk_letter_messages": (
        _letter_messages,
        "SELECT 'torn ' || event_id AS event, 'non-JSON message' AS reason, TRUE AS no_rule FROM events",
    ),
    "snk_encoded_alerts": (
        _encoded,
        f"WITH {ALERTS_SQL} SELECT rule_id, CASE WHEN tag_text = '' THEN '[]' ELSE"
        " '[\"' || replace(tag_text, ',', '\",\"') || '\"]' END AS tags, event_id FROM alerts",
    ),
    "snk_alert_messages": (
        _alert_messages,
        f"WITH {ALERTS_SQL} SELECT rule_id AS key, 'severity' AS first_header, severity, rule_id, rule_title FROM alerts",
    ),
    "ret_plan": (
        _retention,
        "SELECT DISTINCT CAST(ts AS DATE) AS dt, CAST(date_diff('day', ts, DATE '2024-01-31') AS INTEGER) AS age_days,"
        " CASE WHEN date_diff('day', ts, DATE '2024-01-31') > 14 THEN 'expired'"
        " WHEN date_diff('day', ts, DATE '2024-01-31') >= 13 THEN 'export' ELSE 'keep' END AS action,"
        " CASE WHEN date_diff('day', ts, DATE '2024-01-31') >= 30 THEN 'NEARLINE' ELSE 'STANDARD' END AS storage_class"
        " FROM events",
    ),
    "ret_storage_class": (
        _classes,
        "SELECT DISTINCT dt, CASE WHEN age >= 365 THEN 'ARCHIVE' WHEN age >= 90 THEN 'COLDLINE'"
        " WHEN age >= 30 THEN 'NEARLINE' ELSE 'STANDARD' END AS storage_class FROM ("
        "SELECT CAST(ts AS DATE) - CAST(user_id * 3 AS INTEGER) AS dt,"
        " DATE '2024-01-31' - (CAST(ts AS DATE) - CAST(user_id * 3 AS INTEGER)) AS age FROM events)",
    ),
    "ret_late_arrivals": (
        _late,
        "SELECT CAST(ts AS DATE) AS event_date, count(*) AS late_rows FROM events WHERE event_id % 20 > 13 GROUP BY 1",
    ),
    "ret_rollover": (
        _rollover,
        "SELECT CASE WHEN CAST(ts AS DATE) <= DATE '2024-01-18' THEN 'cold' ELSE 'hot' END AS tier,"
        " CAST(ts AS DATE) AS dt, count(*) AS n FROM events GROUP BY 1, 2",
    ),
}
