"""A stream gives what the batch form gives, once its windows are closed."""

from __future__ import annotations

import datetime as dt
import json
import os

import pandas as pd
import pytest
from pyspark.sql import functions as F

from conftest import TESTDATA
from watchglass.functions.fields import FieldMap
from watchglass.operators import correlate as batch
from watchglass.operators.rules import ruleset_from_dicts
from watchglass.sources import sinks, tiers
from watchglass.sources.events import stream_files
from watchglass.operators.shaping import attach_event_time
from watchglass.streaming import correlate as sc
from watchglass.streaming import detect

RULES = [{"title": t, "id": t, "detection": {"s": {"event_type": t}, "condition": "s"}}
         for t in ("error", "purchase", "view")]


def corr(name, kind, refs, span, condition=None, **more):
    spec = {"title": name, "id": name, "type": kind, "rules": refs, "group-by": ["user_id"], "timespan": span, **more}
    if condition:
        spec["condition"] = condition
    return spec


SPECS = {
    "count": corr("count", "event_count", ["error"], "1d", {"gte": 2}, x={"suppress_window_seconds": 259200}),
    "values": corr("values", "value_count", ["error", "purchase", "view"], "1d", {"gte": 3, "field": "event_type"}),
    "both": corr("both", "temporal", ["error", "purchase"], "1d"),
    "order": corr("order", "temporal_ordered", ["error", "purchase"], "1d"),
    "order3": corr("order3", "temporal_ordered", ["error", "purchase", "view"], "7d"),
    "p95": {**corr("p95", "event_count", ["error"], "1d", {"gte": 150}, x={"percentile": 95, "percentile_field": "value"}),
            "group-by": ["event_type"]},
    "nested": {**corr("nested", "event_count", ["count"], "7d", {"gte": 2}), "group-by": ["rule_id"]},
}


@pytest.fixture(scope="module")
def source(spark, tmp_path_factory):
    """The events in four files by time, then rows far ahead that push the watermark."""
    ev = spark.read.parquet(f"{TESTDATA}/events.parquet").withColumn("event_time", F.col("ts").cast("timestamp"))
    root = tmp_path_factory.mktemp("stream")
    (root / "in").mkdir()

    def put(df, n):
        out = root / f"part{n}"
        df.coalesce(1).write.parquet(str(out))
        target = root / "in" / f"{n:03d}.parquet"
        os.link(next(out.glob("*.parquet")), target)
        os.utime(target, (1_700_000_000 + 10 * n,) * 2)

    for n, (a, b) in enumerate([(1, 8), (8, 15), (15, 23), (23, 32)]):
        put(ev.where(f"day(event_time) >= {a} AND day(event_time) < {b}"), n)
    for n, year in enumerate((2030, 2031, 2032)):
        put(ev.limit(1).withColumns({
            "event_time": F.lit(f"{year}-01-01").cast("timestamp"), "event_type": F.lit("end"),
            "user_id": F.lit(-1).cast("bigint"),
        }), 10 + n)
    return ev, str(root / "in")


COLUMNS = ["rule_id", "severity", "fired_at", "window_start", "window_end", "correlation_key"]


@pytest.mark.parametrize("names,suppressed", [
    (["count"], True), (["values"], False), (["both", "order", "order3", "p95"], False), (["count", "nested"], False),
])
def test_stream_equals_batch(spark, source, tmp_path, names, suppressed):
    ev, path = source
    rs = ruleset_from_dicts([*RULES, *(SPECS[n] for n in names)])
    want = sorted(map(tuple, batch.correlate(ev, rs, suppressed=suppressed).select(*COLUMNS).collect()))
    stream = spark.readStream.schema(ev.schema).option("maxFilesPerTrigger", 1).parquet(path)
    out = sc.correlate_stream(stream, rs, suppressed=suppressed)
    q = (out.writeStream.format("parquet").option("path", str(tmp_path / "out")).outputMode("append")
         .option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start())
    q.awaitTermination()
    got = sorted(map(tuple, spark.read.parquet(str(tmp_path / "out")).select(*COLUMNS).collect()))
    assert want and got == want


def test_late_rows_are_dropped(spark, tmp_path):
    root = tmp_path / "in"
    root.mkdir()
    rows = [["10", "20", "30"], ["4000"], ["40", "50", "60"], ["9000"], ["20000"]]
    for n, times in enumerate(rows):
        f = root / f"{n}.json"
        f.write_text("".join(f'{{"k": "a", "u": "x", "timestamp": {t}}}\n' for t in times))
        os.utime(f, (1_700_000_000 + 10 * n,) * 2)
    events = attach_event_time(
        stream_files(spark, str(root), files_per_trigger=1), F.expr("try_variant_get(data, '$.timestamp', 'string')")
    )
    rule = {"title": "a", "id": "a", "detection": {"s": {"k": "a"}, "condition": "s"}}
    c = {"title": "c", "id": "c", "type": "event_count", "rules": ["a"], "group-by": ["u"], "timespan": "1h",
         "condition": {"gte": 1}}
    seen = []
    for q in detect.start_correlations(
        events, ruleset_from_dicts([rule, c]), str(tmp_path / "cp"),
        lambda df, i: seen.extend((int(r.window_start.timestamp()), r.correlation_key) for r in df.collect()),
        trigger={"availableNow": True},
    ):
        q.awaitTermination()
    # The rows at 40..60 came after the watermark had passed 3600; the window fired once.
    assert sorted(seen) == [(0, "x"), (3600, "x"), (7200, "x")]


def test_lateness_splits_queries():
    a = corr("a", "event_count", ["error"], "1d", {"gte": 1}, x={"allowed_lateness_seconds": 60})
    b = corr("b", "event_count", ["error"], "1d", {"gte": 1})
    n = {**corr("n", "event_count", ["a"], "1d", {"gte": 1}), "group-by": ["rule_id"]}
    parts = sc.by_lateness(ruleset_from_dicts([*RULES, a, b, n]))
    assert {s: [c.id for c in rs.correlations] for s, rs in parts.items()} == {60: ["a", "n"], 300: ["b"]}


def test_detection_and_raw_events_are_separate_queries(spark, tmp_path):
    root = tmp_path / "in"
    root.mkdir()
    (root / "a.json").write_text('{"k": "a"}\nnot json\n{"k": "b"}\n')
    events = stream_files(spark, str(root)).withColumn("ingest_time", F.lit("2024-03-05 10:00:00").cast("timestamp"))
    rs = ruleset_from_dicts([{"title": "a", "id": "a", "tags": ["t"], "detection": {"s": {"k": "a"}, "condition": "s"}}])
    now = {"availableNow": True}
    detect.start_detection(
        events, rs, str(tmp_path / "c1"), alerts_path=str(tmp_path / "alerts"),
        letters_path=str(tmp_path / "letters"), trigger=now,
    ).awaitTermination()
    detect.start_raw_events(events, str(tmp_path / "hot"), str(tmp_path / "c2"), trigger=now).awaitTermination()
    alert = spark.read.parquet(str(tmp_path / "alerts")).collect()
    assert [(r.rule_id, r.tags, r.matched_events) for r in alert] == [("a", '["t"]', '["{\\"k\\": \\"a\\"}"]')]
    assert [r.reason for r in spark.read.json(str(tmp_path / "letters")).collect()] == ["non-JSON message"]
    hot, cold = str(tmp_path / "hot"), str(tmp_path / "cold")
    assert tiers.scan_hot(spark, hot, "2024-03-05", "2024-03-05").count() == 2
    # A table written by a stream lives on through rollover, more batches and expiry.
    assert tiers.rollover(spark, hot, cold, dt.date(2024, 3, 18)) == 2
    (root / "b.json").write_text('{"k": "c"}\n')
    later = events.withColumn("ingest_time", F.lit("2024-03-18 10:00:00").cast("timestamp"))
    detect.start_raw_events(later, hot, str(tmp_path / "c3"), trigger=now).awaitTermination()
    view = tiers.create_events_view(spark, hot, cold, "2024-03-01", "2024-03-31")
    assert view.count() == 5
    days = [d.name for d in (tmp_path / "alerts").glob("fired_date=*")]
    dropped = tiers.expire(spark, str(tmp_path / "alerts"), dt.date(2100, 1, 1), 30, "fired_date")
    assert len(dropped) == len(days) == 1


@pytest.mark.parametrize("names", [["count", "values", "both", "order", "p95"], ["count", "nested"]])
def test_open_windows_are_read_from_the_state(spark, source, tmp_path, names):
    ev, path = source
    rs = ruleset_from_dicts([*RULES, *(SPECS[n] for n in names)])
    stream = spark.readStream.schema(ev.schema).option("pathGlobFilter", "00*").option("maxFilesPerTrigger", 1).parquet(path)
    out = str(tmp_path / "out")
    for q in detect.start_correlations(
        stream, rs, str(tmp_path / "cp"), lambda df, i: df.write.mode("append").parquet(out), fields=FieldMap(),
        trigger={"availableNow": True},
    ):
        q.awaitTermination()
    emitted = spark.read.parquet(out)
    rest = detect.flush_open_windows(spark, rs, str(tmp_path / "cp"))
    assert rest.count() > 0
    got = sorted(map(tuple, emitted.select(*COLUMNS).unionByName(rest.select(*COLUMNS)).collect()))
    assert got == sorted(map(tuple, batch.correlate(ev, rs).select(*COLUMNS).collect()))
    with pytest.raises(ValueError):
        detect.flush_open_windows(spark, ruleset_from_dicts([*RULES, SPECS["order3"]]), str(tmp_path / "cp"))


def test_all_window_lengths_share_one_source(spark, source):
    from watchglass.plans.catalogue.streams import fan_out
    from watchglass.plans.catalogue.common import EVENT_FIELDS

    ev, path = source
    stream = spark.readStream.schema(ev.schema).parquet(path)
    plan = sc.correlate_stream(stream, fan_out(), EVENT_FIELDS)._jdf.queryExecution().analyzed().toString()
    assert plan.count("StreamingRelation") == 1 and len({c.window_seconds for c in fan_out().correlations}) >= 20


def test_suppression_forgets_what_is_past(spark, source, tmp_path):
    ev, path = source
    rs = ruleset_from_dicts([*RULES, SPECS["count"]])
    stream = spark.readStream.schema(ev.schema).option("maxFilesPerTrigger", 1).parquet(path)
    [q] = detect.start_correlations(
        stream, rs, str(tmp_path / "cp"), lambda df, i: df.write.format("noop").mode("append").save(), fields=FieldMap(),
        trigger={"availableNow": True},
    )
    q.awaitTermination()
    rows = [
        op["numRowsTotal"] for p in q.recentProgress for op in p["stateOperators"]
        if op["operatorName"].startswith("transformWithState")
    ]
    assert max(rows) > 0 and rows[-1] == 0


def test_late_events_become_letters(spark, tmp_path):
    root = tmp_path / "in"
    root.mkdir()
    for n, times in enumerate([["10", "20"], ["4000"], ["9000"], ["40", "50", "9100"], ["20000"], ["30000"], ["41"], ["50000"]]):
        f = root / f"{n}.json"
        f.write_text("".join(f'{{"k": "a", "u": "x", "timestamp": {t}}}\n' for t in times))
        os.utime(f, (1_700_000_000 + 10 * n,) * 2)
    events = attach_event_time(
        stream_files(spark, str(root), files_per_trigger=1), F.expr("try_variant_get(data, '$.timestamp', 'string')")
    )
    rule = {"title": "a", "id": "a", "detection": {"s": {"k": "a"}, "condition": "s"}}
    specs = [
        {"title": t, "id": t, "type": "event_count", "rules": ["a"], "group-by": ["u"], "timespan": span, "condition": {"gte": 1}}
        for t, span in (("hour", "1h"), ("day", "1d"))
    ]
    out, letters = str(tmp_path / "out"), str(tmp_path / "letters")
    rs = ruleset_from_dicts([rule, *specs])
    [q] = detect.start_correlations(
        events, rs, str(tmp_path / "cp"), lambda df, i: df.write.mode("overwrite").parquet(f"{out}/batch={i}"),
        letters_path=letters, event="raw", trigger={"availableNow": True},
    )
    q.awaitTermination()
    dropped = sum(op["numRowsDroppedByWatermark"] for p in q.recentProgress for op in p["stateOperators"])
    told = spark.read.option("recursiveFileLookup", "true").json(letters).collect()
    # Only the hours had closed; the day's window was open.
    assert sorted((r.rule_id, json.loads(r.event)["timestamp"]) for r in told) == [("hour", 40), ("hour", 41), ("hour", 50)]
    assert dropped > 0 and {r.reason for r in told} == {detect.REASON_LATE}
    assert [tuple(r) for r in detect.late_counts(spark.read.option("recursiveFileLookup", "true").json(letters)).collect()] == [("hour", 3)]


def test_raw_events_without_a_time_become_letters(spark, tmp_path):
    root = tmp_path / "in"
    root.mkdir()
    (root / "a.json").write_text('{"n": 1}\n{"n": 2}\nnot json\n')
    events = stream_files(spark, str(root)).withColumn(
        "ingest_time", F.when(F.expr("try_variant_get(data, '$.n', 'int') = 1"), F.lit("2024-03-05 10:00:00").cast("timestamp"))
    )
    now = {"availableNow": True}
    hot, letters = str(tmp_path / "hot"), str(tmp_path / "letters")
    detect.start_raw_events(events, hot, str(tmp_path / "c1"), letters_path=letters, trigger=now).awaitTermination()
    assert tiers.scan_hot(spark, hot, "2000-01-01", "2100-01-01").count() == 1
    assert tiers.odd_partitions(spark, hot) == []
    assert [(r.reason, r.event) for r in spark.read.option("recursiveFileLookup", "true").json(letters).collect()] == [
        (sinks.REASON_NO_TIME, '{"n":2}')
    ]
    with pytest.raises(Exception, match="no path for dead letters"):
        detect.start_raw_events(events, hot, str(tmp_path / "c2"), trigger=now).awaitTermination()


def test_python_rules_of_a_set(spark):
    from watchglass.operators import matching

    calls = []

    def careful(frame):
        calls.append(len(frame))
        if (frame["n"] == 3).any():
            raise ValueError("no threes")
        return frame["n"] > 1

    rules = [
        matching.PythonRule("a", "A", lambda e: 6 / (e["n"] - 2) > 1, ("n",), "high", ("t",)),
        matching.PythonRule("b", "B", lambda e: e["n"] > 1, ("n",), series=careful),
        matching.PythonRule("c", "C", lambda e: e["s"] == "x" and e["n"] == 3, ("s", "n")),
        matching.PythonRule("d", "D", lambda e: e["n"] > 1, ("n",), series=lambda f: pd.Series([True])),
    ]
    df = spark.createDataFrame([(i, "x") for i in range(5)], "n int, s string").coalesce(1)
    tested = matching.with_python_rules(df, rules).persist()
    assert {r.n: sorted(r.python.hits) for r in tested.collect()} == {0: [], 1: [], 2: [1, 3], 3: [0, 1, 2, 3], 4: [0, 1, 3]}
    [letter] = matching.python_letters(tested, rules).collect()
    assert (letter.rule_id, json.loads(letter.event)["n"]) == ("a", 2) and "ZeroDivisionError" in letter.error
    found = matching.python_alerts(tested, rules).where("rule_id = 'a'").collect()
    assert sorted(json.loads(r.matched_events[0])["n"] for r in found) == [3, 4] and found[0].tags == ["t"]
    assert tested.where("false").select("python").count() == 0


def test_repeated_messages_are_dropped(spark, tmp_path):
    root = tmp_path / "in"
    root.mkdir()
    (root / "a.json").write_text('{"id": 1, "timestamp": 5}\n{"id": 1, "timestamp": 5}\n{"id": 2, "timestamp": 6}\n')
    events = attach_event_time(stream_files(spark, str(root)), F.expr("try_variant_get(data, '$.timestamp', 'string')"))
    once = detect.once_per_message(
        events.withColumn("id", F.expr("try_variant_get(data, '$.id', 'string')")), "id", "event_time", 60
    ).select("id")
    (once.writeStream.format("parquet").option("path", str(tmp_path / "out"))
     .option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start().awaitTermination())
    assert sorted(r.id for r in spark.read.parquet(str(tmp_path / "out")).collect()) == ["1", "2"]


def test_kafka_record_shape(spark):
    from watchglass.schema import ALERT_SCHEMA
    import datetime as dt

    t = dt.datetime(2024, 1, 1)
    alert = spark.createDataFrame([("r", "R", "high", t, None, None, None, ['{"a":1}'], ["x"])], ALERT_SCHEMA)
    row = sinks.alert_messages(alert).collect()[0]
    assert {h.key: bytes(h.value) for h in row.headers} == {"severity": b"high", "rule_id": b"r"}
    assert '"matched_events":"[' in row.value


def test_a_sequence_of_more_rules_than_a_mask_has_bits(spark, tmp_path):
    n = 64
    rows = [("u", i, 10 + i) for i in range(n)] + [("v", n - 1 - i, 10 + i) for i in range(n)] + [("w", 0, 99_999)]
    root = str(tmp_path / "in")
    (
        spark.createDataFrame(rows, "user string, n int, s long")
        .select("user", "n", F.timestamp_seconds("s").alias("event_time")).coalesce(1).write.parquet(root)
    )
    stored = spark.read.parquet(root)
    single = [{"title": f"n{i}", "id": f"n{i}", "detection": {"s": {"n": i}, "condition": "s"}} for i in range(n)]
    spec = {"title": "seq", "id": "seq", "type": "temporal_ordered", "rules": [r["id"] for r in single],
            "group-by": ["user"], "timespan": "1h", "condition": {"gte": n}}
    rs = ruleset_from_dicts([*single, spec])
    assert [r.correlation_key for r in batch.correlate(stored, rs).collect()] == ["u"]
    # A stream of so many steps is the same narrowing; its plan must resolve.
    stream = spark.readStream.schema(stored.schema).parquet(root)
    assert sc.correlate_stream(stream, rs).isStreaming


def test_streams_grow_in_tasks_instead_of_task_size(spark, tmp_path):
    """More events: more files of a part, each part still a batch, and more partitions of state."""
    from watchglass.plans.catalogue import streams

    n = 2 * streams.EVENTS_OF_A_FILE + 1
    spark.range(n).selectExpr(
        "id AS event_id", "timestamp_seconds(1704067200 + 3 * id) AS ts", "id % 9 AS user_id", "'x' AS event_type",
        "1.0D AS value", "'{}' AS props",
    ).write.parquet(f"{tmp_path}/events.parquet")
    sized = streams._sized(spark, str(tmp_path))
    assert sized["spark.sql.files.minPartitionNum"] >= 3
    assert sized["spark.sql.shuffle.partitions"] >= n / streams.EVENTS_OF_A_STATE
    parts = [*streams._by_time(spark, str(tmp_path)), *streams._sentinels(spark, str(tmp_path))]
    streams._parts(spark, str(tmp_path), f"{tmp_path}/root", *parts)
    for k in range(len(parts)):
        assert len(list((tmp_path / "root" / "in" / f"part={k}").glob("*.parquet"))) == 3
    before = spark.conf.get("spark.sql.shuffle.partitions")
    with detect.settings(spark, sized):
        assert spark.conf.get("spark.sql.shuffle.partitions") == str(sized["spark.sql.shuffle.partitions"])
    assert spark.conf.get("spark.sql.shuffle.partitions") == before
