"""STR*: the operators as streams over `events`, in several batches of files.

The events are written, by time, into parts that the stream reads one by one, and the last
parts hold rows far ahead that move the watermark past every window. What is compared is
what the stream emits, nothing else; only `str_flush` reads open windows, from the state.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

from ...operators import matching
from ...operators.rules import Ruleset, ruleset_from_dicts
from ...sources.events import message_files, stream_files
from ...streaming import detect
from ..durable import checkpoint_dir, materialize
from .common import EVENT_FIELDS, MATCHES_SQL, plain_times, rules, table
from .correlations import (
    ANY_OF, BOTH, COUNT, KIND_RULES, ORDER, ORDER3, P95, VALUES, _COUNT_SQL, _FAN, _NESTED, _ORDER3_SQL,
    correlation, framed, greedy_sql, per_user, shown,
)

FILES = 2  # of a part at least, which is what one batch reads
EVENTS_OF_A_FILE = 400_000  # of all events, of which a part holds about a quarter
EVENTS_OF_A_STATE = 200_000  # of all events, to a partition of a stream's state
NOW = {"availableNow": True}
LETTERS = "reason string, rule_id string, event string, error string, trace string"
LATE = "event_id % 10 = 0 AND day(ts) < 8"  # rows that the late parts hold back


def stream_events(spark: SparkSession, sf: str) -> DataFrame:
    schema = table(spark, sf, "events").schema
    return (
        spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf)
        .withColumn("event_time", F.col("ts").cast("timestamp"))
    )


def _root(spark: SparkSession) -> str:
    return f"{checkpoint_dir(spark)}/stream-{uuid.uuid4().hex}"


def _files(n: int) -> int:
    """Files of a part of `n` events: a task reads one, so these grow in number instead of size."""
    return max(FILES, -(-n // EVENTS_OF_A_FILE))


def _sized(spark: SparkSession, sf: str) -> dict[str, int]:
    """Settings of a stream by which its tasks and partitions of state grow in number, not in size."""
    n = table(spark, sf, "events").count()
    least = {"spark.sql.files.minPartitionNum": _files(n), "spark.sql.shuffle.partitions": -(-n // EVENTS_OF_A_STATE)}
    return {name: max(value, int(spark.conf.get(name, None) or 0)) for name, value in least.items()}


def _parts(spark: SparkSession, sf: str, root: str, *parts: DataFrame) -> DataFrame:
    """A stream that reads the parts in order, a part a batch."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    files = _files(table(spark, sf, "events").count())
    for n, part in enumerate(parts):
        target = f"{root}/in/part={n}"
        part.repartition(files).write.parquet(target)
        folder = jvm.org.apache.hadoop.fs.Path(target)
        fs = folder.getFileSystem(conf)
        for status in fs.listStatus(folder):  # the source reads files in order of their times
            fs.setTimes(status.getPath(), 1_700_000_000_000 + 60_000 * n, -1)
    return (
        spark.readStream.schema(table(spark, sf, "events").schema).option("maxFilesPerTrigger", files)
        .option("pathGlobFilter", "*.parquet").option("recursiveFileLookup", "true").parquet(f"{root}/in")
        .withColumn("event_time", F.col("ts").cast("timestamp"))
    )


def _by_time(spark: SparkSession, sf: str, edges=(1, 8, 15, 23, 32)) -> list[DataFrame]:
    ev = table(spark, sf, "events")
    return [ev.where(f"day(ts) >= {a} AND day(ts) < {b}") for a, b in zip(edges, edges[1:])]


def _sentinels(spark: SparkSession, sf: str) -> list[DataFrame]:
    """Rows of no rule, years ahead: a row per file, so that a batch reads a part whole."""
    ev = table(spark, sf, "events")
    files = _files(ev.count())
    first = ev.groupBy().agg(F.min_by(F.struct(*ev.columns), "event_id").alias("e")).select("e.*")
    return [
        first.withColumns({
            "ts": F.lit(f"{year}-01-01").cast(ev.schema["ts"].dataType), "event_type": F.lit("end"),
            "user_id": F.lit(-1).cast("bigint"), "value": F.lit(0.0), "event_id": F.lit(-1).cast("bigint"),
        }).withColumn("_", F.explode(F.sequence(F.lit(1), F.lit(files)))).drop("_")
        for year in (2040, 2041)
    ]


def _run(spark: SparkSession, sf: str, source: DataFrame, rs: Ruleset, root: str, **options) -> DataFrame:
    """What the correlations of a stream emit until its end."""
    def write(micro, batch_id):
        micro.write.mode("overwrite").parquet(f"{root}/alerts/batch={batch_id}")

    with detect.settings(spark, _sized(spark, sf)):
        started = detect.start_correlations(
            source, rs, f"{root}/checkpoint", write, fields=EVENT_FIELDS, trigger=NOW, **options
        )
    for q in started:
        q.awaitTermination()
    return spark.read.parquet(f"{root}/alerts")


def _correlations(*specs):
    def run(spark, sf):
        root, rs = _root(spark), ruleset_from_dicts([*KIND_RULES, *specs])
        source = _parts(spark, sf, root, *_by_time(spark, sf), *_sentinels(spark, sf))
        return shown(_run(spark, sf, source, rs, root))

    return run


def _late(spark, sf):
    """A tenth of the first week comes last: letters, and alerts without them."""
    root, rs = _root(spark), ruleset_from_dicts([*KIND_RULES, COUNT, VALUES])
    parts = [p.where(f"NOT ({LATE})") for p in _by_time(spark, sf)]
    source = _parts(spark, sf, root, *parts, table(spark, sf, "events").where(LATE), *_sentinels(spark, sf))
    alerts = _run(spark, sf, source, rs, root, letters_path=f"{root}/letters")
    letters = spark.read.schema(LETTERS).option("recursiveFileLookup", "true").json(f"{root}/letters")
    told = letters.select(
        "reason", "rule_id", F.get_json_object("event", "$.event_id").alias("key"), F.lit(None).cast("bigint").alias("n"),
    )
    counts = detect.late_counts(letters).select(
        F.lit("late rows").alias("reason"), "rule_id", F.lit("").alias("key"), F.col("late_rows").alias("n")
    )
    fired = alerts.select(
        F.lit("alert").alias("reason"), "rule_id", F.col("correlation_key").alias("key"),
        F.unix_seconds(F.col("window_start")).alias("n"),
    )
    return told.unionByName(counts).unionByName(fired)


_ON_TIME = f"(SELECT * FROM events WHERE NOT ({LATE}))"
_TOO_LATE = f"""SELECT 'cor-count' AS rule_id, event_id FROM events
    WHERE {LATE} AND event_type = 'error' UNION ALL
    SELECT 'cor-values', event_id FROM events
    WHERE {LATE} AND event_type IN ('error', 'view', 'click')"""
_LATE_SQL = f"""WITH late AS ({_TOO_LATE}),
    fired AS ({_COUNT_SQL.replace('FROM events', f'FROM {_ON_TIME}')}
        UNION ALL {_FAN[1].replace('FROM events', f'FROM {_ON_TIME}')})
    SELECT 'event after its window' AS reason, rule_id, CAST(event_id AS VARCHAR) AS key, NULL::BIGINT AS n FROM late
    UNION ALL SELECT 'late rows', rule_id, '', count(*) FROM late GROUP BY rule_id
    UNION ALL SELECT 'alert', rule_id, correlation_key, CAST(epoch(window_start) AS BIGINT) FROM fired"""


def _flush(spark, sf):
    """A stream that ends in open windows: what it emitted, and what its state holds.

    Some rows come too late for their windows, and suppression goes on across the end.
    """
    held = {**COUNT, "options": {"suppress_window_seconds": 1_000_000}}
    nested = correlation("cor-nested", "event_count", ["cor-count"], "rule_id", "7d", {"gte": 4})
    root, rs = _root(spark), ruleset_from_dicts([*KIND_RULES, held, VALUES, P95, nested])
    parts = [p.where(f"NOT ({LATE})") for p in _by_time(spark, sf)]
    source = _parts(spark, sf, root, *parts, table(spark, sf, "events").where(LATE))
    emitted = _run(spark, sf, source, rs, root)
    rest = materialize(detect.flush_open_windows(spark, rs, f"{root}/checkpoint"))
    return shown(emitted.unionByName(rest, allowMissingColumns=True)).unionByName(
        shown(rest.limit(1)).select(
            F.lit("open windows were left").alias("rule_id"), F.lit(None).cast("string").alias("correlation_key"),
            F.lit(None).cast("timestamp_ntz").alias("window_start"), F.lit(None).cast("timestamp_ntz").alias("window_end"),
        )
    )


_FLUSH_COUNT = _COUNT_SQL.replace("FROM events", f"FROM {_ON_TIME}")
_NESTED_FLUSH = framed(
    "cor-nested", "'cor-count'", 604800,
    "SELECT CAST(floor(epoch(window_end) / 604800) AS BIGINT) * 604800 AS w FROM counted GROUP BY 1 HAVING count(*) >= 4",
)
_FLUSH_SQL = f"""WITH counted AS ({_FLUSH_COUNT}), spaced AS ({greedy_sql(_FLUSH_COUNT, 1_000_000)})
    SELECT * FROM spaced UNION ALL {_FAN[1].replace('FROM events', f'FROM {_ON_TIME}')}
    UNION ALL {_FAN[4].replace('FROM events', f'FROM {_ON_TIME}')} UNION ALL {_NESTED_FLUSH}
    UNION ALL SELECT 'open windows were left', NULL, NULL, NULL"""

_HOURS = (1, 2, 3, 4, 5, 6, 8, 9, 10, 12, 15, 16, 18, 20, 24, 30, 36, 40, 45, 48)
_SPANS = [
    correlation(f"cor-{h}h", "event_count", ["is-error", "is-view"], "user", f"{h}h", {"gte": 2}) for h in _HOURS
]


def fan_out() -> Ruleset:
    """Correlations of twenty window lengths and of all measures, over one source."""
    return ruleset_from_dicts([*KIND_RULES, *_SPANS, ANY_OF, VALUES, BOTH, ORDER, P95])


_FAN_SQL = " UNION ALL ".join(
    [per_user(f"cor-{h}h", 3600 * h, "event_type IN ('error', 'view')", "count(*) >= 2") for h in _HOURS]
    + [f"({s})" for s in _FAN]
)


def _dedup(spark, sf):
    """Every fourth message is delivered again in a later batch; rows of one id count once."""
    root = _root(spark)
    parts = _by_time(spark, sf, (1, 11, 21, 32))
    again = [parts[0], *(p.unionByName(q.where("event_id % 4 = 0")) for p, q in zip(parts[1:], parts))]
    source = _parts(spark, sf, root, *again)
    once = detect.once_per_message(source, "event_id", "event_time", 40 * 86400).select("event_id", "event_type")
    with detect.settings(spark, _sized(spark, sf)):
        query = (
            once.writeStream.format("parquet").option("path", f"{root}/out")
            .option("checkpointLocation", f"{root}/checkpoint").trigger(**NOW).start()
        )
    query.awaitTermination()
    return spark.read.parquet(f"{root}/out")


def _matches(spark, sf):
    root = _root(spark)
    detect.start_detection(
        _parts(spark, sf, root, *_by_time(spark, sf)), rules(), f"{root}/checkpoint", alerts_path=f"{root}/alerts",
        fields=EVENT_FIELDS, fired_at=F.col("event_time"), trigger=NOW,
    ).awaitTermination()
    return plain_times(spark.read.parquet(f"{root}/alerts").select("rule_id", "severity", "fired_at", "tags"))


def _fan_out(spark, sf):
    root = _root(spark)
    source = _parts(spark, sf, root, *_by_time(spark, sf), *_sentinels(spark, sf))
    return shown(_run(spark, sf, source, fan_out(), root))


def _divides(e: dict) -> bool:
    return 100 // (e["id"] % 97) == 1


def _uneven(frame):
    if (frame["id"] < 0).any():
        raise ValueError("ids are never negative")
    return frame["id"] % 3 == 1


PYTHON_RULES = (
    matching.PythonRule("p-divides", "Divides", _divides, ("id",), "high"),
    matching.PythonRule("p-uneven", "Uneven", lambda e: e["id"] % 3 == 1, ("id",), series=_uneven),
)


def _messages(spark: SparkSession, sf: str, root: str) -> DataFrame:
    """Events as JSON lines, every fiftieth of them torn, in two parts, as a stream of documents."""
    ev = table(spark, sf, "events")
    text = F.to_json(F.struct("event_id", "event_type"))
    torn = F.when(F.col("event_id") % 50 == 0, F.substring(text, 1, 12)).otherwise(text)
    for n in (0, 1):
        ev.where(F.col("event_id") % 2 == n).select(torn.alias("value")).repartition(FILES).write.text(f"{root}/in/part={n}")
    lines = stream_files(spark, f"{root}/in/part=*", files_per_trigger=FILES)
    return lines.withColumn("id", F.coalesce(F.try_variant_get("data", "$.event_id", "bigint"), F.lit(1)))


def _detection(source: DataFrame, root: str) -> None:
    """Rules of both kinds over messages; a later call goes on where an earlier one stopped."""
    specs = [{"title": "error", "id": "r-error", "detection": {"s": {"event_type": "error"}, "condition": "s"}}]
    detect.start_detection(
        source, ruleset_from_dicts(specs), f"{root}/checkpoint",
        alerts_path=f"{root}/alerts", letters_path=f"{root}/letters", counters_path=f"{root}/counters",
        python_rules=PYTHON_RULES, trigger=NOW,
    ).awaitTermination()


def _letters(spark, sf):
    """Dead letters of both kinds, and the alerts of Python rules."""
    root = _root(spark)
    _detection(_messages(spark, sf, root), root)
    letters = spark.read.schema(LETTERS).option("recursiveFileLookup", "true").json(f"{root}/letters")
    alerts = spark.read.option("recursiveFileLookup", "true").parquet(f"{root}/alerts").where("rule_id LIKE 'p-%'")
    return letters.select("reason", "rule_id", "event", F.substring_index("error", ":", 1).alias("error")).unionByName(
        alerts.select(
            F.lit("alert").alias("reason"), "rule_id", F.get_json_object("matched_events", "$[0]").alias("event"),
            F.lit(None).cast("string").alias("error"),
        )
    )


def _counters(spark, sf):
    """Matches per rule after the last batch ran twice, as it does when a run stops before its commit."""
    root = _root(spark)
    source = _messages(spark, sf, root)
    _detection(source, root)
    fs = spark._jvm.org.apache.hadoop.fs.Path(root).getFileSystem(spark._jsc.hadoopConfiguration())
    commits = spark._jvm.org.apache.hadoop.fs.Path(f"{root}/checkpoint/commits")
    last = max((s.getPath() for s in fs.listStatus(commits) if s.getPath().getName().isdigit()), key=lambda p: int(p.getName()))
    fs.delete(last, False)
    _detection(source, root)
    return detect.read_counters(spark, f"{root}/counters")


def _message_stream(spark, sf):
    """Archived messages, landed in two parts; the stream is stopped after the first and started again."""
    root = _root(spark)
    ev = table(spark, sf, "events")
    header = lambda name: F.struct(F.lit("source").alias("key"), F.encode(name, "UTF-8").alias("value"))
    records = ev.select(
        F.encode(F.to_json(F.struct("event_id", "event_type")), "UTF-8").alias("value"),
        F.array(header(F.lit("old")), header(F.col("event_type"))).alias("headers"),
        F.col("ts").cast("timestamp").alias("timestamp"), (F.col("event_id") % 3).cast("int").alias("partition"),
        F.col("event_id").alias("offset"),
    )
    for n in (0, 1):
        records.where(F.col("offset") % 2 == n).repartition(2 * FILES).write.parquet(f"{root}/in/part={n}")
        found = message_files(spark, f"{root}/in", files_per_trigger=FILES).select(
            F.try_variant_get("data", "$.event_id", "bigint").alias("event_id"),
            F.try_element_at("attributes", F.lit("source")).alias("source"), "ingest_time", "partition", "offset",
        )
        (
            found.writeStream.format("parquet").option("path", f"{root}/out")
            .option("checkpointLocation", f"{root}/checkpoint").trigger(**NOW).start().awaitTermination()
        )
    return plain_times(spark.read.parquet(f"{root}/out"))


_LINE = """'{"event_id":' || event_id || ',"event_type":"' || event_type || '"}'"""
_LETTERS_SQL = f"""WITH lines AS (SELECT event_id, {_LINE} AS line FROM events),
    sound AS (SELECT * FROM lines WHERE event_id % 50 <> 0)
    SELECT 'non-JSON message' AS reason, NULL AS rule_id, left(line, 12) AS event,
        'the text is not a JSON document' AS error FROM lines WHERE event_id % 50 = 0
    UNION ALL SELECT 'predicate raised', 'p-divides', line, 'ZeroDivisionError' FROM sound WHERE event_id % 97 = 0
    UNION ALL SELECT 'alert', 'p-divides', line, NULL FROM sound WHERE event_id % 97 > 50
    UNION ALL SELECT 'alert', 'p-uneven', line, NULL FROM sound WHERE event_id % 3 = 1"""
_COUNTERS_SQL = """WITH sound AS (SELECT * FROM events WHERE event_id % 50 <> 0)
    SELECT 'r-error' AS rule_id, count(*) AS matches FROM sound WHERE event_type = 'error'
    UNION ALL SELECT 'p-divides', count(*) FROM sound WHERE event_id % 97 > 50
    UNION ALL SELECT 'p-uneven', count(*) FROM sound WHERE event_id % 3 = 1"""

_HELD = {**COUNT, "options": {"suppress_window_seconds": 259200}}

QUERIES = {
    "str_matches": (
        _matches,
        f"WITH {MATCHES_SQL} SELECT rule_id, severity, ts AS fired_at, CASE WHEN tag_text = '' THEN '[]' ELSE"
        " '[\"' || replace(tag_text, ',', '\",\"') || '\"]' END AS tags FROM hits",
    ),
    "str_event_count": (_correlations(COUNT), _COUNT_SQL),
    "str_value_count": (_correlations(VALUES), _FAN[1]),
    "str_temporal": (_correlations(BOTH), _FAN[2]),
    "str_ordered": (_correlations(ORDER), _FAN[3]),
    "str_ordered3": (_correlations(ORDER3), framed("cor-order3", "CAST(user_id AS VARCHAR)", 604800, _ORDER3_SQL)),
    "str_percentile": (_correlations(P95), _FAN[4]),
    "str_nested": (
        _correlations(COUNT, _NESTED),
        f"WITH counted AS ({_COUNT_SQL}) SELECT * FROM counted UNION ALL {_NESTED_FLUSH}",
    ),
    "str_suppress": (_correlations(_HELD), greedy_sql(_COUNT_SQL, 259200)),
    "str_fanout": (_fan_out, _FAN_SQL),
    "str_late": (_late, _LATE_SQL),
    "str_flush": (_flush, _FLUSH_SQL),
    "str_letters": (_letters, _LETTERS_SQL),
    "str_counters": (_counters, _COUNTERS_SQL),
    "src_stream_messages": (
        _message_stream,
        'SELECT event_id, event_type AS source, ts AS ingest_time, CAST(event_id % 3 AS INTEGER) AS partition,'
        ' event_id AS "offset" FROM events',
    ),
    "str_dedup": (_dedup, "SELECT event_id, event_type FROM events"),
}
