"""Streaming detection: alerts, dead letters and raw events from one source."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager
from typing import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions.fields import FieldMap
from ..operators import matching
from ..operators.rules import Ruleset
from ..sources import sinks
from .correlate import by_lateness, correlate_stream, late_candidates, open_windows, watermark_of

REASON_LATE = "event after its window"
DOCUMENT = FieldMap(document="data", raw="raw")


def start_detection(
    events: DataFrame,
    ruleset: Ruleset,
    checkpoint: str,
    *,
    alerts_path: str | None = None,
    letters_path: str | None = None,
    on_alerts: Callable[[DataFrame, int], None] | None = None,
    fields: FieldMap = DOCUMENT,
    fired_at: Column | None = None,
    python_rules: Sequence[matching.PythonRule] = (),
    counters_path: str | None = None,
    trigger: dict | None = None,
) -> StreamingQuery:
    """Single-event alerts and dead letters of each micro-batch.

    `python_rules` run beside the ruleset, all in one pass; what they raise on becomes a
    dead letter. `counters_path` gets the number of matches per rule of each batch, a
    folder a batch, from which `read_counters` adds up: a repeated batch replaces its own.

    Files of a repeated micro-batch are written again (at-least-once); below
    the day, the batch number is kept in the path so that a repeat overwrites
    itself and a day can be dropped as one folder. Rules that cannot run give a
    letter in the first batch.
    """

    def write(micro: DataFrame, batch_id: int) -> None:
        micro, tested = micro.persist(), None
        try:
            found = matching.alerts(micro, ruleset.rules, fields, fired_at=fired_at)
            if python_rules:  # records that are not JSON reach these no more than the others
                sound = micro.where(F.col(fields.document).isNotNull()) if fields.document else micro
                tested = matching.with_python_rules(sound, python_rules).persist()
                found = found.unionByName(matching.python_alerts(tested, python_rules, fields, fired_at=fired_at))
            if counters_path is not None:
                matching.rule_counters(found).write.mode("overwrite").parquet(f"{counters_path}/batch={batch_id}")
            if on_alerts is not None:
                on_alerts(found, batch_id)
            if alerts_path is not None:
                (
                    sinks.encode_alerts(found)
                    .withColumn("fired_date", F.to_date("fired_at")).withColumn("batch", F.lit(batch_id))
                    .write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
                    .partitionBy("fired_date", "batch").parquet(alerts_path)
                )
            if letters_path is not None:
                letters = matching.not_json_letters(micro)
                if python_rules:
                    letters = letters.unionByName(matching.python_letters(tested, python_rules, fields))
                if batch_id == 0:
                    letters = letters.unionByName(matching.rule_letters(micro.sparkSession, ruleset.rules))
                letters.write.mode("overwrite").json(
                    f"{letters_path}/batch={batch_id}"
                )
        finally:
            micro.unpersist()
            if tested is not None:
                tested.unpersist()

    return (
        events.writeStream.foreachBatch(write)
        .option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"processingTime": "10 seconds"}))
        .start()
    )


def read_counters(spark: SparkSession, counters_path: str) -> DataFrame:
    """Matches per rule of all batches so far."""
    parts = spark.read.schema("rule_id string, matches long").option("basePath", counters_path).parquet(counters_path)
    return parts.groupBy("rule_id").agg(F.sum("matches").alias("matches"))


def start_raw_events(
    events: DataFrame, path: str, checkpoint: str, *, time: str = "ingest_time",
    letters_path: str | None = None, trigger: dict | None = None,
) -> StreamingQuery:
    """Raw events to the hot table, with a checkpoint of their own.

    Each micro-batch is a folder of its own below the day, so a repeat overwrites
    itself, and there is no log of files that a rollover would make stale. Events
    without a time go to the dead letters; see `sinks.dated_events`.
    """

    def write(micro: DataFrame, batch_id: int) -> None:
        (
            sinks.dated_events(micro, time, letters_path).withColumn("batch", F.lit(batch_id))
            .write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
            .partitionBy("dt", "batch").parquet(path)
        )
        if letters_path is not None:
            sinks.no_time_letters(micro, time).write.mode("overwrite").json(f"{letters_path}/batch={batch_id}")

    return (
        events.writeStream.foreachBatch(write)
        .option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"processingTime": "60 seconds"}))
        .start()
    )


def start_correlations(
    events: DataFrame,
    ruleset: Ruleset,
    checkpoint: str,
    write: Callable[[DataFrame, int], None],
    *,
    fields: FieldMap | None = DOCUMENT,
    time: str = "event_time",
    letters_path: str | None = None,
    event: str = "to_json(struct(*))",
    trigger: dict | None = None,
    **options,
) -> list[StreamingQuery]:
    """One query per allowed lateness; `write(alerts, batch_id)` gets each micro-batch.

    With `letters_path`, events that come after their window has closed, which the
    aggregations leave out, are written there as dead letters, one per correlation they
    would have counted for; `event` is SQL of the text that a letter carries. A batch
    leaves out what lies behind the watermark of the batch before it, which the query's
    own offset log holds; so a repeated batch writes the same letters in the same place.
    """
    started = []
    for seconds, part in by_lateness(ruleset).items():
        own = f"{checkpoint}/lateness={seconds}"
        out = correlate_stream(events, part, fields, time=time, lateness_seconds=seconds, **options)
        each = write
        if letters_path is not None:
            rows = late_candidates(events, part, event, fields, time=time)
            late = F.struct("rule_id", "event", "end_us")
            out = out.withColumn("late", F.lit(None).cast(rows.select(late.alias("x")).schema["x"].dataType)).unionByName(
                rows.select(late.alias("late")), allowMissingColumns=True
            )
            each = _with_letters(write, own, f"{letters_path}/lateness={seconds}")
        with rocksdb_state(events.sparkSession):
            started.append(
                out.writeStream.foreachBatch(each).outputMode("append")
                .option("checkpointLocation", own)
                .trigger(**(trigger or {"processingTime": "10 seconds"}))
                .start()
            )
    return started


@contextmanager
def settings(spark: SparkSession, wanted: dict[str, object]) -> Iterator[None]:
    """Queries started within keep these settings; the session's own are put back."""
    before = {name: spark.conf.get(name, None) for name in wanted}
    for name, value in wanted.items():
        spark.conf.set(name, str(value))
    try:
        yield
    finally:
        for name, value in before.items():
            if value is None:
                spark.conf.unset(name)
            else:
                spark.conf.set(name, value)


def rocksdb_state(spark: SparkSession):
    """Queries started within keep their state in RocksDB, which suppression needs."""
    return settings(spark, {
        "spark.sql.streaming.stateStore.providerClass":
            "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    })


def _with_letters(write: Callable[[DataFrame, int], None], checkpoint: str, letters_path: str):
    def each(micro: DataFrame, batch_id: int) -> None:
        spark = micro.sparkSession
        passed = watermark_of(spark, checkpoint, batch_id - 1)
        kept = micro.where("late IS NULL OR " + ("FALSE" if passed is None else f"late.end_us <= {passed}")).persist()
        try:
            write(kept.where("late IS NULL").drop("late"), batch_id)
            late_letters(kept.where("late IS NOT NULL").select("late.*"), passed).write.mode("overwrite").json(
                f"{letters_path}/batch={batch_id}"
            )
        finally:
            kept.unpersist()

    return each


def late_letters(rows: DataFrame, watermark_us: int | None) -> DataFrame:
    """Dead letters for events whose window had closed."""
    at = F.date_format(F.timestamp_micros(F.lit(watermark_us).cast("bigint")), "yyyy-MM-dd HH:mm:ss.SSS")
    end = F.date_format(F.timestamp_micros("end_us"), "yyyy-MM-dd HH:mm:ss")
    return rows.select(
        F.lit(REASON_LATE).alias("reason"), "rule_id", "event",
        F.concat(F.lit("the window until "), end, F.lit(" was closed at "), at).alias("error"),
        F.lit(None).cast("string").alias("trace"),
    )


def late_counts(letters: DataFrame) -> DataFrame:
    """rule_id and the number of events that came too late for it."""
    return letters.where(F.col("reason") == REASON_LATE).groupBy("rule_id").agg(F.count(F.lit(1)).alias("late_rows"))


def start_kafka_alerts(
    alerts: DataFrame, servers: str, topic: str, checkpoint: str, **options: str
) -> StreamingQuery:
    """Alerts to a topic, with severity and rule_id as headers."""
    writer = (
        sinks.alert_messages(alerts).writeStream.format("kafka")
        .option("kafka.bootstrap.servers", servers).option("topic", topic)
        .option("includeHeaders", "true").option("checkpointLocation", checkpoint)
    )
    for k, v in options.items():
        writer = writer.option(k, v)
    return writer.start()


def once_per_message(events: DataFrame, message_id: str, time: str, lateness_seconds: int) -> DataFrame:
    """Drop redelivered messages of an at-least-once source."""
    return events.withWatermark(time, f"{lateness_seconds} seconds").dropDuplicatesWithinWatermark(
        [message_id]
    )


def flush_open_windows(
    spark: SparkSession, ruleset: Ruleset, checkpoint: str, *, suppressed: bool = True
) -> DataFrame:
    """Alerts of windows that the stopped queries of `start_correlations` had not closed, from their state."""
    out = None
    for seconds, part in by_lateness(ruleset).items():
        rest = open_windows(spark, part, f"{checkpoint}/lateness={seconds}", suppressed=suppressed)
        out = rest if out is None else out.unionByName(rest)
    return out
