"""The correlations of `operators.correlate` as append-mode streaming queries.

The measures are the same. A window is emitted once, when the watermark (event
time minus the allowed lateness) has passed its end; later rows are dropped by
Spark, counted in numRowsDroppedByWatermark, and reported by `late_rows`. Spark
keeps one watermark per stream, so correlations with different lateness run as
separate queries.

Windows of all lengths share one aggregation: each row carries the end of its
own window as the event-time column, by which Spark closes a group whatever the
window's length. The first aggregation is by counted value as well, which splits
a hot key and counts distinct values; the second one only adds up what closes.
So a level reads its source once, however many correlations it has. Sequences of
three and more rules are settled by joins and read the source again.

The state of the first aggregation holds the measures of all open windows; when
a query has stopped, `open_windows` reads them there and makes alerts of them.
"""

from __future__ import annotations

import json
from typing import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..functions.fields import FieldMap
from ..operators import correlate as batch
from ..operators.rules import Correlation, Rule, Ruleset
from ..operators.suppress import suppress_alerts
from ..plans.durable import materialize
from ..plans.skew import DEFAULT_SALTS, salted_join

_KEYS = ("window", "c", "k")
_GROUP = ("end", "ws", "c", "k")
SUPPRESSION = "last"  # the state variable of suppression


def by_lateness(ruleset: Ruleset) -> dict[int, Ruleset]:
    """One ruleset per allowed lateness. Nested correlations follow their references."""
    lateness: dict[str, int] = {}
    for level in ruleset.levels:
        for c in level:
            inner = {lateness[r] for r in c.refs if r in lateness}
            if len(inner) > 1:
                raise ValueError(f"correlation {c.id!r} refers to alerts of different lateness")
            lateness[c.id] = inner.pop() if inner else c.lateness_seconds
    out = {}
    for seconds in sorted(set(lateness.values())):
        chosen = [c for c in ruleset.correlations if lateness[c.id] == seconds]
        out[seconds] = Ruleset.of(ruleset.rules, chosen)
    return out


def _windowed(rows: DataFrame, seconds: int) -> DataFrame:
    return rows.withColumn("window", F.window("event_time", f"{seconds} seconds"))


def _ordered(
    rows: Callable[[], DataFrame], correlations: Sequence[Correlation], salts: int
) -> DataFrame:
    """Sequences of n >= 3 rules, by narrowing from both ends as the batch form does.

    Each round joins the distinct steps, which wait in the state of a salted
    stream-stream join, with the two ends of their window once it has closed.
    No group is gathered: state is spread by step time. Each use of the rows is
    built anew: a self-join renames shared columns, which would lose the
    watermark of the window column and keep its state for ever.
    """
    n = len(correlations[0].refs)
    needs = batch.Needs.of(correlations)
    ends = (
        rows().groupBy(*_KEYS).agg(*batch.measures(needs, batch.last_position(correlations)))
        .where(batch.fires(correlations)).select(*_KEYS, "lo_us", "hi_us")
    )
    low, high = 0, n - 1
    while high - low > 1:
        steps = rows().select(*_KEYS, "o", "us").where(F.col("o").isin(low + 1, high - 1))
        near = salted_join(steps.dropDuplicates([*_KEYS, "o", "us"]), ends, _KEYS, ["us", "o"], salts=salts)
        ends = (
            near.where("us BETWEEN lo_us AND hi_us").groupBy(*_KEYS)
            .agg(
                F.min(F.when(F.col("o") == low + 1, F.col("us"))).alias("lo_us"),
                F.max(F.when(F.col("o") == high - 1, F.col("us"))).alias("hi_us"),
            )
            .where("lo_us <= hi_us")
        )
        low, high = low + 1, high - 1
    return ends


def _ended(rows: DataFrame, depth: int) -> DataFrame:
    """`rows` with the start `ws` and the event-time column `end` of their own windows.

    The name of the grouping column `c` tells the level, so that a level's state can be found.
    """
    started = rows.withColumn("ws", batch._window_start())
    end = F.timestamp_seconds(F.col("ws") + F.col("size"))
    return started.select(
        end.alias("end", metadata={"spark.watermarkDelayMs": 0}), "ws", F.col("c").alias(f"c{depth}"), *(
            name for name in started.columns if name not in ("ws", "c", "event_time", "size")
        ),
    )


#: How the measures of parts of a group add up.
_MERGES = {"n": F.sum, "mask": F.bit_or, "lo_us": F.min, "hi_us": F.max} | {
    f"{name}{i}": merge for i in "12" for name, merge in (("below", F.sum), ("under", F.max), ("over", F.min))
}


def _measures(correlations: Sequence[Correlation]) -> list[Column]:
    return batch.measures(batch.Needs.of(correlations), batch.last_position(correlations))


def _merged(parts: DataFrame, correlations: Sequence[Correlation]) -> DataFrame:
    """The measures of each group, from those of its parts by counted value."""
    merges = [_MERGES[name](name).alias(name) for name in parts.columns if name in _MERGES]
    if batch.Needs.of(correlations).distinct:
        merges.append(F.count_distinct("v").alias("d") if not parts.isStreaming else F.count("v").alias("d"))
    return parts.groupBy(*_GROUP).agg(*merges)


def _simple(correlations: Sequence[Correlation]) -> list[int]:
    """Positions of the correlations that an aggregation settles."""
    return [i for i, c in enumerate(correlations) if not (c.kind == "temporal_ordered" and len(c.refs) > 2)]


def _alerts(grouped: DataFrame, correlations: Sequence[Correlation]) -> DataFrame:
    fired = grouped.where(batch.fires(correlations))
    # Only one column of a stream may be its event time: the window's end is a plain value.
    end = F.timestamp_seconds(F.unix_seconds("end"))
    return batch.as_alerts(fired, correlations, F.timestamp_seconds("ws"), end, F.col("end"))


def _level(
    events: DataFrame,
    rules: dict[str, Rule],
    correlations: Sequence[Correlation],
    fields: FieldMap | None,
    time: str,
    depth: int,
    salts: int = DEFAULT_SALTS,
    **options,
) -> DataFrame:
    branches = []
    simple = [correlations[i] for i in _simple(correlations)]
    if simple:
        found = _ended(batch.correlation_rows(events, rules, simple, fields, time=time, **options), depth)
        # The last positions are told by `c`, which has another name here.
        parts = found.withColumn("c", F.col(f"c{depth}")).groupBy("end", "ws", f"c{depth}", "k", "v").agg(*_measures(simple))
        branches.append(_alerts(_merged(parts.withColumnRenamed(f"c{depth}", "c"), simple), simple))
    shapes: dict[tuple[int, int], list[Correlation]] = {}
    for c in correlations:
        if c not in simple:
            shapes.setdefault((c.window_seconds, len(c.refs)), []).append(c)
    for (seconds, _), group in shapes.items():
        def rows(group=group, seconds=seconds):
            found = batch.correlation_rows(events, rules, group, fields, time=time, **options)
            return _windowed(found, seconds)

        timed = _ordered(rows, group, salts).select("*", _end_time())
        branches.append(batch.as_alerts(
            timed, group, F.col("window.start"), F.col("window.end"), F.col("__end")
        ))
    out = branches[0]
    for b in branches[1:]:
        out = out.unionByName(b)
    return out


def _end_time() -> Column:
    """Window end as an event-time column, so that a later operator can use its watermark."""
    end = F.window_time("window") + F.expr("INTERVAL 1 MICROSECOND")
    return end.alias("__end", metadata={"spark.watermarkDelayMs": 0})


def correlate_stream(
    events: DataFrame,
    ruleset: Ruleset,
    fields: FieldMap | None = None,
    *,
    time: str = "event_time",
    lateness_seconds: int | None = None,
    suppressed: bool = True,
    **options,
) -> DataFrame:
    """Streaming alerts of every correlation in the ruleset (append mode)."""
    allowed = {c.lateness_seconds for level in ruleset.levels[:1] for c in level}
    if lateness_seconds is None:
        if len(allowed) != 1:
            raise ValueError("one query has one lateness: split the ruleset with by_lateness()")
        lateness_seconds = allowed.pop()
    marked = events.withWatermark(time, f"{lateness_seconds} seconds")
    by_id = ruleset.by_id
    seen: DataFrame | None = None
    for depth, (over_rules, nested) in enumerate(_halves(ruleset)):
        if over_rules:
            out = _level(marked, by_id, over_rules, fields, time, 2 * depth, **options)
            seen = out if seen is None else seen.unionByName(out)
        if nested:
            refs = {r: batch.alert_reference(r) for c in nested for r in c.refs}
            out = _level(batch.alerts_to_events(seen), refs, nested, None, "timestamp", 2 * depth + 1)
            seen = seen.unionByName(out)
    if seen is None:
        raise ValueError("the ruleset has no correlations")
    if suppressed and any(c.suppress_seconds for c in ruleset.correlations):
        seen = suppress_stream(seen)
    return seen.drop("suppress_seconds")


def _halves(ruleset: Ruleset) -> list[tuple[list[Correlation], list[Correlation]]]:
    """The correlations of each level, those over rules and those over alerts."""
    out = []
    for level in ruleset.levels:
        over_rules = [c for c in level if all(r in ruleset.by_id for r in c.refs)]
        out.append((over_rules, [c for c in level if c not in over_rules]))
    return out


def late_candidates(
    events: DataFrame, ruleset: Ruleset, event: str, fields: FieldMap | None = None, *,
    time: str = "event_time", **options,
) -> DataFrame:
    """rule_id, event, end of the window in microseconds: a row per event and correlation it counts for."""
    own = [c for over_rules, _ in _halves(ruleset) for c in over_rules]
    rows = batch.correlation_rows(events, ruleset.by_id, own, fields, time=time, event=event, **options)
    ended = rows.withColumn("ws", batch._window_start())
    names = F.array(*(F.lit(c.id) for c in own))
    return ended.select(
        F.get(names, F.col("c")).alias("rule_id"), "event",
        ((F.col("ws") + F.col("size")) * 1_000_000).alias("end_us"),
    )


def watermark_of(spark: SparkSession, checkpoint: str, batch_id: int) -> int | None:
    """The watermark, in microseconds, that a batch of a query closed windows by; None before there is one."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{checkpoint}/offsets/{batch_id}")
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    if batch_id < 0 or not fs.exists(path):
        return None
    stream = fs.open(path)
    try:
        text = spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()
    found = json.loads(text.split("\n")[1])["batchWatermarkMs"]
    return found * 1000 or None


class _Spacing(StatefulProcessor):
    """Keeps the time of the last alert let through, per rule and key, while it can hold another back."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self._handle = handle
        self._last = handle.getValueState(
            SUPPRESSION, T.StructType([T.StructField("seconds", T.LongType()), T.StructField("until", T.LongType())])
        )

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        # One alert per closed window of this key: a few rows per micro-batch.
        frame = pd.concat(list(rows)).sort_values(["fired_at", "window_start"])
        held = self._last.get() if self._last.exists() else None
        last = held
        keep = []
        for fired, span in zip(frame["fired_at"], frame["suppress_seconds"]):
            second = int(fired.timestamp())
            let = pd.isna(span) or last is None or second >= last[0] + int(span)
            if let and not pd.isna(span):
                last = (second, second + int(span))
            keep.append(let)
        if last is not None and last != held:
            self._last.update(last)
            if held is not None:
                self._handle.deleteTimer(held[1] * 1000)
            self._handle.registerTimer(last[1] * 1000)
        yield frame[keep]

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        # Alerts from here on fire behind the watermark, so none can be held back.
        self._last.clear()
        yield from ()

    def close(self) -> None:
        pass


def suppress_stream(alerts: DataFrame) -> DataFrame:
    """Exact suppression of a stream of alerts; needs the RocksDB state store."""
    shaped = alerts.withColumn("suppress_seconds", F.col("suppress_seconds").cast("double"))
    return shaped.groupBy("rule_id", "correlation_key").transformWithStateInPandas(
        statefulProcessor=_Spacing(),
        outputStructType=shaped.schema,
        outputMode="Append",
        timeMode="EventTime",
    )


def _states(spark: SparkSession, checkpoint: str) -> list[tuple[int, str]]:
    """Number and name of each stateful operator of a query."""
    found = spark.read.format("state-metadata").load(checkpoint).select("operatorId", "operatorName").distinct()
    return sorted(map(tuple, found.collect()))


def _state(spark: SparkSession, checkpoint: str, operator: int, **options: str) -> DataFrame:
    reader = spark.read.format("statestore").option("operatorId", str(operator))
    for name, value in options.items():
        reader = reader.option(name, value)
    return reader.load(checkpoint)


def _open_parts(
    spark: SparkSession, checkpoint: str, depth: int, correlations: Sequence[Correlation]
) -> DataFrame | None:
    """The measures of a level's open windows, by counted value, from the query's state."""
    for operator, name in _states(spark, checkpoint):
        if name != "stateStoreSave":
            continue
        rows = _state(spark, checkpoint, operator)
        if f"c{depth}" not in rows.schema["key"].dataType.names or "v" not in rows.schema["key"].dataType.names:
            continue
        # Buffers stand in the order of the measures, some under one name.
        names = _names(correlations)
        kinds = rows.schema["value"].dataType.fields
        unique = T.StructType([T.StructField(n, f.dataType) for n, f in zip(names, kinds, strict=True)])
        keys = [F.col("key")[c].alias(c) for c in ("end", "ws", "k", "v")]
        return rows.select(
            *keys, F.col("key")[f"c{depth}"].alias("c"), F.col("value").cast(unique).alias("value")
        ).select("end", "ws", "c", "k", "v", "value.*")
    return None


def _names(correlations: Sequence[Correlation]) -> list[str]:
    needs = batch.Needs.of(correlations)
    out = ["n"] + ["mask"] * needs.mask + ["lo_us", "hi_us"] * needs.order
    return out + [f"{name}{i}" for i in needs.percentile for name in ("below", "under", "over")]


def open_windows(
    spark: SparkSession, ruleset: Ruleset, checkpoint: str, *, suppressed: bool = True
) -> DataFrame:
    """Alerts of the windows that a stopped query of `correlate_stream` had not closed, from its state.

    `ruleset` and `suppressed` are those of the query. Alerts of a level are counted by the
    levels above, whose own open windows are in the state as well, and are held back by
    alerts that the query let through. Nothing is computed from events, so rows that came
    too late stay out. Sequences of three and more rules are not settled by an aggregation;
    a ruleset that has any is refused.
    """
    if any(len(_simple(level)) < len(level) for level in ruleset.levels):
        raise ValueError("sequences of three and more rules cannot be read from the state")
    seen: DataFrame | None = None
    for depth, halves in enumerate(_halves(ruleset)):
        for nested, group in enumerate(halves):
            if not group:
                continue
            level = 2 * depth + nested
            parts = _open_parts(spark, checkpoint, level, group)
            if parts is None:
                raise ValueError(f"{checkpoint} is not the checkpoint of a query of this ruleset")
            if nested:
                refs = {r: batch.alert_reference(r) for c in group for r in c.refs}
                rows = _ended(batch.correlation_rows(batch.alerts_to_events(seen), refs, group, time="timestamp"), level)
                more = rows.withColumnRenamed(f"c{level}", "c").groupBy("end", "ws", "c", "k", "v").agg(*_measures(group))
                parts = parts.unionByName(more)
            # Levels above and suppression read these again, which would read and add up the state anew.
            out = materialize(_alerts(_merged(parts, group), group))
            seen = out if seen is None else seen.unionByName(out)
    if suppressed and any(c.suppress_seconds for c in ruleset.correlations):
        seen = _continued(spark, ruleset, checkpoint, seen)
    return seen.drop("suppress_seconds")


def _continued(spark: SparkSession, ruleset: Ruleset, checkpoint: str, alerts: DataFrame) -> DataFrame:
    """`alerts` that neither those let through by the query nor earlier ones hold back."""
    operator = next(i for i, name in _states(spark, checkpoint) if name.startswith("transformWithState"))
    let = _state(spark, checkpoint, operator, stateVarName=SUPPRESSION).select(
        F.col("key.rule_id").alias("rule_id"), F.col("key.correlation_key").alias("correlation_key"),
        F.timestamp_seconds("value.seconds").alias("fired_at"),
        (F.col("value.until") - F.col("value.seconds")).alias("suppress_seconds"),
    )
    free = alerts.where(F.col("suppress_seconds").isNull())
    held = alerts.where(F.col("suppress_seconds").isNotNull()).withColumn("open", F.lit(True))
    every = held.unionByName(let.withColumn("open", F.lit(False)), allowMissingColumns=True)
    return free.unionByName(suppress_alerts(every).where("open").drop("open"))
