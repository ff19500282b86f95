"""Windowed correlations over rule matches, for tables.

All correlations of a ruleset are measured in one pass: an event becomes one
small row per correlation it counts for, and a single aggregation keyed by
(correlation, window, key) holds every measure. Each measure is a count, a
minimum, a maximum, a bit mask or a distinct count, so partial aggregation
absorbs hot keys and no group is ever collected.
"""

from __future__ import annotations

from dataclasses import dataclass
from typing import Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from ..functions.fields import Binder, FieldMap
from ..functions.literals import sql_ident, sql_str
from ..plans.durable import materialize
from ..plans.local import literal_frame
from ..plans.skew import weighted_join
from .matching import _parsed
from .rules import Bounds, Correlation, Rule, Ruleset, rule_sql

MISSING = "MISSING"  # Fixed value: stands for an absent or null group-by value.
_MASK_BITS = 62
_COMPILED_ROWS = 16
GROUP = ("c", "ws", "k")


def group_key(b: Binder, names: Sequence[str]) -> str:
    """SQL for the group-by values as an array, so that no two keys can collide."""
    parts = ", ".join(f"coalesce({b.text(n)}, '{MISSING}')" for n in names)
    return f"CAST(array({parts}) AS ARRAY<STRING>)"


def _is_missing(b: Binder, names: Sequence[str]) -> str:
    return " OR ".join(b.is_null(n) for n in names) or "FALSE"


def _below(bounds: Bounds, x: str) -> tuple[str, str]:
    """Row tests: x is under the lower limit; x is not over the upper limit."""
    none = "CAST(NULL AS BOOLEAN)"
    lo = none if bounds.lo == float("-inf") else f"{x} {'<=' if bounds.lo_strict else '<'} {bounds.lo!r}D"
    hi = none if bounds.hi == float("inf") else f"{x} {'<' if bounds.hi_strict else '<='} {bounds.hi!r}D"
    return lo, hi


def _wide(c: Correlation) -> bool:
    """Too many rules for a bit mask: count distinct rules instead."""
    return c.kind == "temporal" and len(c.refs) > _MASK_BITS


def _masked(c: Correlation) -> bool:
    """A long sequence needs no mask: its steps are settled one by one anyway."""
    return c.kind in ("temporal", "temporal_ordered") and len(c.refs) <= _MASK_BITS


def counts_distinct(c: Correlation) -> bool:
    return c.kind == "value_count" or _wide(c)


def correlation_rows(
    df: DataFrame,
    rules: dict[str, Rule],
    correlations: Sequence[Correlation],
    fields: FieldMap | None = None,
    *,
    time: str = "event_time",
    default_case: str = "insensitive",
    drop_missing_keys: bool = False,
    event: str | None = None,
) -> DataFrame:
    """(event_time, us, c, k, v, x, o, m, b1, b2, size): one row per event and correlation.

    c is the position in `correlations`, k the key, v the counted value, x the
    number a percentile is taken of, o the position of the first rule that
    matched, m the bit mask of all that did, b1 and b2 the `_below` tests, size
    the window in seconds. `event` is SQL of a text of the event, which becomes the last column.
    """
    b = Binder(df, fields)
    used = list(dict.fromkeys(r for c in correlations for r in c.refs))
    flag = {r: f"__r{i}" for i, r in enumerate(used)}
    tests = {r: rule_sql(b, rules[r], default_case=default_case) for r in used}

    structs = []
    for i, c in enumerate(correlations):
        hit = [flag[r] for r in c.refs]
        v, x, o, m = "CAST(NULL AS STRING)", "CAST(NULL AS DOUBLE)", "0", "0L"
        b1 = b2 = "CAST(NULL AS BOOLEAN)"
        when = "(" + " OR ".join(hit) + ")"
        if c.kind == "value_count":
            v = b.text(c.value_field)
        elif c.kind == "percentile":
            x = b.number(c.value_field)
            b1, b2 = _below(c.bounds, x)
            when += f" AND {x} IS NOT NULL"
        elif c.kind in ("temporal", "temporal_ordered"):
            o = "CASE " + " ".join(f"WHEN {h} THEN {n}" for n, h in enumerate(hit)) + " END"
            if _masked(c):
                m = (
                    f"shiftleft(1L, {o})" if c.kind == "temporal_ordered"
                    else " + ".join(f"if({h}, {1 << n}L, 0L)" for n, h in enumerate(hit))
                )
        if drop_missing_keys:
            when += f" AND NOT ({_is_missing(b, c.group_by)})"
        rows = [(when, v, o)]
        if _wide(c):
            rows = [(h, f"'{n}'", str(n)) for n, h in enumerate(hit)]
        key = group_key(b, c.group_by)
        structs += [
            (w, [
                f"{i} AS c", f"{key} AS k", f"{value} AS v", f"{x} AS x", f"{pos} AS o",
                f"{m} AS m", f"{b1} AS b1", f"{b2} AS b2", f"{c.window_seconds}L AS size",
                *(["__event AS event"] if event else []),
            ])
            for w, value, pos in rows
        ]
    ready = b.attach(_parsed(df, b)).where(F.col(time).isNotNull())
    flagged = ready.selectExpr(
        f"{sql_ident(time)} AS __time", *b.helper_columns, *([f"{event} AS __event"] if event else []),
        *(f"{tests[r]} AS {flag[r]}" for r in used),
    )
    times = ("__time AS event_time", "unix_micros(CAST(__time AS TIMESTAMP)) AS us")
    if len(structs) == 1:
        when, parts = structs[0]
        if df.isStreaming:
            # A filter without the event time would be pushed below the watermark,
            # and events that match no rule must still move it on.
            when = f"if(__time IS NULL, FALSE, {when})"
        return flagged.where(when).selectExpr(*times, *parts)
    cases = ", ".join(f"CASE WHEN {when} THEN struct({', '.join(parts)}) END" for when, parts in structs)
    if len(structs) > _COMPILED_ROWS:
        return flagged.selectExpr(*times, f"inline(array_compact(array({cases})))")
    # Few enough to compile: emit every row, empty ones too, and filter.
    return flagged.selectExpr(*times, f"inline(array({cases}))").where("c IS NOT NULL")


@dataclass(frozen=True)
class Needs:
    """Which measures a set of correlations uses."""

    distinct: bool
    mask: bool
    order: bool
    percentile: str  # the limits that percentiles have: 1 the lower one, 2 the upper one

    @classmethod
    def of(cls, correlations: Sequence[Correlation]) -> "Needs":
        kinds = {c.kind for c in correlations}
        bounds = [c.bounds for c in correlations if c.kind == "percentile"]
        return cls(
            any(counts_distinct(c) for c in correlations),
            bool(kinds & {"temporal", "temporal_ordered"}),
            "temporal_ordered" in kinds,
            "1" * any(b.lo > float("-inf") for b in bounds) + "2" * any(b.hi < float("inf") for b in bounds),
        )


def measures(needs: Needs, last: Column | None) -> list[Column]:
    """Aggregates of one (correlation, window, key) group."""
    out = [F.count(F.lit(1)).alias("n")]
    if needs.mask:
        out.append(F.bit_or("m").alias("mask"))
    if needs.order:
        out += [
            F.min(F.when(F.col("o") == 0, F.col("us"))).alias("lo_us"),
            F.max(F.when(F.col("o") == last, F.col("us"))).alias("hi_us"),
        ]
    for i in needs.percentile:
        below = F.col(f"b{i}")
        out += [
            F.count_if(below).alias(f"below{i}"),
            F.max(F.when(below, F.col("x"))).alias(f"under{i}"),
            F.min(F.when(~below, F.col("x"))).alias(f"over{i}"),
        ]
    return out


def last_position(correlations: Sequence[Correlation]) -> Column:
    ends = [
        f"WHEN {i} THEN {len(c.refs) - 1}"
        for i, c in enumerate(correlations) if c.kind == "temporal_ordered"
    ]
    return F.expr(f"CASE c {' '.join(ends)} END") if ends else F.lit(None)


def _exceeds(p: float, n: str, i: str, limit: float, strict: bool) -> str:
    """The percentile is over the limit, from counts and neighbours alone.

    With k = p/100*(n-1) the percentile lies between the order statistics
    floor(k) and ceil(k). They are both under the limit, both over it, or the
    limit falls between them; then they are the largest value under it and the
    smallest over it, which the aggregation kept.
    """
    k = f"({p!r}D / 100 * ({n} - 1))"
    value = f"(under{i} * (ceil({k}) - {k}) + over{i} * ({k} - floor({k})))"
    return (
        f"CASE WHEN below{i} <= floor({k}) THEN TRUE WHEN below{i} >= ceil({k}) + 1 THEN FALSE"
        f" ELSE {value} {'>' if strict else '>='} {limit!r}D END"
    )


def fires_sql(c: Correlation) -> str:
    """Whether a group's measures satisfy the correlation (ordered: ends only)."""
    if c.kind == "event_count":
        return c.bounds.sql("n")
    if c.kind == "value_count":
        return c.bounds.sql("d")
    if c.kind == "percentile":
        tests = []
        if c.bounds.lo > float("-inf"):
            tests.append(_exceeds(c.percentile, "n", "1", c.bounds.lo, c.bounds.lo_strict))
        if c.bounds.hi < float("inf"):
            tests.append("NOT " + _exceeds(c.percentile, "n", "2", c.bounds.hi, not c.bounds.hi_strict))
        return "(" + " AND ".join(tests) + ")" if tests else "TRUE"
    full = (
        f"mask = {(1 << len(c.refs)) - 1}L" if _masked(c)
        else f"d = {len(c.refs)}" if _wide(c) else "TRUE"
    )
    return full if c.kind == "temporal" else f"({full} AND lo_us <= hi_us)"


def fires(correlations: Sequence[Correlation]) -> Column:
    cases = " ".join(f"WHEN {i} THEN {fires_sql(c)}" for i, c in enumerate(correlations))
    return F.expr(f"CASE c {cases} ELSE FALSE END")


def _correlation_table(df: DataFrame, correlations: Sequence[Correlation]) -> DataFrame:
    return literal_frame(df.sparkSession, {
        "c": (pa.int32(), range(len(correlations))),
        "rule_id": (pa.string(), [c.id for c in correlations]),
        "rule_title": (pa.string(), [c.title for c in correlations]),
        "severity": (pa.string(), [c.severity for c in correlations]),
        "tags": (pa.list_(pa.string()), [list(c.tags) for c in correlations]),
        "suppress_seconds": (pa.int64(), [c.suppress_seconds for c in correlations]),
    })


def _described(grouped: DataFrame, correlations: Sequence[Correlation]) -> DataFrame:
    """Add id, title, severity, tags and suppression of each row's correlation."""
    if len(correlations) > 1:
        return grouped.join(_correlation_table(grouped, correlations), "c")
    # With one correlation c is a constant, and a join on it would be a cross join.
    only = correlations[0]
    return grouped.withColumns({
        "rule_id": F.lit(only.id),
        "rule_title": F.lit(only.title),
        "severity": F.lit(only.severity),
        "tags": F.array(*map(F.lit, only.tags)).cast("array<string>"),
        "suppress_seconds": F.lit(only.suppress_seconds).cast("bigint"),
    })


def as_alerts(
    fired: DataFrame, correlations: Sequence[Correlation], start: Column, end: Column,
    fired_at: Column | None = None,
) -> DataFrame:
    """Alert rows for groups (c, k) that fired in a window; no events are carried."""
    return _described(fired, correlations).select(
        "rule_id", "rule_title", "severity",
        (end if fired_at is None else fired_at).alias("fired_at"),
        start.alias("window_start"), end.alias("window_end"),
        F.array_join("k", "|").alias("correlation_key"),
        F.array().cast("array<string>").alias("matched_events"),
        "tags", "suppress_seconds",
    )


def _window_start() -> Column:
    """Start of the epoch-aligned window, in seconds, of a row."""
    second = "(us DIV 1000000L - if(us < 0 AND us % 1000000L <> 0, 1, 0))"
    return F.expr(f"{second} - pmod({second}, size)")


def _settle_order(
    rows: DataFrame, ends: DataFrame, correlations: Sequence[Correlation]
) -> DataFrame:
    """Ordered sequences of three or more rules, by narrowing from both ends.

    `ends` has the earliest first step and latest last step of each group, and n,
    its number of rows, which tells the join where to salt. Each round finds the earliest next step after the one and the latest previous
    step before the other, until they meet; greedy choices are enough for a
    subsequence. Rounds need one aggregation each and hold two numbers per
    group. Equal times count in declared order.
    """
    positions = F.expr("CASE c " + " ".join(
        f"WHEN {i} THEN {len(c.refs) - 1}" for i, c in enumerate(correlations)
        if c.kind == "temporal_ordered"
    ) + " END")
    open_ = ends.select(*GROUP, "n", "lo_us", "hi_us", F.lit(0).alias("i"), positions.alias("j"))
    rounds = max(
        (len(c.refs) - 1) // 2 for c in correlations if c.kind == "temporal_ordered"
    )
    done = open_.where("j - i <= 1")
    pending = open_.where("j - i > 1")
    # Only the steps between the ends are still open, of the groups that are. They are
    # written once, so that no round evaluates the rules again.
    steps = materialize(
        rows.where((F.col("o") > 0) & (F.col("o") < positions)).select(*GROUP, "o", "us")
        .join(pending.select(*GROUP), list(GROUP), "left_semi")
    )
    for _ in range(rounds):
        # Equal steps at one time are one step: with hot keys, drop repeats first.
        near = weighted_join(
            steps, pending, GROUP, ["us", "o"], "n", reduce=lambda df: df.distinct()
        ).where(
            "us BETWEEN lo_us AND hi_us AND (o = i + 1 OR o = j - 1)"
        )
        narrowed = near.groupBy(*GROUP, "n", "i", "j").agg(
            F.min(F.expr("CASE WHEN o = i + 1 THEN us END")).alias("lo_us"),
            F.max(F.expr("CASE WHEN o = j - 1 THEN us END")).alias("hi_us"),
        ).select(
            *GROUP, "n", "lo_us", "hi_us",
            F.expr("i + 1").alias("i"), F.expr("j - 1").alias("j"),
        ).where("lo_us <= hi_us")
        narrowed = materialize(narrowed)
        done = done.unionByName(narrowed.where("j - i <= 1"))
        pending = narrowed.where("j - i > 1")
    return done.select(*GROUP)


def correlate_level(
    df: DataFrame,
    rules: dict[str, Rule],
    correlations: Sequence[Correlation],
    fields: FieldMap | None = None,
    *,
    time: str = "event_time",
    default_case: str = "insensitive",
    drop_missing_keys: bool = False,
) -> DataFrame:
    """Alerts of correlations whose references are all in `rules`."""
    correlations = list(correlations)
    rows = correlation_rows(
        df, rules, correlations, fields, time=time, default_case=default_case,
        drop_missing_keys=drop_missing_keys,
    ).withColumn("ws", _window_start())
    needs = Needs.of(correlations)
    # count_distinct shuffles by (group, value) first, which splits a hot group.
    aggs = measures(needs, last_position(correlations))
    if needs.distinct:
        aggs.append(F.count_distinct("v").alias("d"))
    fired = rows.groupBy(*GROUP).agg(*aggs).where(fires(correlations))
    long_ = [
        i for i, c in enumerate(correlations)
        if c.kind == "temporal_ordered" and len(c.refs) > 2
    ]
    if long_:
        inside = F.col("c").isin(long_)
        fired = materialize(fired.select(*GROUP, "n", "lo_us", "hi_us"))
        settled = _settle_order(
            rows.where(inside), fired.where(inside), correlations
        )
        fired = fired.where(~inside).select(*GROUP).unionByName(settled)
    sizes = " ".join(f"WHEN {i} THEN {c.window_seconds}L" for i, c in enumerate(correlations))
    return as_alerts(
        fired, correlations,
        F.timestamp_seconds(F.col("ws")),
        F.timestamp_seconds(F.expr(f"ws + CASE c {sizes} END")),
    )


def alerts_to_events(alerts: DataFrame) -> DataFrame:
    """Alerts as events that another correlation can read."""
    return alerts.select(
        "rule_id", "rule_title", "severity", F.col("fired_at").alias("timestamp"),
        "window_start", "window_end", "correlation_key", F.lit(True).alias("is_alert"),
    )


def alert_reference(ref: str) -> Rule:
    """The rule that an alert-event of correlation `ref` matches."""
    return Rule(ref, ref, "informational", {"sel": {"rule_id|cased": _literal(ref)}}, "sel")


def _literal(text: str) -> str:
    return text.replace("\\", "\\\\").replace("*", "\\*").replace("?", "\\?")


def correlate(
    df: DataFrame,
    ruleset: Ruleset,
    fields: FieldMap | None = None,
    *,
    time: str = "event_time",
    default_case: str = "insensitive",
    suppressed: bool = True,
    **options,
) -> DataFrame:
    """Alerts of every correlation, nested ones included.

    Nested correlations read the alerts of earlier levels before suppression.
    Events are read once: alerts that have more than one reader are written to
    the checkpoint folder first.
    """
    from .suppress import suppress_alerts

    by_id = ruleset.by_id
    seen: DataFrame | None = None
    for depth, level in enumerate(ruleset.levels):
        if depth:
            seen = materialize(seen)
        over_rules = [c for c in level if all(r in by_id for r in c.refs)]
        nested = [c for c in level if c not in over_rules]
        if over_rules:
            out = correlate_level(
                df, by_id, over_rules, fields, time=time, default_case=default_case, **options
            )
            seen = out if seen is None else seen.unionByName(out)
        if nested:
            refs = {r: alert_reference(r) for c in nested for r in c.refs}
            out = correlate_level(alerts_to_events(seen), refs, nested, time="timestamp", **options)
            seen = seen.unionByName(out)
    if seen is None:
        raise ValueError("the ruleset has no correlations")
    if not suppressed:
        return seen.drop("suppress_seconds")
    if all(c.suppress_seconds for c in ruleset.correlations):
        seen = suppress_alerts(seen)
    elif any(c.suppress_seconds for c in ruleset.correlations):
        seen = materialize(seen)
        free = seen.where(F.col("suppress_seconds").isNull())
        held = suppress_alerts(seen.where(F.col("suppress_seconds").isNotNull()))
        seen = free.unionByName(held)
    return seen.drop("suppress_seconds")


def cardinality_report(
    df: DataFrame,
    ruleset: Ruleset,
    fields: FieldMap | None = None,
    *,
    limit: int = 100_000,
    exact: bool = False,
    time: str = "event_time",
    default_case: str = "insensitive",
) -> DataFrame:
    """Distinct group keys per correlation, and whether that is over the limit."""
    chosen = [c for c in ruleset.correlations if all(r in ruleset.by_id for r in c.refs)]
    rows = correlation_rows(df, ruleset.by_id, chosen, fields, time=time, default_case=default_case)
    count = F.count_distinct("k") if exact else F.approx_count_distinct("k")
    allowed = ", ".join(str(i) for i, c in enumerate(chosen) if c.allow_high_cardinality)
    over = F.col("keys") > limit
    if allowed:
        over = over & ~F.expr(f"c IN ({allowed})")
    counted = rows.groupBy("c").agg(count.alias("keys")).withColumn("warn", over)
    return _described(counted, chosen).select("rule_id", "keys", "warn")
