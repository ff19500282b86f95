"""COR*: windowed correlations over `events`."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ...operators import correlate as c
from ...operators.rules import ruleset_from_dicts
from ...operators.suppress import suppress_alerts
from .common import EVENT_FIELDS, events, plain_times

KIND_RULES = [
    {"title": f"is {k}", "id": f"is-{k}", "detection": {"s": {"event": k}, "condition": "s"}}
    for k in ("click", "view", "signup", "purchase", "error")
] + [{"title": "pricey", "id": "pricey", "detection": {"s": {"value|gte": 60}, "condition": "s"}}]


def correlation(name, kind, refs, by, span, condition=None, **more):
    spec = {
        "title": name, "id": name, "level": "high", "type": kind, "rules": refs,
        "group-by": by, "timespan": span, **more,
    }
    if condition:
        spec["condition"] = condition
    return spec


def shown(alerts: DataFrame) -> DataFrame:
    return plain_times(alerts.select("rule_id", "correlation_key", "window_start", "window_end"))


def run(*specs, exprs=None, **options):
    rs = ruleset_from_dicts([*KIND_RULES, *specs])

    def query(spark, sf):
        df = events(spark, sf)
        if exprs:
            df = df.selectExpr("*", *(f"{sql} AS {name}" for name, sql in exprs.items()))
        return shown(c.correlate(df, rs, EVENT_FIELDS, **options))

    return query


COUNT = correlation("cor-count", "event_count", ["is-error"], "user", "1d", {"gte": 2})
ANY_OF = correlation("cor-any", "event_count", ["is-error", "pricey"], "user", "1d", {"gte": 3})
VALUES = correlation(
    "cor-values", "value_count", ["is-error", "is-view", "is-click"], "user", "1d", {"gte": 3, "field": "event"}
)
BOTH = correlation("cor-both", "temporal", ["is-error", "is-purchase"], "user", "1d")
ORDER = correlation("cor-order", "temporal_ordered", ["is-error", "is-purchase"], "user", "1d")
ORDER3 = correlation(
    "cor-order3", "temporal_ordered", ["is-error", "is-view", "is-purchase"], "user", "7d"
)
ORDER4 = correlation(
    "cor-order4", "temporal_ordered", ["is-click", "is-error", "is-view", "is-purchase"], "user", "10d"
)
P95 = correlation(
    "cor-p95", "event_count", ["is-error", "is-click"], "event", "1d", {"gte": 140},
    options={"percentile": 95.0, "percentile_field": "latency_ms"},
)


def windows(seconds: int) -> str:
    """SQL for the start of the epoch-aligned window, in seconds."""
    return f"CAST(floor(epoch(ts) / {seconds}) AS BIGINT) * {seconds}"


def framed(rule: str, key: str, seconds: int, source: str) -> str:
    """SQL rows in the shape of `shown` from a source with columns w and the key."""
    return (
        f"SELECT '{rule}' AS rule_id, {key} AS correlation_key,"
        f" TIMESTAMP '1970-01-01 00:00:00' + to_seconds(w) AS window_start,"
        f" TIMESTAMP '1970-01-01 00:00:00' + to_seconds(w + {seconds}) AS window_end FROM ({source})"
    )


def per_user(rule: str, seconds: int, where: str, having: str) -> str:
    return framed(
        rule, "CAST(user_id AS VARCHAR)", seconds,
        f"SELECT user_id, {windows(seconds)} AS w FROM events WHERE {where} GROUP BY 1, 2 HAVING {having}",
    )


def _op(op: str, t: int):
    spec = correlation(f"cor-{op}", "event_count", ["is-view"], "user", "1d", {op: t})
    sign = {"gte": ">=", "gt": ">", "lte": "<=", "lt": "<", "eq": "="}[op]
    return run(spec), per_user(f"cor-{op}", 86400, "event_type = 'view'", f"count(*) {sign} {t}")


def _percentile(name: str, condition: dict, having: str, by: str = "event", p: float = 90.0, **extra):
    spec = correlation(
        name, "event_count", ["is-error", "is-view", "is-click"], by, "1d", condition or None,
        options={"percentile": p, "percentile_field": "latency_ms", **extra},
    )
    col = {"event": "event_type", "user": "CAST(user_id AS VARCHAR)"}[by]
    sql = framed(
        name, "g", 86400,
        f"SELECT {col} AS g, {windows(86400)} AS w, quantile_cont(value, {p / 100}) AS q FROM events"
        f" WHERE event_type IN ('error', 'view', 'click') GROUP BY 1, 2 HAVING {having}",
    )
    return run(spec), sql


_ORDER3_SQL = f"""
SELECT DISTINCT a.user_id, {windows(604800).replace('ts', 'a.ts')} AS w
FROM events a JOIN events b ON a.user_id = b.user_id AND a.event_type = 'error' AND b.event_type = 'view'
  AND b.ts >= a.ts AND floor(epoch(a.ts) / 604800) = floor(epoch(b.ts) / 604800)
JOIN events c ON c.user_id = b.user_id AND c.event_type = 'purchase'
  AND c.ts >= b.ts AND floor(epoch(c.ts) / 604800) = floor(epoch(b.ts) / 604800)
"""
_ORDER4_SQL = f"""
WITH RECURSIVE step AS (
  SELECT user_id, {windows(864000)} AS w, 0 AS i, min(ts) AS reached
  FROM events WHERE event_type = 'click' GROUP BY 1, 2
  UNION ALL
  SELECT s.user_id, s.w, s.i + 1,
    (SELECT min(e.ts) FROM events e WHERE e.user_id = s.user_id AND e.ts >= s.reached
       AND {windows(864000).replace('ts', 'e.ts')} = s.w
       AND e.event_type = ['error', 'view', 'purchase'][s.i + 1])
  FROM step s WHERE s.i < 3 AND s.reached IS NOT NULL
)
SELECT user_id, w FROM step WHERE i = 3 AND reached IS NOT NULL
"""

_NESTED = correlation("cor-nested", "event_count", ["cor-count"], "rule_id", "7d", {"gte": 4})
_DEEP = correlation("cor-deep", "temporal", ["cor-nested"], "severity", "30d")

_FAN = [
    per_user("cor-any", 86400, "event_type = 'error' OR value >= 60", "count(*) >= 3"),
    per_user(
        "cor-values", 86400, "event_type IN ('error', 'view', 'click')", "count(DISTINCT event_type) >= 3"
    ),
    per_user(
        "cor-both", 86400, "event_type IN ('error', 'purchase')", "count(DISTINCT event_type) = 2"
    ),
    per_user(
        "cor-order", 86400, "event_type IN ('error', 'purchase')",
        "min(ts) FILTER (event_type = 'error') <= max(ts) FILTER (event_type = 'purchase')",
    ),
    framed(
        "cor-p95", "event_type", 86400,
        f"SELECT event_type, {windows(86400)} AS w FROM events WHERE event_type IN ('error', 'click')"
        " GROUP BY 1, 2 HAVING quantile_cont(value, 0.95) >= 140",
    ),
]
_COUNT_SQL = per_user("cor-count", 86400, "event_type = 'error'", "count(*) >= 2")


def _suppressed(spark, sf):
    rs = ruleset_from_dicts([*KIND_RULES, {**COUNT, "options": {"suppress_window_seconds": 259200}}])
    return shown(c.correlate(events(spark, sf), rs, EVENT_FIELDS))


def _suppress_all(spark, sf):
    rs = ruleset_from_dicts([*KIND_RULES, BOTH])
    found = c.correlate(events(spark, sf), rs, EVENT_FIELDS)
    return shown(suppress_alerts(found, 5 * 86400))


def greedy_sql(source: str, seconds: int) -> str:
    """Recursive SQL that keeps alerts `seconds` after the last kept one."""
    return f"""
WITH RECURSIVE fired AS ({source}),
kept AS (
  SELECT rule_id, correlation_key, min(window_end) AS last_kept FROM fired GROUP BY 1, 2
  UNION ALL
  SELECT k.rule_id, k.correlation_key,
    (SELECT min(f.window_end) FROM fired f WHERE f.rule_id = k.rule_id
       AND f.correlation_key = k.correlation_key AND f.window_end >= k.last_kept + to_seconds({seconds}))
  FROM kept k WHERE k.last_kept IS NOT NULL
)
SELECT f.* FROM fired f JOIN kept k ON f.rule_id = k.rule_id AND f.correlation_key = k.correlation_key
  AND f.window_end = k.last_kept
"""


def _cardinality(spark, sf):
    rs = ruleset_from_dicts([
        *KIND_RULES, COUNT, BOTH,
        {**correlation("cor-wide", "event_count", ["is-view"], "event_id", "1d", {"gte": 1}),
         "options": {"allow_high_cardinality": True}},
        correlation("cor-noisy", "event_count", ["is-view"], "event_id", "1d", {"gte": 1}),
    ])
    return c.cardinality_report(events(spark, sf), rs, EVENT_FIELDS, limit=1600, exact=True)


def _alert_events(spark, sf):
    rs = ruleset_from_dicts([*KIND_RULES, COUNT])
    out = c.alerts_to_events(c.correlate(events(spark, sf), rs, EVENT_FIELDS))
    return plain_times(out)


QUERIES = {
    "cor_event_count": (run(COUNT), _COUNT_SQL),
    "cor_any_reference": (run(ANY_OF), _FAN[0]),
    **{f"cor_threshold_{op}": _op(op, t) for op, t in (("gte", 3), ("gt", 2), ("lte", 1), ("lt", 2), ("eq", 2))},
    "cor_threshold_range": (
        run({**correlation("cor-range", "event_count", ["is-view"], "user", "1d"),
             "options": {"threshold_range": [2, 3]}}),
        per_user("cor-range", 86400, "event_type = 'view'", "count(*) BETWEEN 2 AND 3"),
    ),
    "cor_composite_key": (
        run(correlation("cor-pair", "event_count", ["is-error", "is-view"], ["user", "kind"], "2d", {"gte": 2}),
            exprs={"kind": "nullif(event_type, 'view')"}),
        framed(
            "cor-pair", "k", 172800,
            f"SELECT user_id || '|' || coalesce(nullif(event_type, 'view'), 'MISSING') AS k, {windows(172800)} AS w"
            " FROM events WHERE event_type IN ('error', 'view') GROUP BY 1, 2 HAVING count(*) >= 2",
        ),
    ),
    "cor_missing_key": (
        run(correlation("cor-missing", "event_count", ["is-error", "is-view"], "who", "1d", {"gte": 5}),
            exprs={"who": "if(event_id % 3 = 0, NULL, user_id)"}),
        framed(
            "cor-missing", "k", 86400,
            f"SELECT CASE WHEN event_id % 3 = 0 THEN 'MISSING' ELSE CAST(user_id AS VARCHAR) END AS k,"
            f" {windows(86400)} AS w FROM events WHERE event_type IN ('error', 'view')"
            " GROUP BY 1, 2 HAVING count(*) >= 5",
        ),
    ),
    "cor_drop_missing_keys": (
        run(correlation("cor-missing", "event_count", ["is-error", "is-view"], "who", "7d", {"gte": 5}),
            exprs={"who": "if(event_id % 3 = 0, NULL, user_id)"}, drop_missing_keys=True),
        framed(
            "cor-missing", "CAST(user_id AS VARCHAR)", 604800,
            f"SELECT user_id, {windows(604800)} AS w FROM events WHERE event_type IN ('error', 'view')"
            " AND event_id % 3 <> 0 GROUP BY 1, 2 HAVING count(*) >= 5",
        ),
    ),
    "cor_value_count": (run(VALUES), _FAN[1]),
    "cor_value_count_users": (
        run(correlation("cor-users", "value_count", ["pricey"], "event", "1h", {"gte": 3, "field": "user"})),
        framed(
            "cor-users", "event_type", 3600,
            f"SELECT event_type, {windows(3600)} AS w FROM events WHERE value >= 60 GROUP BY 1, 2"
            " HAVING count(DISTINCT user_id) >= 3",
        ),
    ),
    "cor_temporal": (run(BOTH), _FAN[2]),
    "cor_temporal_ordered": (run(ORDER), _FAN[3]),
    "cor_temporal_ordered3": (
        run(ORDER3), framed("cor-order3", "CAST(user_id AS VARCHAR)", 604800, _ORDER3_SQL),
    ),
    "cor_temporal_ordered4": (
        run(ORDER4), framed("cor-order4", "CAST(user_id AS VARCHAR)", 864000, _ORDER4_SQL),
    ),
    "cor_percentile": (run(P95), _FAN[4]),
    "cor_percentile_gt": _percentile("cor-p90-gt", {"gt": 110}, "q > 110"),
    "cor_percentile_lt": _percentile("cor-p90-lt", {"lt": 110}, "q < 110"),
    "cor_percentile_range": _percentile("cor-p90-range", {}, "q BETWEEN 90 AND 115", threshold_range=[90, 115]),
    "cor_percentile_small_groups": _percentile("cor-p50-user", {"gte": 60}, "q >= 60", by="user", p=50.0),
    "cor_fanout": (run(ANY_OF, VALUES, BOTH, ORDER, P95), " UNION ALL ".join(f"({s})" for s in _FAN)),
    "cor_nested": (
        run(COUNT, _NESTED, _DEEP),
        f"""WITH inner_ AS ({_COUNT_SQL}),
        outer_ AS (
          SELECT CAST(floor(epoch(window_end) / 604800) AS BIGINT) * 604800 AS w FROM inner_
          GROUP BY 1 HAVING count(*) >= 4),
        deep AS (SELECT DISTINCT CAST(floor((w + 604800) / 2592000) AS BIGINT) * 2592000 AS w FROM outer_)
        SELECT * FROM inner_ UNION ALL {framed('cor-nested', "'cor-count'", 604800, 'SELECT w FROM outer_')}
        UNION ALL {framed('cor-deep', "'high'", 2592000, 'SELECT w FROM deep')}""",
    ),
    "cor_alert_events": (
        _alert_events,
        f"SELECT rule_id, 'cor-count' AS rule_title, 'high' AS severity, window_end AS timestamp, window_start,"
        f" window_end, correlation_key, TRUE AS is_alert FROM ({_COUNT_SQL})",
    ),
    "cor_suppress": (_suppressed, greedy_sql(_COUNT_SQL, 259200)),
    "cor_suppress_any_rule": (_suppress_all, greedy_sql(_FAN[2], 432000)),
    "cor_cardinality": (
        _cardinality,
        """SELECT 'cor-count' AS rule_id, count(DISTINCT user_id) AS keys, count(DISTINCT user_id) > 1600 AS warn
           FROM events WHERE event_type = 'error'
           UNION ALL SELECT 'cor-both', count(DISTINCT user_id), count(DISTINCT user_id) > 1600
           FROM events WHERE event_type IN ('error', 'purchase')
           UNION ALL SELECT 'cor-wide', count(DISTINCT event_id), FALSE FROM events WHERE event_type = 'view'
           UNION ALL SELECT 'cor-noisy', count(DISTINCT event_id), count(DISTINCT event_id) > 1600
           FROM events WHERE event_type = 'view'""",
    ),
}
