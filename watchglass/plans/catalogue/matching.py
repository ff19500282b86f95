"""RUL*: a ruleset over `events`."""

from __future__ import annotations

from pyspark.sql import functions as F

from ...functions.fields import FieldMap
from ...operators import matching as m
from ...operators.shaping import parse_events
from .common import ALERTS_SQL, EVENT_FIELDS, MATCHES_SQL, base_alerts, events, plain_times, rules, table


def _matched(spark, sf, keep=("event_id",)):
    return m.matches(events(spark, sf), rules().rules, EVENT_FIELDS, keep=list(keep))


def _matches(spark, sf):
    return _matched(spark, sf).select("event_id", "rule_id")


def _many_specs(n):
    kinds = ["click", "view", "signup", "purchase", "error"]
    return [
        {
            "title": f"rule {i}", "id": f"r{i:04d}",
            "detection": {
                "sel": {"event": kinds[i % 5], "value|gte": (i * 7) % 400},
                "skip": {"props.k": str(i % 90)}, "condition": "sel and not skip",
            },
        }
        for i in range(n)
    ]


def many_rules(n):
    from ...operators.rules import ruleset_from_dicts

    def run(spark, sf):
        rs = ruleset_from_dicts(_many_specs(n)).rules
        return m.rule_coverage(m.matches(events(spark, sf), rs, EVENT_FIELDS, keep=[]), rs).select(
            "rule_id", "matches"
        )

    return run


_HUNDRED_SQL = """
WITH r AS (
  SELECT i, ['click', 'view', 'signup', 'purchase', 'error'][i % 5 + 1] AS kind,
         (i * 7) % 400 AS least, CAST(i % 90 AS VARCHAR) AS skip
  FROM range(100) t(i)
)
SELECT printf('r%04d', r.i) AS rule_id, count(e.event_id) AS matches
FROM r LEFT JOIN events e ON e.event_type = r.kind AND e.value >= r.least
  AND coalesce(json_extract_string(e.props, '$.k'), '') <> r.skip
GROUP BY 1
"""


def _alerts(spark, sf):
    df = base_alerts(spark, sf)
    return plain_times(df.select(
        "rule_id", "rule_title", "severity", "fired_at", "window_start", "correlation_key",
        F.array_join("tags", ",").alias("tag_text"), F.size("matched_events").alias("n_events"),
    ))


def _projection(spark, sf):
    df = base_alerts(spark, sf)
    raw = F.get("matched_events", F.lit(0))
    return df.select(
        "rule_id",
        F.get_json_object(raw, "$.event_id").cast("bigint").alias("event_id"),
        F.get_json_object(raw, "$.user_id").cast("bigint").alias("user_id"),
        F.get_json_object(raw, "$.event_type").alias("event_type"),
    )


def _documents(spark, sf):
    """Events as JSON text; every 17th line is broken."""
    props = F.parse_json("props").alias("props")
    body = F.to_json(F.struct("event_id", "event_type", "user_id", "value", props))
    return parse_events(events(spark, sf).select(
        "event_id",
        F.when(F.col("event_id") % 17 == 0, F.concat(F.lit("broken "), body)).otherwise(body)
        .cast("binary").alias("value"),
    ))


def _dead_letters(spark, sf):
    letters = m.not_json_letters(_documents(spark, sf))
    return letters.select("reason", "rule_id", F.regexp_extract("event", r'"event_id":(\d+)', 1).cast("bigint").alias("event_id"))


def _document_matches(spark, sf):
    return m.matches(
        _documents(spark, sf), rules().rules,
        FieldMap(document="data", raw="raw", aliases={"event": "event_type", "latency_ms": "value"}),
        keep=["event_id"],
    ).select("event_id", "rule_id")


_RAISING = m.PythonRule(
    "r-python", "Ratio", lambda e: 100 / (e["event_id"] % 7) > 30, ("event_id",)
)


def _python_rule(spark, sf):
    out = m.with_python_rule(events(spark, sf).select("event_id"), _RAISING)
    return out.where("outcome.hit").select("event_id")


def _python_letters(spark, sf):
    out = m.with_python_rule(events(spark, sf).select("event_id"), _RAISING)
    return m.predicate_letters(out, _RAISING, F.col("event_id")).select(
        "reason", "rule_id", F.col("event").cast("bigint").alias("event_id"), "error"
    )


def _one_or_many(spark, sf):
    """Rules that say the same twice over a field, inside a set of sixty."""
    from ...operators.rules import ruleset_from_dicts

    tricky = [
        {"title": "twice", "id": "twice", "detection": {
            "s": {"event": ["error", "view"], "event|cased": ["view", "click"]}, "condition": "s"}},
        {"title": "named", "id": "named", "detection": {
            "Sel": {"event": "view"}, "sel": {"event": "none"}, "condition": "Sel"}},
    ]
    filler = [
        {"title": f"f{i}", "id": f"f{i}", "detection": {"s": {"event": ["error", f"x{i}"]}, "condition": "s"}}
        for i in range(58)
    ]
    rules = ruleset_from_dicts([*tricky, *filler]).rules
    found = m.matches(events(spark, sf), rules, EVENT_FIELDS, keep=["event_id"])
    return found.select("event_id", "rule_id")


def _bad_pattern(spark, sf):
    """Of two rules one cannot be compiled: the other's matches, and a letter."""
    from ...operators.rules import ruleset_from_dicts

    rules = ruleset_from_dicts([
        {"title": "Bad", "id": "bad", "detection": {"s": {"event|re": "(unclosed"}, "condition": "s"}},
        {"title": "Good", "id": "good", "detection": {"s": {"event|re": "^err"}, "condition": "s"}},
    ]).rules
    found = m.matches(events(spark, sf), rules, EVENT_FIELDS, keep=["event_id"])
    letters = m.rule_letters(spark, rules)
    return found.select("event_id", "rule_id", F.lit("match").alias("kind")).unionByName(
        letters.select(F.lit(None).cast("bigint").alias("event_id"), "rule_id", F.col("reason").alias("kind"))
    )


def _counters(spark, sf):
    return m.rule_counters(_matched(spark, sf, keep=()))


def _coverage(spark, sf):
    from ...operators.rules import ruleset_from_dicts
    from .common import RULE_SPECS

    silent = {"title": "Silent", "id": "r-silent", "detection": {"s": {"event": "nothing"}, "condition": "s"}}
    rs = ruleset_from_dicts([*RULE_SPECS, silent]).rules
    return m.rule_coverage(m.matches(events(spark, sf), rs, EVENT_FIELDS, keep=[]), rs)


def _records(spark, sf):
    df = m.matches(events(spark, sf), rules().rules, EVENT_FIELDS, keep=["event_id"])
    rec = m.match_records(df, F.to_json(F.struct("event_id")))
    get = lambda p: F.get_json_object("record", p)
    return rec.select(
        get("$.event").alias("event"), get("$.rule_name").alias("rule_name"),
        get("$.severity").alias("severity"), get("$.message").alias("message"),
        F.get_json_object(get("$.record"), "$.event_id").cast("bigint").alias("event_id"),
    )


def _replay(spark, sf):
    """Each user's events as one replayed file, checked against wrong expectations for some."""
    docs = _documents(spark, sf)
    ev = table(spark, sf, "events").select("event_id", F.col("user_id").cast("string").alias("path"))
    docs = docs.join(ev, "event_id")
    expected = ev.select("path").distinct().select(
        "path", F.expr("array('error_burst', 'new_signup', 'big_purchase', 'odd_view', 'click_outside_the_nineties')").alias("matches"),
        F.expr("CAST(path AS BIGINT) % 3 <> 0").alias("dropped"),
    )
    from ...operators.rules import ruleset_from_dicts
    from .common import RULE_SPECS

    fields = FieldMap(document="data", raw="raw", aliases={"event": "event_type", "latency_ms": "value"})
    report = m.replay_report(docs, ruleset_from_dicts(RULE_SPECS), expected, fields)
    return report.select("path", F.array_join("fired", ",").alias("fired"), "was_dropped", "ok")


QUERIES = {
    "rul_one_or_many": (
        _one_or_many,
        "SELECT event_id, 'twice' AS rule_id FROM events WHERE event_type = 'view' UNION ALL"
        " SELECT event_id, 'named' FROM events WHERE event_type = 'view' UNION ALL"
        " SELECT event_id, 'f' || i FROM events, range(58) AS r(i) WHERE event_type = 'error'",
    ),
    "rul_bad_pattern": (
        _bad_pattern,
        "SELECT event_id, 'good' AS rule_id, 'match' AS kind FROM events WHERE event_type LIKE 'err%'"
        " UNION ALL SELECT NULL, 'bad', 'predicate raised'",
    ),
    "rul_matches": (_matches, f"WITH {MATCHES_SQL} SELECT event_id, rule_id FROM hits"),
    "rul_hundred_rules": (many_rules(100), _HUNDRED_SQL),
    "rul_alerts": (
        _alerts,
        f"WITH {ALERTS_SQL} SELECT rule_id, rule_title, severity, fired_at, CAST(NULL AS TIMESTAMP) AS window_start,"
        " CAST(NULL AS VARCHAR) AS correlation_key, tag_text, 1 AS n_events FROM alerts",
    ),
    "rul_projection": (
        _projection,
        f"WITH {MATCHES_SQL} SELECT rule_id, event_id, user_id,"
        " CASE WHEN rule_id <> 'r-error' THEN event_type END AS event_type FROM hits",
    ),
    "rul_dead_letter": (
        _dead_letters,
        "SELECT 'non-JSON message' AS reason, CAST(NULL AS VARCHAR) AS rule_id, event_id"
        " FROM events WHERE event_id % 17 = 0",
    ),
    "rul_documents": (
        _document_matches,
        f"WITH {MATCHES_SQL} SELECT event_id, rule_id FROM hits"
        " WHERE event_id % 17 <> 0",
    ),
    "rul_python_rule": (
        _python_rule,
        "SELECT event_id FROM events WHERE event_id % 7 BETWEEN 1 AND 3",
    ),
    "rul_predicate_letters": (
        _python_letters,
        "SELECT 'predicate raised' AS reason, 'r-python' AS rule_id, event_id,"
        " 'ZeroDivisionError: division by zero' AS error FROM events WHERE event_id % 7 = 0",
    ),
    "rul_counters": (_counters, f"WITH {MATCHES_SQL} SELECT rule_id, count(*) AS matches FROM hits GROUP BY 1"),
    "rul_coverage": (
        _coverage,
        f"WITH {MATCHES_SQL} SELECT rule_id, rule_name, severity, count(*) AS matches FROM hits GROUP BY 1, 2, 3"
        " UNION ALL SELECT 'r-silent', 'silent', 'medium', 0",
    ),
    "rul_records": (
        _records,
        f"WITH {MATCHES_SQL} SELECT 'DETECTION_MATCH' AS event, rule_name, severity,"
        " 'rule ''' || rule_name || ''' matched' AS message, event_id FROM hits",
    ),
    "rul_replay": (
        _replay,
        f"""WITH {MATCHES_SQL}, good AS (
          SELECT user_id, coalesce(string_agg(DISTINCT rule_name, ',' ORDER BY rule_name), '') AS fired
          FROM hits WHERE event_id % 17 <> 0 GROUP BY 1),
        users AS (SELECT user_id, bool_or(event_id % 17 = 0) AS was_dropped FROM events GROUP BY 1)
        SELECT CAST(u.user_id AS VARCHAR) AS path, coalesce(g.fired, '') AS fired, u.was_dropped,
          coalesce(g.fired, '') = 'big_purchase,click_outside_the_nineties,error_burst,new_signup,odd_view' AND u.was_dropped = (u.user_id % 3 <> 0) AS ok
        FROM users u LEFT JOIN good g USING (user_id)""",
    ),
}
