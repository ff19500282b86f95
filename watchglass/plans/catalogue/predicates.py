"""PRD*: one rule each; the result is the keys of the matching rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from ...functions.fields import FieldMap
from ...operators import joins, matching
from ...operators.rules import FieldProfile, ruleset_from_dicts
from ...operators.shaping import parse_events
from .common import EVENT_FIELDS, events, one_rule, rows_matching, table


def _events(detection, *, fields=EVENT_FIELDS, exprs=None, **options):
    def run(spark, sf):
        df = events(spark, sf)
        if exprs:
            df = df.selectExpr("*", *(f"{sql} AS {name}" for name, sql in exprs.items()))
        return rows_matching(df, detection, "event_id", fields, **options)

    return run


def _on(name, key, detection, fields=None):
    return lambda spark, sf: rows_matching(table(spark, sf, name), detection, key, fields)


def _expand_in(spark, sf):
    rules = ruleset_from_dicts(
        [{"title": "watched", "detection": {"s": {"user|expand": "%watched%"}, "condition": "s"}}],
        placeholders={"watched": ["3", "5", "8", "13"]},
    ).rules
    return matching.explode_hits(events(spark, sf), rules, EVENT_FIELDS, keep=["event_id"]).select("event_id")


def _expand_join(spark, sf):
    lists = table(spark, sf, "supplier").select(
        F.when(F.col("s_nationkey") < 10, "watched").otherwise("other").alias("name"),
        F.col("s_suppkey").cast("string").alias("value"),
    )
    found = joins.in_value_list(events(spark, sf), F.col("user_id"), lists, "watched")
    return found.select("event_id")


def _logsource(spark, sf):
    df = events(spark, sf).withColumn("origin", F.expr("if(event_id % 2 = 0, 'Shop', 'blog')"))
    rules = ruleset_from_dicts([{
        "title": "scoped", "logsource": {"product": "shop", "service": "any"},
        "detection": {"s": {"event": "error"}, "condition": "s"},
    }]).rules
    fields = FieldMap(aliases={"event": "event_type"}, logsource={"product": "origin"})
    return matching.explode_hits(df, rules, fields, keep=["event_id"]).select("event_id")


def _profile(spark, sf):
    rules = ruleset_from_dicts(
        [{
            "title": "renamed", "logsource": {"product": "shop", "category": "order"},
            "detection": {"s": {"Action": "purchase"}, "f": {"Account|startswith": "1"}, "condition": "s and not f"},
        }],
        profiles=[FieldProfile(
            {"product": "shop", "category": "order"},
            rename={"Action": "event_type", "Account": "user_id"}, add={"value|gte": 20},
        )],
    ).rules
    return matching.explode_hits(events(spark, sf), rules, keep=["event_id"]).select("event_id")


_IPV4 = "concat('10.', user_id % 256, '.', event_id % 256, '.', CAST(floor(value / 2) AS INT))"
_IPV6 = "concat('2001:db8:', lower(hex(user_id % 16)), '::', lower(hex(event_id % 65536)))"
_CMD = (
    "concat('tool.exe ', element_at(array('-', '/', '–', '—', '+'), CAST(event_id % 5 + 1 AS INT)),"
    " 'enc ', event_type)"
)
_SHIFTED = "base64(concat(repeat('x', CAST(event_id % 3 AS INT)), event_type, 'tail'))"
_WIDE = "base64(encode(concat('ab', event_type, 'z'), 'UTF-16LE'))"

def _keyword_json(spark, sf):
    """Keywords over documents with escapes, nesting and numbers, and over typed columns."""
    text = F.concat(
        F.lit('{"cmd": "C:\\\\Windows\\\\'), F.col("event_type"), F.lit('", "note": {"view": [{"x": "caf\\u00e9 '),
        F.col("event_type"), F.lit('"}, "a \\"quoted\\" '), F.col("event_type"), F.lit('\\n"]}, "n": '), F.col("user_id"), F.lit("}"),
    )
    docs = parse_events(events(spark, sf).select("event_id", text.alias("value")))
    rules = ruleset_from_dicts([
        {"title": name, "id": name, "detection": {"kw": [kw], "condition": "kw"}} for name, kw in (
            ("path", "c:\\windows\\error"), ("accent", "Caf\u00e9 CLICK"), ("number", "42"), ("name", "cmd"),
            ("wild", '"quoted" *iew\n'), ("apart", "caf\u00e9*quoted"),
        )
    ])
    found = matching.matches(docs, rules.rules, FieldMap(document="data", raw="raw"), keep=["event_id"])
    typed = one_rule({"kw": ["SIGNUP", "77", "event_type"], "condition": "kw"}, id="columns")
    columns = matching.matches(events(spark, sf).select("event_id", "user_id", "event_type", "props"), typed.rules, EVENT_FIELDS, keep=["event_id"])
    return found.unionByName(columns).select("event_id", F.col("rule_id").alias("kw"))


QUERIES = {
    "prd_equality": (
        _events({"s": {"event": "ERROR"}, "condition": "s"}),
        "SELECT event_id FROM events WHERE lower(event_type) = 'error'",
    ),
    "prd_equality_sensitive": (
        _events({"s": {"kind": "ERROR"}, "condition": "s"}, default_case="sensitive",
                exprs={"kind": "if(event_id % 2 = 0, upper(event_type), event_type)"}),
        "SELECT event_id FROM events WHERE event_type = 'error' AND event_id % 2 = 0",
    ),
    "prd_list_in": (
        _events({"s": {"event": ["signup", "Purchase"]}, "condition": "s"}),
        "SELECT event_id FROM events WHERE event_type IN ('signup', 'purchase')",
    ),
    "prd_and_fields": (
        _events({"s": {"event": "error", "latency_ms|gt": 100}, "condition": "s"}),
        "SELECT event_id FROM events WHERE event_type = 'error' AND value > 100",
    ),
    "prd_nested_path": (
        _events({"s": {"props.k": "42"}, "condition": "s"}),
        "SELECT event_id FROM events WHERE json_extract_string(props, '$.k') = '42'",
    ),
    "prd_not_filter": (
        _events({"s": {"value|gte": 50}, "f": {"kind|startswith": "c"}, "condition": "s and not f"},
                exprs={"kind": "nullif(event_type, 'view')"}),
        "SELECT event_id FROM events WHERE value >= 50"
        " AND NOT coalesce(starts_with(nullif(event_type, 'view'), 'c'), FALSE)",
    ),
    "prd_condition_nesting": (
        _events({"a": {"event": "click"}, "b": {"value|lt": 20}, "c": {"props.k|endswith": "7"},
                 "condition": "(a or c) and not (b and c)"}),
        "SELECT event_id FROM events WHERE (event_type = 'click' OR ends_with(json_extract_string(props, '$.k'), '7'))"
        " AND NOT (value < 20 AND ends_with(json_extract_string(props, '$.k'), '7'))",
    ),
    "prd_one_of": (
        _events({"sel_a": {"event": "click", "value|lt": 10}, "sel_b": {"props.k": 5},
                 "other": {"event": "view"}, "condition": "1 of sel_*"}),
        "SELECT event_id FROM events WHERE (event_type = 'click' AND value < 10)"
        " OR json_extract_string(props, '$.k') = '5'",
    ),
    "prd_all_of": (
        _events({"sel_a": {"event": ["click", "view"]}, "sel_b": {"value|gte": 80}, "condition": "all of them"}),
        "SELECT event_id FROM events WHERE event_type IN ('click', 'view') AND value >= 80",
    ),
    "prd_list_of_maps": (
        _events({"s": [{"event": "error", "value|gt": 90}, {"event": "click", "value|lt": 3}], "condition": "s"}),
        "SELECT event_id FROM events WHERE (event_type = 'error' AND value > 90)"
        " OR (event_type = 'click' AND value < 3)",
    ),
    "prd_keyword": (
        _on("documents", "doc_id", {"kw": ["license", "copy*right"], "condition": "kw"}, FieldMap(raw="text")),
        "SELECT doc_id FROM documents WHERE text ILIKE '%license%' OR text ILIKE '%copy%right%'",
    ),
    "prd_keyword_json": (
        _keyword_json,
        "SELECT event_id, 'path' AS kw FROM events WHERE event_type = 'error' UNION ALL"
        " SELECT event_id, 'accent' FROM events WHERE event_type = 'click' UNION ALL"
        " SELECT event_id, 'number' FROM events WHERE contains(CAST(user_id AS VARCHAR), '42') UNION ALL"
        " SELECT event_id, 'wild' FROM events WHERE event_type = 'view' UNION ALL"
        " SELECT event_id, 'columns' FROM events WHERE event_type = 'signup'"
        " OR contains(json_extract_string(props, '$.k'), '77')"
        " OR contains(CAST(event_id AS VARCHAR), '77') OR contains(CAST(user_id AS VARCHAR), '77')",
    ),
    "prd_wildcard": (
        _on("pages", "page_id", {"s": {"url": "https://*.example.net/?r*"}, "condition": "s"}),
        "SELECT page_id FROM pages WHERE url ILIKE 'https://%.example.net/_r%'",
    ),
    "prd_startswith": (
        _on("pages", "page_id", {"s": {"url|startswith": "HTTPS://blog."}, "condition": "s"}),
        "SELECT page_id FROM pages WHERE starts_with(lower(url), 'https://blog.')",
    ),
    "prd_endswith": (
        _on("part", "p_partkey", {"s": {"p_name|endswith": ["Bolt", "ring"]}, "condition": "s"}),
        "SELECT p_partkey FROM part WHERE ends_with(p_name, 'bolt') OR ends_with(p_name, 'ring')",
    ),
    "prd_contains": (
        _on("documents", "doc_id", {"s": {"text|contains": "license"}, "condition": "s"}),
        "SELECT doc_id FROM documents WHERE contains(lower(text), 'license')",
    ),
    "prd_regex": (
        _on("pages", "page_id", {"s": {"url|re": r"^https?://(www|m)\.[a-z]+\.example\.(net|org)/"}, "condition": "s"}),
        r"SELECT page_id FROM pages WHERE regexp_matches(url, '^https?://(www|m)\.[a-z]+\.example\.(net|org)/')",
    ),
    "prd_regex_flags": (
        _on("part", "p_partkey", {"s": {"p_type|re|i": "^(small|promo)$"}, "condition": "s"}),
        "SELECT p_partkey FROM part WHERE p_type IN ('SMALL', 'PROMO')",
    ),
    "prd_cidr": (
        _events({"s": {"ip|cidr": ["10.16.0.0/12", "10.0.7.0/24"]}, "condition": "s"}, exprs={"ip": _IPV4}),
        "SELECT event_id FROM events WHERE floor(value / 2) <= 255 AND (user_id % 256 BETWEEN 16 AND 31"
        " OR (user_id % 256 = 0 AND event_id % 256 = 7))",
    ),
    "prd_cidr6": (
        _events({"s": {"ip|cidr": "2001:db8:8::/45"}, "condition": "s"}, exprs={"ip": _IPV6}),
        "SELECT event_id FROM events WHERE user_id % 16 >= 8",
    ),
    "prd_cased": (
        _events({"s": {"kind|cased": "ERROR"}, "condition": "s"},
                exprs={"kind": "if(event_id % 3 = 0, upper(event_type), event_type)"}),
        "SELECT event_id FROM events WHERE event_type = 'error' AND event_id % 3 = 0",
    ),
    "prd_exists": (
        _events({"a": {"doc.k|exists": True}, "b": {"doc.zz|exists": False}, "condition": "a and b"},
                fields=FieldMap(json_columns=("doc",)),
                exprs={"doc": "if(event_id % 4 = 0, '{\"k\": null, \"zz\": 1}', if(event_id % 4 = 1, '{\"k\": null}', props))"}),
        "SELECT event_id FROM events WHERE event_id % 4 <> 0",
    ),
    "prd_fieldref": (
        _events({"s": {"event_type|fieldref": "other"}, "condition": "s"},
                exprs={"other": "CASE event_id % 3 WHEN 0 THEN upper(event_type) WHEN 1 THEN 'none' END"}),
        "SELECT event_id FROM events WHERE event_id % 3 = 0",
    ),
    "prd_windash": (
        _events({"s": {"cmd|windash|contains": " -enc p"}, "condition": "s"}, exprs={"cmd": _CMD}),
        "SELECT event_id FROM events WHERE event_type = 'purchase' AND event_id % 5 <> 4",
    ),
    "prd_base64": (
        _events({"s": {"payload|base64|cased": "error"}, "condition": "s"}, exprs={"payload": "base64(event_type)"}),
        "SELECT event_id FROM events WHERE event_type = 'error'",
    ),
    "prd_base64offset": (
        _events({"s": {"payload|base64offset|contains|cased": "purchase"}, "condition": "s"},
                exprs={"payload": _SHIFTED}),
        "SELECT event_id FROM events WHERE event_type = 'purchase'",
    ),
    "prd_wide": (
        _events({"s": {"payload|wide|base64offset|contains|cased": "signup"}, "condition": "s"},
                exprs={"payload": _WIDE}),
        "SELECT event_id FROM events WHERE event_type = 'signup'",
    ),
    "prd_numeric_cmp": (
        _events({"s": {"value|gte": 10, "latency_ms|lt": 20}, "t": {"value|gt": 90}, "u": {"value|lte": 100},
                 "condition": "s or (t and u)"}),
        "SELECT event_id FROM events WHERE (value >= 10 AND value < 20) OR (value > 90 AND value <= 100)",
    ),
    "prd_all_modifier": (
        _on("documents", "doc_id", {"s": {"text|contains|all": ["license", "the"]}, "condition": "s"}),
        "SELECT doc_id FROM documents WHERE text ILIKE '%license%' AND text ILIKE '%the%'",
    ),
    "prd_null_match": (
        _events({"s": {"kind": None}, "condition": "s"}, exprs={"kind": "nullif(event_type, 'view')"}),
        "SELECT event_id FROM events WHERE event_type = 'view'",
    ),
    "prd_stringify": (
        _events({"s": {"user_id": "7"}, "t": {"flag": True}, "condition": "s and t"},
                exprs={"flag": "event_id % 2 = 0"}),
        "SELECT event_id FROM events WHERE user_id = 7 AND event_id % 2 = 0",
    ),
    "prd_expand": (_expand_in, "SELECT event_id FROM events WHERE user_id IN (3, 5, 8, 13)"),
    "prd_expand_join": (
        _expand_join,
        "SELECT event_id FROM events WHERE user_id IN (SELECT s_suppkey FROM supplier WHERE s_nationkey < 10)",
    ),
    "shp_logsource": (_logsource, "SELECT event_id FROM events WHERE event_type = 'error' AND event_id % 2 = 0"),
    "shp_profile": (
        _profile,
        "SELECT event_id FROM events WHERE event_type = 'purchase' AND value >= 20"
        " AND NOT starts_with(CAST(user_id AS VARCHAR), '1')",
    ),
}
