"""Leaves, conditions and null semantics, also against a small Python evaluator."""

from __future__ import annotations

import random
import re

import pytest
from pyspark.sql import functions as F

from watchglass.functions.fields import FieldMap
from watchglass.operators import matching
from watchglass.operators.joins import in_value_list
from watchglass.operators.rules import RuleError, ruleset_from_dicts

DOC = FieldMap(document="data", raw="raw")


def fired(make_events, events, *detections, **options):
    """For each detection, the positions of the events it matches."""
    specs = [{"title": f"t{i}", "id": f"t{i}", "detection": d} for i, d in enumerate(detections)]
    rules = ruleset_from_dicts(specs, **options).rules
    rows = matching.matches(make_events(events), rules, DOC, keep=["path"]).collect()
    out = [set() for _ in detections]
    for r in rows:
        out[int(r.rule_id[1:])].add(int(r.path))
    return out


def test_missing_null_and_not(make_events):
    events = [{"a": "x"}, {"a": None}, {}, {"a": ""}, {"a": "y"}]
    eq, neg, null, exists, absent, empty = fired(
        make_events, events,
        {"s": {"a": "X"}, "condition": "s"},
        {"s": {"a": "x"}, "condition": "not s"},
        {"s": {"a": None}, "condition": "s"},
        {"s": {"a|exists": True}, "condition": "s"},
        {"s": {"a|exists": False}, "condition": "s"},
        {"s": {"a": ""}, "condition": "s"},
    )
    assert eq == {0} and neg == {1, 2, 3, 4} and null == {1, 2}
    assert exists == {0, 1, 3, 4} and absent == {2} and empty == {3}


def test_not_over_nested_groups(make_events):
    events = [{"a": 1}, {"b": 1}, {"a": 1, "b": 1}, {}]
    got = fired(
        make_events, events,
        {"x": {"a": 1}, "y": {"b": 1}, "condition": "not (x or y)"},
        {"x": {"a": 1}, "y": {"b": 1}, "condition": "not x and y or x and not y"},
        {"x": {"a": 1}, "y": {"b": 1}, "condition": "not (x and y)"},
    )
    assert got == [{3}, {0, 1}, {0, 1, 3}]


def test_wildcards_and_escapes(make_events):
    events = [{"p": r"C:\dir\cmd.exe"}, {"p": "a*b"}, {"p": "axb"}, {"p": "100%_!"}, {"p": "it's \\ ok"}]
    got = fired(
        make_events, events,
        {"s": {"p": r"*\cmd.exe"}, "condition": "s"},
        {"s": {"p": r"a\*b"}, "condition": "s"},
        {"s": {"p": "a?b"}, "condition": "s"},
        {"s": {"p": "*%_!"}, "condition": "s"},
        {"s": {"p|contains": "it's \\ o"}, "condition": "s"},
        {"s": {"p|endswith": r"\cmd.exe"}, "condition": "s"},
        {"s": {"p|startswith": r"c:\dir"}, "condition": "s"},
        {"s": {"p|contains": "?!"}, "condition": "s"},
    )
    assert got == [{0}, {1}, {1, 2}, {3}, {4}, {0}, {0}, {3}]


def test_numbers_booleans_and_nested(make_events):
    events = [{"n": 5, "ok": True, "a": {"b": "v"}}, {"n": "5", "ok": "true", "a.b": "v"},
              {"n": 5.5, "ok": False}, {"n": "many"}, {"n": [1, 2], "a": {"b": {"c": 1}}}]
    got = fired(
        make_events, events,
        {"s": {"n": 5}, "condition": "s"},
        {"s": {"ok": "true"}, "condition": "s"},
        {"s": {"ok": True}, "condition": "s"},
        {"s": {"a.b": "v"}, "condition": "s"},
        {"s": {"n|gt": 5}, "condition": "s"},
        {"s": {"n|gte": 5, "n|lt": 5.5}, "condition": "s"},
        {"s": {"a.b.c": 1}, "condition": "s"},
    )
    assert got == [{0, 1}, {0, 1}, {0, 1}, {0, 1}, {2}, {0, 1}, {4}]


def test_cidr(make_events):
    ips = ["10.0.0.1", "10.255.0.9", "11.0.0.1", "10.0.0", "010.0.0.1", "10.0.0.256", "2001:db8::1",
           "2001:0DB8:0000::7", "2001:db9::1", "::ffff:10.0.0.1", "x:y"]
    v4, v6, both = fired(
        make_events, [{"ip": i} for i in ips] + [{}],
        {"s": {"ip|cidr": "10.0.0.0/8"}, "condition": "s"},
        {"s": {"ip|cidr": "2001:db8::/32"}, "condition": "s"},
        {"s": {"ip|cidr": ["11.0.0.0/24", "2001:db9::/64"]}, "condition": "s"},
    )
    assert v4 == {0, 1} and v6 == {6, 7} and both == {2, 8}


def test_windash_and_encodings(make_events):
    import base64

    wide = base64.b64encode("xx /all".encode("utf-16-le")).decode()
    events = [{"c": "ipconfig /all"}, {"c": "ipconfig -all"}, {"c": "ipconfig –all"}, {"c": "ipconfig all"},
              {"c": base64.b64encode(b"zz/all!").decode()}, {"c": wide}, {"c": base64.b64encode(b"/all").decode()}]
    got = fired(
        make_events, events,
        {"s": {"c|windash|contains": " -all"}, "condition": "s"},
        {"s": {"c|windash|endswith": "/all"}, "condition": "s"},
        {"s": {"c|base64offset|contains": "/all"}, "condition": "s"},
        {"s": {"c|wide|base64offset|contains": "/all"}, "condition": "s"},
        {"s": {"c|base64": "/all"}, "condition": "s"},
    )
    assert got == [{0, 1, 2}, {0, 1, 2}, {4, 6}, {5}, {6}]


def test_keywords(make_events):
    got = fired(
        make_events, [{"a": "one two"}, {"b": {"c": "TWO three"}}, {"d": 1}],
        {"kw": ["two"], "condition": "kw"},
        {"kw": {"|all": ["two", "three"]}, "condition": "kw"},
        {"kw": ["on*wo", "1"], "condition": "1 of kw"},
        {"kw": ["a", "b", '"c"', "d", ": 1"], "condition": "1 of kw"},
    )
    assert got == [{0, 1}, {1}, {0, 2}, set()]


def test_keywords_search_values_not_json_text(make_events):
    got = fired(
        make_events,
        [
            '{"cmd": "C:\\\\Windows\\\\x", "k": [1.5, true, null, {"deep": ["caf\\u00e9 \\"q\\": 7", ""]}]}',
            '{"one": "alpha", "two": "beta", "null": "x"}',
            '{"t": "a\\nb\\tc\\u0001d\\\\"}', '{}', '[]', '"café"', '7', 'null',
        ],
        *({"kw": [k], "condition": "kw"} for k in (
            "c:\\windows\\x", "CAFÉ", '"q": 7', "cmd", "deep", "1.5", "true", "null",
            "alpha*beta", "alp?a", "a\nb\tc", "\x01d\\", "one", "7", "*", "c*fé",
        )),
        {"kw": {"|cased": ["Caf", "Windows"]}, "condition": "kw"},
    )
    assert got == [
        {0}, {0, 5}, {0}, set(), set(), {0}, {0}, set(), set(), {1}, {2}, {2}, set(), {0, 6},
        {0, 1, 2, 3, 4, 5, 6, 7}, {0, 5}, {0},
    ]


def test_placeholders(spark, make_events):
    events = [{"user": "root", "a": "delete"}, {"user": "Admin", "a": "read"}, {"user": "nobody", "a": "delete"}]
    d = {"s": {"user|expand": "%admins%", "a": "delete"}, "condition": "s"}
    assert fired(make_events, events, d, placeholders={"admins": ["root", "admin"]}) == [{0}]
    with pytest.raises(RuleError, match="placeholder"):
        fired(make_events, events, d, placeholders={"other": []})
    with pytest.raises(RuleError, match="placeholder"):
        fired(make_events, events, d)
    table = spark.createDataFrame([("admins", "ROOT"), ("admins", "root"), ("x", "nobody")], "name string, value string")
    typed = make_events(events).selectExpr("path", "variant_get(data, '$.user', 'string') AS user")
    assert [r.path for r in in_value_list(typed, F.col("user"), table, "admins").collect()] == ["0"]


def test_logsource_is_opt_in(make_events):
    spec = {"title": "t", "logsource": {"product": "windows"}, "detection": {"s": {"a": 1}, "condition": "s"}}
    rules = ruleset_from_dicts([spec]).rules
    events = make_events([{"a": 1, "p": "Windows"}, {"a": 1, "p": "aws"}, {"a": 1}])
    assert matching.explode_hits(events, rules, DOC).count() == 3
    scoped = FieldMap(document="data", logsource={"product": "try_variant_get(data, '$.p', 'string')"})
    assert [r.path for r in matching.explode_hits(events, rules, scoped).collect()] == ["0"]


def test_names_and_values_are_quoted(make_events):
    names = ["a'b", 'c"d', "e f", "g\\h", "i`j", "k-l", "日本", "m%n", "$.o", ":p", "q?"]
    values = ["x'); --", 'y"', "back\\slash", "two\nlines", "`tick`", "{v}", ":param", "a%b_c!", "\\'"]
    events = [{n: v} for n in names for v in values]
    detections = [{"s": {n: v}, "condition": "s"} for n in names for v in values[:2]]
    got = fired(make_events, events, *detections)
    want = [{i for i, e in enumerate(events) if e == dict(d["s"].items())} for d in detections]
    assert got == want
    both = fired(make_events, events, *({"s": {"e f|contains": v}, "condition": "s"} for v in values))
    assert both == [{names.index("e f") * len(values) + i} for i in range(len(values))]


def test_typed_columns_of_every_shape(spark):
    df = spark.sql("""
      SELECT 1 AS id, named_struct('b', named_struct('c', 'Deep')) AS a, map('k.x', 'v') AS m,
             parse_json('{"p": {"q": 7}, "n": null}') AS doc, '{"z": {"y": true}, "z.w": 1}' AS txt,
             CAST(5 AS DECIMAL(9, 2)) AS amount, TRUE AS flag, CAST(NULL AS STRING) AS nothing
      UNION ALL SELECT 2, NULL, NULL, NULL, 'broken', NULL, NULL, NULL""")
    detections = [
        {"a.b.c": "deep"}, {"m.k.x": "V"}, {"doc.p.q": 7}, {"txt.z.y": True}, {"txt.z.w": 1}, {"amount": 5},
        {"amount|gte": 5.0}, {"flag": True}, {"doc.n": None, "doc.n|exists": True}, {"nothing|exists": False},
        {"unknown.field": None}, {"doc.p|exists": True}, {"a.b|exists": False},
    ]
    specs = [{"title": f"t{i:02d}", "id": f"t{i:02d}", "fields": [next(iter(d)).split("|")[0]],
              "detection": {"s": d, "condition": "s"}} for i, d in enumerate(detections)]
    rules = ruleset_from_dicts(specs).rules
    fields = FieldMap(json_columns=("txt",))
    rows = matching.matches(df, rules, fields, keep=["id"]).collect()
    assert sorted(r.rule_id for r in rows if r.id == 1) == [f"t{i:02d}" for i in range(12)]
    assert sorted(r.rule_id for r in rows if r.id == 2) == ["t09", "t10", "t12"]
    parts = {r.rule_id: r.matched_events[0] for r in matching.alerts(df, rules, fields).where("rule_id < 't05'").collect()}
    assert parts == {
        "t00": '{"a.b.c":"Deep"}', "t01": '{"m.k.x":"v"}', "t02": '{"doc.p.q":7}',
        "t03": '{"txt.z.y":true}', "t04": '{"txt.z.w":1}',
    }


def test_observed_counters(spark, make_events):
    from pyspark.sql import Observation

    specs = [{"title": x, "id": x, "detection": {"s": {"a": x}, "condition": "s"}} for x in ("one", "two")]
    rules = ruleset_from_dicts(specs).rules
    matched = matching.matches(make_events([{"a": "one"}, {"a": "one"}]), rules, DOC, keep=["path"])
    seen = Observation("rules")
    assert matching.observe_matches(matched, rules, seen).count() == 2
    assert seen.get == {"matches_one": 2, "matches_two": 0}


def test_bad_rules(spark, make_events):
    events = make_events([{}])
    for d in (
        {"s": {"a|nothing": 1}, "condition": "s"}, {"s": {"a": 1}, "condition": "s and t"},
        {"s": {"a": 1}, "condition": "1 of t*"}, {"s": {"a": 1}, "condition": "s | count() > 5"},
        {"s": {"a": []}, "condition": "s"},
    ):
        with pytest.raises(ValueError):
            matching.explode_hits(events, ruleset_from_dicts([{"title": "t", "detection": d}]).rules, DOC)
    bad = ruleset_from_dicts([{"title": "t", "detection": {"s": {"a|re": "(?P<x>"}, "condition": "s"}}]).rules
    with pytest.raises(RuleError, match="compile"):
        matching.check_patterns(events, bad)


def test_a_bad_pattern_costs_only_its_own_rule(spark, make_events):
    good = {"title": "good", "detection": {"s": {"a": "x"}, "condition": "s"}}
    bad = {"title": "bad", "detection": {"s": {"a|re": "(unclosed"}, "condition": "s"}}
    rules = ruleset_from_dicts([bad, good]).rules
    events = make_events([{"a": "x"}, {"a": "(unclosed"}])
    fired = matching.matches(events, rules, DOC, keep=["path"]).collect()
    assert [(r.path, r.rule_name) for r in fired] == [("0", "good")]
    letters = matching.rule_letters(spark, rules).collect()
    assert [(r.rule_id, r.reason) for r in letters] == [("bad", "predicate raised")]
    only = matching.matches(events, rules[:1], DOC, keep=["path"]).collect()
    assert only == []


@pytest.mark.parametrize("case", ["insensitive", "sensitive"])
def test_answers_do_not_depend_on_the_number_of_rules(make_events, case):
    tricky = [
        {"title": "same field twice", "detection": {
            "s": {"event": ["error", "view"], "event|cased": ["view", "click"]}, "condition": "s"}},
        {"title": "cased first", "detection": {
            "s": {"event|cased": ["View", "click"], "event": ["view", "error"]}, "condition": "s"}},
        {"title": "colliding names", "detection": {
            "Sel": {"event": "view"}, "sel": {"event": "nothing"}, "condition": "Sel"}},
        {"title": "both", "detection": {
            "a": {"event": ["view", "click"]}, "A": {"event|cased": "View"}, "condition": "a AND A"}},
        {"title": "negated", "detection": {
            "a": {"event": "view"}, "b": {"event|cased": "view"}, "condition": "a and not b"}},
    ]
    many = [
        {"title": f"filler {i}", "detection": {"s": {"event": ["view", f"e{i}"]}, "condition": "s"}} for i in range(55)
    ]
    events = make_events([{"event": e} for e in ("view", "View", "VIEW", "click", "Click", "error", "nothing", "e3")])

    def fired(specs):
        rules = ruleset_from_dicts(specs).rules
        rows = matching.matches(events, rules, DOC, keep=["path"], default_case=case).collect()
        return {(r.path, r.rule_title) for r in rows}

    together = fired(tricky + many)
    alone = set().union(*(fired([t]) for t in tricky), fired(many[3:4]))
    known = {t["title"] for t in tricky} | {"filler 3"}
    assert {x for x in together if x[1] in known} == alone and alone


def test_event_times_of_all_units_and_none(spark):
    from watchglass.operators.shaping import event_time

    rows = ["1704067200", "1704067200.25", "1704067200000", "1704067200000000", "1704067200000000000",
            "9" * 30, "-5", "1e40", "NaN", "soon", "", None, "2024-01-01T00:00:00Z"]
    df = spark.createDataFrame([(r,) for r in rows], "s string")
    got = [r[0] for r in df.select(event_time("s").cast("double").alias("t")).collect()]
    want = 1704067200.0
    assert got == [want, want + 0.25, want, want, want, None, -5.0, None, None, None, None, None, want]


def test_a_key_given_twice_is_a_document(make_events):
    events = make_events(['{"a": 1, "a": 2}', '{"a": 1, "b": {"c": 1, "c": 5}}'])
    rules = ruleset_from_dicts([
        {"title": "last", "detection": {"s": {"a": 2}, "condition": "s"}},
        {"title": "deep", "detection": {"s": {"b.c": 5}, "condition": "s"}},
    ]).rules
    fired = matching.matches(events, rules, DOC, keep=["path"]).collect()
    assert {(r.path, r.rule_name) for r in fired} == {("0", "last"), ("1", "deep")}
    assert matching.not_json_letters(events).count() == 0


@pytest.mark.parametrize("network", ["2001:db8::/32", "fe80::/10", "::/0", "::1/128", "2001:db8:0:8000::/49", "::ffff:0:0/96"])
def test_ipv6_networks(spark, network):
    import ipaddress

    from watchglass.functions.cidr import cidr_sql

    texts = ["2001:db8::1", "2001:DB8:0:0:0:0:0:1", "2001:db8:0:8000::", "2001:db9::", "fe80::1", "febf::", "fec0::",
             "::", "::1", "1::", "::ffff:1.2.3.4", "::ffff:0102:0304", "1.2.3.4", "1:2:3:4:5:6:7:8", "1:2:3:4:5:6:7",
             "1:2:3:4:5:6:7:8:9", "1::2::3", ":::", ":1::", "12345::", "g::", "", "::1.2.3.256", "1:2:3:4:5:6:1.2.3.4",
             "1:2:3:4:5:6:7::", "::2:3:4:5:6:7:8", "1:2:3:4::5:6:7:8", "::01.2.3.4", None]

    def inside(t):
        try:
            return ipaddress.ip_address(t) in ipaddress.ip_network(network)
        except ValueError:
            return False

    df = spark.createDataFrame([(t,) for t in texts], "t string").selectExpr("t", f"coalesce({cidr_sql('t', network)}, false) AS hit")
    assert {r.t: r.hit for r in df.collect()} == {t: inside(t) for t in texts}
    assert "Python" not in df._jdf.queryExecution().toString()


def test_python_rule_errors_are_isolated(spark):
    df = spark.createDataFrame([(1, "a"), (0, "b"), (4, "c")], "n int, name string")
    rule = matching.PythonRule("p", "P", lambda e: 4 / e["n"] > 3, ("n",))
    out = matching.with_python_rule(df, rule)
    assert [r.name for r in out.where("outcome.hit").collect()] == ["a"]
    letter = matching.predicate_letters(out, rule, F.col("name")).collect()
    assert [(r.event, r.rule_id, r.error) for r in letter] == [("b", "p", "ZeroDivisionError: division by zero")]
    assert "Traceback" in letter[0].trace


# -- random rules and events against plain Python ----------------------------

FIELDS = ["a", "b", "c.d"]
VALUES = ["x", "X", "xy", "yx", "y*", "?y", "", "1", 1, 2, True, None]


def _get(event, name):
    if name in event:
        return event[name], True
    here = event
    for p in name.split("."):
        if not isinstance(here, dict) or p not in here:
            return None, False
        here = here[p]
    return here, True


def _text(v):
    return ("true" if v else "false") if isinstance(v, bool) else str(v)


def _leaf(event, name, mods, value):
    got, present = _get(event, name)
    if value is None:
        return got is None
    if got is None:
        return False
    s, v = _text(got).lower(), _text(value).lower()
    if "gt" in mods:
        try:
            return float(s) > float(v)
        except ValueError:
            return False
    core = "".join(".*" if ch == "*" else "." if ch == "?" else re.escape(ch) for ch in v)
    if "startswith" in mods:
        core += ".*"
    if "endswith" in mods:
        core = ".*" + core
    if "contains" in mods:
        core = ".*" + core + ".*"
    return re.fullmatch(core, s, re.S) is not None


def _holds(event, detection):
    def item(key, values):
        name, *mods = key.split("|")
        values = values if isinstance(values, list) else [values]
        tests = [_leaf(event, name, mods, v) for v in values]
        return all(tests) if "all" in mods else any(tests)

    env = {n: all(item(k, v) for k, v in s.items()) for n, s in detection.items() if n != "condition"}
    return eval(detection["condition"], {}, env)


def test_random_rules_agree_with_python(make_events):
    rng = random.Random(7)
    events = []
    for _ in range(120):
        e = {}
        for f in ("a", "b"):
            if rng.random() < 0.8:
                e[f] = rng.choice(["x", "X", "xy", "yx", "yyx", "", 1, 2, 3, True, None, "2"])
        if rng.random() < 0.7:
            e["c"] = {"d": rng.choice(["x", "xy", None, 1])}
        events.append(e)
    detections = []
    for _ in range(60):
        d = {}
        for s in ("s1", "s2", "s3"):
            sel = {}
            for f in rng.sample(FIELDS, rng.choice([1, 1, 2])):
                mod = rng.choice(["", "", "|startswith", "|endswith", "|contains", "|gt", "|contains|all"])
                if mod == "|gt":
                    sel[f + mod] = rng.choice([0, 1, 2])
                else:
                    pool = [v for v in VALUES if v is not None or not mod]
                    sel[f + mod] = rng.sample(pool, 2) if rng.random() < 0.4 or "all" in mod else rng.choice(pool)
            d[s] = sel
        d["condition"] = rng.choice([
            "s1", "s1 and s2", "s1 or s2 and s3", "not s1", "s1 and not s2", "not (s1 or s2) and not s3",
            "(s1 or s2) and s3", "not s1 or not s2",
        ])
        detections.append(d)
    got = fired(make_events, events, *detections)
    for d, hits in zip(detections, got):
        assert hits == {i for i, e in enumerate(events) if _holds(e, d)}, d


def test_grouped_rules_equal_single_ones(make_events):
    """The CASE over a shared field must not change what matches."""
    rng = random.Random(3)
    kinds = ["login", "Logout", "read", "write"]
    events = [{"event": rng.choice([k, k.upper()]), "n": rng.randrange(9)} for k in kinds * 12] + [{"n": 3}, {}]
    detections = []
    for i in range(60):
        sel = {"event": rng.choice([rng.choice(kinds), rng.sample(kinds, 2)]), "n|gte": rng.randrange(9)}
        if i % 5 == 0:
            sel = {"event|cased": rng.choice(kinds)}
        detections.append({
            "s": sel, "t": {"n": rng.randrange(9)},
            "condition": rng.choice(["s", "s and not t", "s or t", "not s", "s and (t or not t)"]),
        })
    together = fired(make_events, events, *detections)
    few = [fired(make_events, events, d)[0] for d in detections[:6]]
    assert together[:6] == few

    def holds(e, d):
        def sel(s):
            for k, v in s.items():
                name, *mods = k.split("|")
                got = e.get(name)
                vs = v if isinstance(v, list) else [v]
                if "gte" in mods:
                    ok = got is not None and got >= v
                elif "cased" in mods:
                    ok = got in vs
                else:
                    ok = got is not None and str(got).lower() in [str(x).lower() for x in vs]
                if not ok:
                    return False
            return True

        return eval(d["condition"], {}, {"s": sel(d["s"]), "t": sel(d["t"])})

    for d, hits in zip(detections, together):
        assert hits == {i for i, e in enumerate(events) if holds(e, d)}, d


def test_leaf_texts_split_a_document_once(spark):
    from watchglass.functions.fields import SEPARATOR, leaf_texts

    sql = leaf_texts("j")
    assert sql.count("split(replace(") == 1
    rows = [('{"a":"x \\"q\\" y","b":{"c":[1,true,null,"z\\n"]}}',), ("7",), ('""',), (None,)]
    got = [r.t for r in spark.createDataFrame(rows, "j string").selectExpr(f"{sql} AS t").collect()]
    assert got == [SEPARATOR.join(['x "q" y', "z\n", "1", "true"]), "7", "", None]
