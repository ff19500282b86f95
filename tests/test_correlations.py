"""Windowed correlations on small fixtures, against brute force, and with hot keys."""

from __future__ import annotations

import math
import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from watchglass.functions.fields import FieldMap
from watchglass.operators import correlate as c
from watchglass.operators.rules import ruleset_from_dicts
from watchglass.operators.suppress import keep_spaced, suppress_alerts

DOC = FieldMap(document="data", raw="raw")
LOGIN = {"title": "failed login", "id": "login",
         "detection": {"s": {"event": "login", "status": "failed"}, "condition": "s"}}
KINDS = [{"title": f"k{k}", "id": f"k{k}", "detection": {"s": {"k": k}, "condition": "s"}} for k in "abcd"]


def corr(kind="event_count", refs=("login",), by=("user",), span="1m", condition=None, **more):
    spec = {"title": "c", "id": "c", "type": kind, "rules": list(refs), "group-by": list(by), "timespan": span, **more}
    if condition:
        spec["condition"] = condition
    return spec


def login(user, ts, **more):
    return {"event": "login", "status": "failed", "user": user, "timestamp": ts, **more}


def run(make_events, events, *specs, **options):
    out = c.correlate(make_events(events), ruleset_from_dicts([LOGIN, *KINDS, *specs]), DOC, **options)
    return sorted(
        (r.rule_id, r.correlation_key, int(r.window_start.timestamp()), int(r.window_end.timestamp()))
        for r in out.collect()
    )


def test_count_in_and_across_windows(make_events):
    rule = corr(condition={"gte": 3})
    assert run(make_events, [login("ann", t) for t in (10, 20, 30)], rule) == [("c", "ann", 0, 60)]
    assert run(make_events, [login("ann", t) for t in (10, 20, 70)], rule) == []
    # An event on the edge belongs to the window that starts there.
    assert run(make_events, [login("ann", t) for t in (60, 70, 119.9)], rule) == [("c", "ann", 60, 120)]
    assert run(make_events, [login("ann", t) for t in (0, 10, 60)], rule) == []


def test_events_before_1970_and_iso_times(make_events):
    rule = corr(condition={"gte": 2})
    assert run(make_events, [login("a", -1), login("a", -59.5)], rule) == [("c", "a", -60, 0)]
    iso = [login("a", "1970-01-01T00:01:05Z"), login("a", "1970-01-01T02:01:10+02:00"), login("a", "no time")]
    assert run(make_events, iso, rule) == [("c", "a", 60, 120)]


def test_alert_row(make_events):
    rs = ruleset_from_dicts([LOGIN, corr(condition={"gte": 1}, level="high", tags=["attack.t1110"])])
    row = c.correlate(make_events([login("a", 5)]), rs, DOC).collect()[0]
    assert row.matched_events == [] and row.tags == ["attack.t1110"] and row.severity == "high"
    assert row.fired_at == row.window_end


def test_event_counts_once_for_several_references(make_events):
    other = {"title": "any login", "id": "any", "detection": {"s": {"event": "login"}, "condition": "s"}}
    rule = corr(refs=["login", "any"], condition={"gte": 2})
    assert run(make_events, [login("a", 1)], other, rule) == []
    assert run(make_events, [login("a", 1), {"event": "login", "user": "a", "timestamp": 2}], other, rule) == [("c", "a", 0, 60)]


def test_keys_do_not_collide_and_missing_is_a_key(make_events):
    rule = corr(by=["user", "ip"], condition={"gte": 2})
    events = [login("a|b", 1, ip="c"), login("a", 2, ip="b|c"), login(None, 3), login(None, 4, ip=None)]
    events.append({"event": "login", "status": "failed", "timestamp": 5})
    assert run(make_events, events, rule) == [("c", "MISSING|MISSING", 0, 60)]
    assert run(make_events, events, rule, drop_missing_keys=True) == []


def test_no_group_by(make_events):
    rule = {**corr(condition={"gte": 2})}
    del rule["group-by"]
    assert run(make_events, [login("a", 1), login("b", 2)], rule) == [("c", "", 0, 60)]


def test_value_count_ignores_missing_values(make_events):
    rule = corr("value_count", condition={"gte": 2, "field": "ip"})
    events = [login("a", 1, ip="x"), login("a", 2, ip="x"), login("a", 3), login("b", 4, ip="x"), login("b", 5, ip="y")]
    assert run(make_events, events, rule) == [("c", "b", 0, 60)]


def k(kind, ts, user="u"):
    return {"k": kind, "timestamp": ts, "user": user}


def test_temporal(make_events):
    rule = corr("temporal", ["ka", "kb"])
    assert run(make_events, [k("b", 15), k("a", 20)], rule) == [("c", "u", 0, 60)]
    assert run(make_events, [k("a", 5), k("b", 65)], rule) == []
    assert run(make_events, [k("a", 5), k("a", 6)], rule) == []


def test_temporal_counts_every_reference_of_one_event(make_events):
    both = {"title": "both", "id": "both", "detection": {"s": {"k": ["a", "b"]}, "condition": "s"}}
    assert run(make_events, [k("a", 1)], both, corr("temporal", ["ka", "both"])) == [("c", "u", 0, 60)]
    # In an ordered rule the first matching reference wins.
    assert run(make_events, [k("a", 1)], both, corr("temporal_ordered", ["ka", "both"])) == []
    assert run(make_events, [k("a", 1), k("b", 2)], both, corr("temporal_ordered", ["ka", "both"])) == [("c", "u", 0, 60)]


def test_temporal_with_more_rules_than_mask_bits(make_events):
    many = [{"title": f"n{i}", "id": f"n{i}", "detection": {"s": {"n": i}, "condition": "s"}} for i in range(70)]
    rule = corr("temporal", [r["id"] for r in many])
    events = [{"n": i, "user": "u", "timestamp": 1 + i / 10} for i in range(70)]
    assert run(make_events, events, *many, rule) == [("c", "u", 0, 60)]
    assert run(make_events, events[:-1], *many, rule) == []


@pytest.mark.parametrize("order,times,fires", [
    ("abc", (1, 2, 3), True), ("acb", (1, 2, 3), False), ("cba", (1, 1, 1), True),
    ("aabbc", (1, 2, 3, 4, 5), True), ("bcab", (1, 2, 3, 4), False), ("cabca", (1, 2, 3, 4, 5), True),
])
def test_ordered_three(make_events, order, times, fires):
    events = [k(x, t) for x, t in zip(order, times)]
    assert bool(run(make_events, events, corr("temporal_ordered", ["ka", "kb", "kc"]))) is fires


def _is_subsequence(steps, length):
    at = 0
    for _, o in sorted(steps):
        if o == at:
            at += 1
    return at == length


@pytest.mark.parametrize("length", [2, 3, 4, 5, 6])
def test_ordered_against_brute_force(spark, length):
    rng = random.Random(length)
    names = "abcdef"[:length]
    rows = []
    for user in range(80):
        for _ in range(rng.randrange(length, 25 * length)):
            rows.append((f"u{user}", rng.choice(names), rng.randrange(40)))
    df = spark.createDataFrame(rows, "user string, k string, s long").withColumn("event_time", F.timestamp_seconds("s"))
    rules = [{"title": f"k{x}", "id": f"k{x}", "detection": {"s": {"k": x}, "condition": "s"}} for x in names]
    rule = corr("temporal_ordered", [f"k{x}" for x in names], span="20s")
    got = {(r.correlation_key, int(r.window_start.timestamp()))
           for r in c.correlate(df, ruleset_from_dicts([*rules, rule])).collect()}
    groups = defaultdict(list)
    for user, x, s in rows:
        groups[(user, s // 20 * 20)].append((s, names.index(x)))
    want = {g for g, steps in groups.items() if _is_subsequence(steps, length)}
    assert got == want and want


def _percentile(values, p):
    values = sorted(values)
    at = p / 100 * (len(values) - 1)
    lo, hi = math.floor(at), math.ceil(at)
    return values[lo] if lo == hi else values[lo] * (hi - at) + values[hi] * (at - lo)


def test_percentile_fixture(make_events):
    def lat(ms, ts):
        return {"event": "login", "status": "failed", "user": "svc", "ms": ms, "timestamp": ts}

    rule = corr(condition={"gte": 500}, x={"percentile": 95.0, "percentile_field": "ms"})
    spike = [lat(100, 1000 + i) for i in range(95)] + [lat(1000, 1095 + i) for i in range(5)]
    assert run(make_events, spike, rule) == [("c", "svc", 1080, 1140)]
    assert run(make_events, [lat(100, 1000 + i) for i in range(100)], rule) == []
    nulls = [lat(1000, 1000), lat(None, 1001), lat(1000, 1002), lat("slow", 1003)]
    assert run(make_events, nulls, rule) == [("c", "svc", 960, 1020)]


@pytest.mark.parametrize("p", [0, 10, 50, 95, 99.5, 100])
@pytest.mark.parametrize("op,test", [
    ("gte", lambda v, t: v >= t), ("gt", lambda v, t: v > t), ("lte", lambda v, t: v <= t),
    ("lt", lambda v, t: v < t), ("eq", lambda v, t: v == t),
])
def test_percentile_against_brute_force(spark, p, op, test):
    rng = random.Random(int(p * 10) + len(op))
    rows = [(f"u{u}", float(rng.randrange(10))) for u in range(60) for _ in range(rng.randrange(1, 12))]
    df = spark.createDataFrame(rows, "user string, ms double").withColumn("event_time", F.timestamp_seconds(F.lit(1)))
    any_rule = {"title": "any", "id": "any", "detection": {"s": {"user|exists": True}, "condition": "s"}}
    rule = corr(refs=["any"], condition={op: 5}, x={"percentile": p, "percentile_field": "ms"})
    got = {r.correlation_key for r in c.correlate(df, ruleset_from_dicts([any_rule, rule])).collect()}
    groups = defaultdict(list)
    for u, v in rows:
        groups[u].append(v)
    assert got == {u for u, vs in groups.items() if test(_percentile(vs, p), 5)}


def test_nested(make_events):
    events = [login("x", 1000 + j, src_ip=f"10.0.0.{i}") for i in range(3) for j in range(5)]
    inner = {**corr(by=["src_ip"], span="5m", condition={"gte": 2}), "id": "inner", "title": "inner"}
    by_key = {**corr(refs=["inner"], by=["correlation_key"], span="15m", condition={"gte": 2}), "id": "o1", "title": "o1"}
    by_rule = {**by_key, "group-by": ["rule_id"], "id": "o2", "title": "o2"}
    third = {**corr(refs=["o2"], by=["rule_id"], span="1h", condition={"gte": 1}), "id": "o3", "title": "o3"}
    got = run(make_events, events, inner, by_key, by_rule, third)
    assert got == [
        ("inner", "10.0.0.0", 900, 1200), ("inner", "10.0.0.1", 900, 1200), ("inner", "10.0.0.2", 900, 1200),
        ("o2", "inner", 900, 1800), ("o3", "o2", 0, 3600),
    ]


def test_suppression_gap_of_exactly_the_window_is_kept(spark):
    times = [0, 30, 60, 90, 119, 120, 300]
    df = spark.createDataFrame(
        [("r", key, t) for key in ("a", None) for t in times], "rule_id string, correlation_key string, s long"
    ).select("rule_id", "correlation_key", F.timestamp_seconds("s").alias("fired_at"),
             F.timestamp_seconds("s").alias("window_end"))
    kept = suppress_alerts(df, 60).collect()
    # A missing key cannot be joined on equality: both keys must survive alike.
    by_key = defaultdict(list)
    for r in kept:
        by_key[r.correlation_key].append(int(r.fired_at.timestamp()))
    assert {x: sorted(v) for x, v in by_key.items()} == {"a": [0, 60, 120, 300], None: [0, 60, 120, 300]}


@pytest.mark.parametrize("batch", ["10000", "7"])
def test_suppression_against_brute_force(spark, batch):
    usual = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
    rng = random.Random(1)
    rows = [(f"k{rng.randrange(5)}", rng.randrange(1500), i) for i in range(1000)]
    df = spark.createDataFrame(rows, "key string, s long, i long").withColumn("t", F.timestamp_seconds("s"))
    got = {(r.key, r.s, r.i) for r in keep_spaced(df, ["key"], "t", 97, order=["i"]).collect()}
    want = set()
    for key in {r[0] for r in rows}:
        last = None
        for s, i in sorted((s, i) for x, s, i in rows if x == key):
            if last is None or s >= last + 97:
                want.add((key, s, i))
                last = s
    assert got == want
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", usual)


def test_suppression_with_outliers_dense_seconds_and_no_time(spark):
    dense = spark.range(200_000).selectExpr("'dense' AS key", "timestamp_seconds(id) AS t")
    odd = spark.sql(
        "SELECT 'odd' AS key, t FROM VALUES (timestamp_seconds(0)), (timestamp_seconds(630720000)),"
        " (timestamp_seconds(630720030)), (CAST(NULL AS TIMESTAMP)), (CAST(NULL AS TIMESTAMP)) AS v(t)"
    )
    df = dense.union(odd)
    for span, want in ((1, 200_000), (300, 667)):
        kept = keep_spaced(df, ["key"], "t", span).groupBy("key", F.col("t").isNull().alias("none")).count().collect()
        assert {(r.key, r.none): r["count"] for r in kept} == {
            ("dense", False): want, ("odd", False): 3 if span == 1 else 2, ("odd", True): 2,
        }


def test_only_annotated_rules_are_suppressed(make_events):
    events = [login("a", t) for t in range(0, 600, 10)]
    free = {**corr(condition={"gte": 2}), "id": "free", "title": "free"}
    held = {**free, "id": "held", "title": "held", "x": {"suppress_window_seconds": 180}}
    got = run(make_events, events, free, held)
    assert len([g for g in got if g[0] == "free"]) == 10
    assert [g[3] for g in got if g[0] == "held"] == [60, 240, 420, 600]
    assert len(run(make_events, events, free, held, suppressed=False)) == 20


def test_hot_key_holds_a_third_of_all_rows(spark):
    """One key with a third of the rows gives exact results and is split up."""
    n = 60_000
    df = spark.range(n, numPartitions=8).selectExpr(
        "id", "if(id % 3 = 0, 'hot', CAST(id % 997 AS STRING)) AS user",
        "element_at(array('a', 'b', 'c'), CAST(pmod(xxhash64(id), 3) + 1 AS INT)) AS k",
        "CAST(pmod(xxhash64(id, 1), 5000) AS STRING) AS ip", "CAST(pmod(xxhash64(id, 2), 1000) AS DOUBLE) AS ms",
        "timestamp_seconds(pmod(xxhash64(id, 3), 3600)) AS event_time",
    ).cache()
    names = [{"title": f"k{x}", "id": f"k{x}", "detection": {"s": {"k": x}, "condition": "s"}} for x in "abc"]
    specs = [
        {**corr(refs=["ka"], span="1h", condition={"gte": 100}), "id": "n", "title": "n"},
        {**corr("value_count", ["ka", "kb"], span="1h", condition={"gte": 40, "field": "ip"}), "id": "v", "title": "v"},
        {**corr("temporal_ordered", ["ka", "kb", "kc"], span="10m"), "id": "o", "title": "o"},
        {**corr(refs=["ka"], span="1h", condition={"gte": 500}, x={"percentile": 50, "percentile_field": "ms"}),
         "id": "p", "title": "p"},
    ]
    got = defaultdict(set)
    for r in c.correlate(df, ruleset_from_dicts([*names, *specs])).collect():
        got[r.rule_id].add((r.correlation_key, int(r.window_start.timestamp())))
    rows = df.collect()
    groups = defaultdict(list)
    for r in rows:
        groups[r.user].append(r)
    want = defaultdict(set)
    for user, rs in groups.items():
        a = [r for r in rs if r.k == "a"]
        if len(a) >= 100:
            want["n"].add((user, 0))
        if len({r.ip for r in rs if r.k in "ab"}) >= 40:
            want["v"].add((user, 0))
        if a and _percentile([r.ms for r in a], 50) >= 500:
            want["p"].add((user, 0))
        per = defaultdict(list)
        for r in rs:
            s = int(r.event_time.timestamp())
            per[s // 600 * 600].append((s, "abc".index(r.k)))
        want["o"] |= {(user, w) for w, steps in per.items() if _is_subsequence(steps, 3)}
    assert got == want
    df.unpersist()


@pytest.mark.parametrize("rows_per_task,max_hot", [(10**6, 10), (1000, 10), (1000, 1), (20, 10_000)])
def test_weighted_join_is_exact(spark, rows_per_task, max_hot):
    from watchglass.plans.skew import weighted_join

    big = spark.range(9000).selectExpr("id", "if(id % 3 = 0, -1, if(id % 3 = 1, -2, id % 50)) AS k")
    small = big.groupBy("k").agg(F.count("*").alias("n")).where("k <> 7").cache()
    out = weighted_join(big, small, ["k"], ["id"], "n", rows_per_task=rows_per_task, max_hot=max_hot)
    assert sorted(map(tuple, out.select("id", "k").collect())) == sorted(
        map(tuple, big.where("k <> 7").select("id", "k").collect()))


@pytest.mark.parametrize("length", [3, 5])
def test_ordered_with_heavy_groups(spark, monkeypatch, length):
    from watchglass.plans import skew

    plain, salted = [], []
    for found, rows in ((plain, 10**6), (salted, 5)):
        monkeypatch.setattr(skew.weighted_join, "__kwdefaults__", {"reduce": lambda df: df, "rows_per_task": rows, "max_hot": 10_000})
        names = "abcde"[:length]
        df = spark.range(4000).selectExpr(
            "if(id % 3 = 0, 'hot', CAST(id % 61 AS STRING)) AS user",
            f"element_at(split('{','.join(names)}', ','), CAST(pmod(xxhash64(id), {length}) + 1 AS INT)) AS k",
            "timestamp_seconds(pmod(xxhash64(id, 3), 500)) AS event_time",
        )
        rules = [{"title": f"k{x}", "id": f"k{x}", "detection": {"s": {"k": x}, "condition": "s"}} for x in names]
        rule = corr("temporal_ordered", [f"k{x}" for x in names], span="200s")
        found += sorted(map(tuple, c.correlate(df, ruleset_from_dicts([*rules, rule]))
                            .select("correlation_key", "window_start").collect()))
    assert plain == salted and plain


def test_count_plan_has_partial_aggregation_and_one_scan(spark):
    from conftest import TESTDATA

    df = spark.read.parquet(f"{TESTDATA}/events.parquet").withColumn("event_time", F.col("ts").cast("timestamp"))
    rules = [{"title": x, "id": x, "detection": {"s": {"event_type": x}, "condition": "s"}} for x in ("error", "view")]
    specs = [
        {**corr(refs=["error"], by=["user_id"], span="1d", condition={"gte": 2}), "id": "a", "title": "a"},
        {**corr("temporal", ["error", "view"], by=["user_id"], span="7d"), "id": "b", "title": "b"},
    ]
    plan = c.correlate(df, ruleset_from_dicts([*rules, *specs]))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") == 1 and plan.count("Exchange hashpartitioning") == 1
    assert "partial_count" in plan and "props" not in plan
    assert "SortMergeJoin" not in plan and "CartesianProduct" not in plan
    single = c.correlate(df, ruleset_from_dicts([*rules, specs[0]]))._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in single
