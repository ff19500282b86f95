"""Rule and correlation specifications."""

from __future__ import annotations

import pytest

from watchglass.operators.rules import (
    Bounds, Correlation, Rule, RuleError, Ruleset, UnknownKind, load_rules, ruleset_from_dicts,
    sysmon_profiles, timespan_seconds, windows_profiles, falcon_profiles,
)

BASE = {"title": "base", "id": "base", "detection": {"s": {"event": "x"}, "condition": "s"}}


def corr(**spec):
    return {"title": "c", "id": "c", "type": "event_count", "rules": ["base"], "group-by": ["u"],
            "timespan": "5m", "condition": {"gte": 3}, **spec}


def test_both_correlation_shapes_are_equal():
    flat = Correlation.from_dict(corr())
    inner = {k: v for k, v in corr().items() if k not in ("title", "id")}
    assert Correlation.from_dict({"title": "c", "id": "c", "correlation": inner}) == flat


def test_annotations_under_any_block_name():
    c = Correlation.from_dict(corr(engine={
        "suppress_window_seconds": 3600, "threshold_range": [3, 5],
        "allow_high_cardinality": True, "allowed_lateness_seconds": 600,
    }))
    assert (c.suppress_seconds, c.lateness_seconds, c.allow_high_cardinality) == (3600, 600, True)
    assert (c.bounds.lo, c.bounds.hi) == (3, 5)


def test_percentile_annotation_and_type():
    by_note = Correlation.from_dict(corr(x={"percentile": 95.0, "percentile_field": "ms"}))
    by_type = Correlation.from_dict(corr(type="percentile", condition={"gte": 3, "field": "ms", "percentile": 95}))
    assert by_note.kind == by_type.kind == "percentile"
    assert (by_note.value_field, by_note.percentile) == ("ms", 95.0) == (by_type.value_field, by_type.percentile)
    with pytest.raises(RuleError):
        Correlation.from_dict(corr(type="percentile"))


@pytest.mark.parametrize("text,seconds", [("30s", 30), ("5m", 300), ("2h", 7200), ("1d", 86400)])
def test_timespan(text, seconds):
    assert timespan_seconds(text) == seconds


@pytest.mark.parametrize("text", ["", "5", "5x", "m5", "0m", None])
def test_bad_timespan(text):
    with pytest.raises(RuleError):
        timespan_seconds(text)


def test_errors():
    with pytest.raises(UnknownKind):
        Correlation.from_dict(corr(type="nothing"))
    with pytest.raises(RuleError, match="operator"):
        Correlation.from_dict(corr(condition={"about": 3}))
    with pytest.raises(RuleError, match="unknown rules"):
        ruleset_from_dicts([corr()])
    with pytest.raises(RuleError, match="level"):
        Rule.from_dict({**BASE, "level": "loud"})
    with pytest.raises(RuleError, match="twice"):
        ruleset_from_dicts([BASE, BASE])
    with pytest.raises(RuleError, match="mixes"):
        ruleset_from_dicts([BASE, corr(), corr(id="d", title="d", rules=["base", "c"])])
    with pytest.raises(RuleError, match="alerts only have"):
        ruleset_from_dicts([BASE, corr(), corr(id="d", title="d", rules=["c"], **{"group-by": ["src_ip"]})])


def test_cycle():
    a, b = corr(id="a", title="a", rules=["b"]), corr(id="b", title="b", rules=["a"])
    a["group-by"] = b["group-by"] = ["rule_id"]
    with pytest.raises(RuleError, match="Cycle"):
        ruleset_from_dicts([a, b])


def test_lenient_drops_unknown_references():
    assert ruleset_from_dicts([corr()], strict=False).correlations == ()
    kept = ruleset_from_dicts([BASE, corr(rules=["base", "gone"])], strict=False).correlations
    assert kept[0].refs == ("base",)


def test_levels():
    specs = [BASE, corr(id="l3", title="l3", rules=["l2"]), corr(id="l1", title="l1"),
             corr(id="l2", title="l2", rules=["l1"])]
    for s in specs[1:]:
        if s["id"] != "l1":
            s["group-by"] = ["correlation_key"]
    levels = ruleset_from_dicts(specs).levels
    assert [[c.id for c in level] for level in levels] == [["l1"], ["l2"], ["l3"]]


def test_references_by_name():
    rs = ruleset_from_dicts([{**BASE, "title": "Failed Login", "id": "u-1"}, corr(rules=["failed_login"])])
    assert rs.correlations[0].refs == ("u-1",)


@pytest.mark.parametrize("condition,sql", [
    ({"gte": 3}, "(n >= 3.0D)"), ({"gt": 3}, "(n > 3.0D)"), ({"lt": 3}, "(n < 3.0D)"),
    ({"eq": 3}, "(n >= 3.0D AND n <= 3.0D)"), ({"gte": 2, "lt": 5}, "(n >= 2.0D AND n < 5.0D)"),
])
def test_bounds(condition, sql):
    assert Bounds.of(condition, None, "t").sql("n") == sql


def test_load_rules_reads_nested_folders(tmp_path):
    (tmp_path / "deep").mkdir()
    (tmp_path / "a.yml").write_text(
        "title: one\nid: one\ndetection:\n  s:\n    event: x\n  condition: s\n---\n"
        "title: many\nid: many\ncorrelation:\n  type: event_count\n  rules: [one]\n"
        "  group-by: [user]\n  timespan: 1m\n  condition: {gte: 5}\n"
    )
    (tmp_path / "deep" / "b.yaml").write_text("title: two\ndetection:\n  s:\n    event: y\n  condition: s\n")
    (tmp_path / "notes.txt").write_text("ignored")
    rs = load_rules(str(tmp_path))
    assert {r.id for r in rs.rules} == {"one", "two"} and rs.correlations[0].window_seconds == 60


def test_profiles_add_conditions_and_rename():
    rule = {"title": "p", "logsource": {"product": "windows", "category": "process_creation"},
            "detection": {"s": {"Image|endswith": "\\cmd.exe"}, "condition": "all of them"}}
    sysmon = ruleset_from_dicts([rule], profiles=sysmon_profiles()).rules[0]
    assert {"EventID": 1} in sysmon.selections.values()
    assert sysmon.condition.endswith("and ((s))")
    falcon = ruleset_from_dicts([rule], profiles=falcon_profiles()).rules[0]
    assert falcon.selections["s"] == {"ImageFileName|endswith": "\\cmd.exe"}
    untouched = ruleset_from_dicts([rule], profiles=windows_profiles()).rules[0]
    assert untouched == Rule.from_dict(rule)


def test_ruleset_of_nothing():
    assert Ruleset.of().levels == ()
