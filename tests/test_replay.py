"""Files of payloads through a ruleset, with the expected firings."""

from __future__ import annotations

import json

import pytest

from watchglass.functions.fields import FieldMap
from watchglass.operators import matching
from watchglass.operators.rules import ruleset_from_dicts
from watchglass.sources.events import file_events

RULES = [
    {"title": "door_forced", "level": "critical",
     "detection": {"alarm": {"kind": "door", "state|cased": "Forced"}, "condition": "alarm"}},
    {"title": "badge_after_hours", "level": "medium",
     "detection": {"swipe": {"kind": "badge", "hour|gte": 20}, "night": {"roster|contains": "night"},
                   "condition": "swipe and not night"}},
    {"title": "meter_off_scale", "level": "low",
     "detection": {"meter": {"kind": "meter", "unit": ["bar", "kelvin", "lux"]},
                   "high": {"reading|gt": 900}, "low": {"reading|lt": 0},
                   "condition": "meter and (high or low)"}},
    {"title": "camera_moved",
     "detection": {"view": {"camera.pose|re": "^tilt-[0-9]+$"}, "condition": "view"}},
    {"title": "courier_unlisted", "level": "high",
     "detection": {"visit": {"company|endswith": [" couriers", " freight"]}, "known": {"ticket|exists": True},
                   "condition": "visit and not known"}},
    {"title": "pump_note", "level": "low",
     "detection": {"words": ["cavitation", "dry run"], "condition": "words"}},
]

# path -> body, rules that fire; None: not a document
PAYLOADS = {
    "quiet/door.json": ({"kind": "door", "state": "Closed", "site": 4}, []),
    "quiet/case.json": ({"kind": "door", "state": "forced"}, []),
    "quiet/badge.json": ({"kind": "badge", "hour": 9, "roster": "day"}, []),
    "quiet/night.json": ({"kind": "badge", "hour": 23, "roster": "late-night"}, []),
    "quiet/meter.json": ({"kind": "meter", "unit": "bar", "reading": 12.5}, []),
    "quiet/unit.json": ({"kind": "meter", "unit": "volt", "reading": 9000}, []),
    "quiet/camera.json": ({"camera": {"pose": "tilt-x"}}, []),
    "quiet/visit.json": ({"company": "Blue Couriers", "ticket": "T-9"}, []),
    "one/door.json": ({"kind": "Door", "state": "Forced", "site": 7}, ["door_forced"]),
    "one/badge.json": ({"kind": "badge", "hour": 20, "roster": "day"}, ["badge_after_hours"]),
    "one/high.json": ({"kind": "meter", "unit": "LUX", "reading": 901}, ["meter_off_scale"]),
    "one/low.json": ({"kind": "meter", "unit": "kelvin", "reading": -0.5}, ["meter_off_scale"]),
    "one/camera.json": ({"camera": {"pose": "tilt-40"}}, ["camera_moved"]),
    "one/visit.json": ({"company": "Grey Freight"}, ["courier_unlisted"]),
    "one/words.json": ({"remark": "Pump ran DRY RUN twice"}, ["pump_note"]),
    "many/yard.json": ({"kind": "door", "state": "Forced", "company": "Grey Freight", "camera": {"pose": "tilt-1"}},
                       ["camera_moved", "courier_unlisted", "door_forced"]),
    "many/hall.json": ({"kind": "meter", "unit": "bar", "reading": 1000, "remark": "cavitation"},
                       ["meter_off_scale", "pump_note"]),
    "odd/torn.txt": ('{"kind": "door", ', None),
    "odd/empty.json": ({}, []),
    "odd/list.json": ([1, 2], []),
    "odd/null.json": ({"kind": "badge", "hour": None}, []),
    "odd/missing.json": ({"kind": "badge", "hour": 22}, ["badge_after_hours"]),
    "odd/signs.json": ({"kind": "door", "state": "Forced", "site": "Ωμέγα ✈ 門"}, ["door_forced"]),
}


# What fires instead where case counts.
SENSITIVE = {
    "one/door.json": [], "one/high.json": [], "one/visit.json": [], "one/words.json": [],
    "many/yard.json": ["camera_moved", "door_forced"],
}


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    root = tmp_path_factory.mktemp("payloads")
    for rel, (body, _) in PAYLOADS.items():
        f = root / rel
        f.parent.mkdir(exist_ok=True)
        f.write_text((body if isinstance(body, str) else json.dumps(body, ensure_ascii=False)) + "\n", "utf-8")
    return root


@pytest.mark.parametrize("default_case", ["insensitive", "sensitive"])
def test_replay_matches_expectations(spark, folder, default_case):
    events = file_events(spark, str(folder), whole_files=True)
    changed = SENSITIVE if default_case == "sensitive" else {}
    expected = spark.createDataFrame(
        [((folder / rel).as_uri().replace("file:///", "file:/"), changed.get(rel, fired) or [], fired is None)
         for rel, (_, fired) in PAYLOADS.items()],
        "path string, matches array<string>, dropped boolean",
    )
    from pyspark.sql import functions as F

    events = events.withColumn("path", F.regexp_replace("path", "^file:/+", "file:/"))
    report = matching.replay_report(
        events, ruleset_from_dicts(RULES), expected, default_case=default_case
    ).collect()
    assert len(report) == len(PAYLOADS)
    assert [r for r in report if not r.ok] == []


def test_wrong_expectation_is_reported(spark, make_events):
    events = make_events([{"kind": "door", "state": "Forced"}, "nope"])
    expected = spark.createDataFrame(
        [("0", ["other"], False), ("2", [], False)], "path string, matches array<string>, dropped boolean"
    )
    rows = {r.path: r for r in matching.replay_report(events, ruleset_from_dicts(RULES), expected).collect()}
    assert {p: r.ok for p, r in rows.items()} == {"0": False, "1": False, "2": False}


def test_json_lines_and_bad_bytes(spark, tmp_path):
    (tmp_path / "a.jsonl").write_bytes(b'{"kind":"door","state":"Forced"}\nbroken\n{"kind":"x"}\n\xff\xfe{}\n')
    events = file_events(spark, str(tmp_path))
    letters = matching.not_json_letters(events).collect()
    assert len(letters) == 2 and {r.reason for r in letters} == {"non-JSON message"}
    rules = ruleset_from_dicts(RULES).rules
    fired = matching.matches(events, rules, FieldMap(document="data", raw="raw"), keep=[]).collect()
    assert [r.rule_name for r in fired] == ["door_forced"]


def test_alert_schema_and_projection(make_events):
    from watchglass.schema import ALERT_SCHEMA

    rule = {**RULES[0], "id": "r1", "fields": ["site", "a.b"], "tags": ["attack.t1200"]}
    events = make_events([{"kind": "door", "state": "Forced", "site": "u", "a": {"b": 3}, "z": 1}])
    out = matching.alerts(events, ruleset_from_dicts([rule]).rules, FieldMap(document="data", raw="raw"))
    assert [(f.name, f.dataType) for f in out.schema] == [(f.name, f.dataType) for f in ALERT_SCHEMA]
    row = out.collect()[0]
    assert (row.rule_id, row.severity, row.tags, row.window_start) == ("r1", "critical", ["attack.t1200"], None)
    assert json.loads(row.matched_events[0]) == {"site": "u", "a.b": 3}
