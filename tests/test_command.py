"""The small command for trying rules on files."""

from __future__ import annotations

import json

from watchglass import __main__ as command


def test_matches_and_coverage(spark, tmp_path, capsys):
    (tmp_path / "rules").mkdir()
    for name in ("login", "logout"):
        (tmp_path / "rules" / f"{name}.yml").write_text(
            f"title: {name}\nid: {name}\ndetection:\n  s:\n    event: {name}\n  condition: s\n"
        )
    (tmp_path / "events.jsonl").write_text('{"event": "Login"}\n{"event": "other"}\n')
    assert command.main(["matches", str(tmp_path / "rules"), str(tmp_path / "events.jsonl")]) == 0
    got = [json.loads(x) for x in capsys.readouterr().out.splitlines()]
    assert [g["rule_id"] for g in got] == ["login"]
    assert command.main(["coverage", str(tmp_path / "rules"), str(tmp_path / "events.jsonl")]) == 0
    got = {g["rule_id"]: g["matches"] for g in map(json.loads, capsys.readouterr().out.splitlines())}
    assert got == {"login": 1, "logout": 0}
    assert command.main(["nothing"]) == 2
