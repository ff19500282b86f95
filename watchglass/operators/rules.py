"""Rule and correlation specifications, read from YAML text or dicts.

This is driver-side configuration: small, checked once, and turned into
expressions over columns by the other modules.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field, replace
from graphlib import CycleError, TopologicalSorter
from pathlib import Path
from typing import Any, Iterable

from ..functions.fields import Binder
from ..schema import ALERT_KEY_FIELDS, DEFAULT_SEVERITY, SEVERITIES
from . import predicates

# Correlation kinds, and option names of a rule's annotation block.
KINDS = ("event_count", "value_count", "temporal", "temporal_ordered", "percentile")
_KIND_ALIASES = {
    "value_percentile": "percentile",
    "ordered_temporal": "temporal_ordered",
}
ANNOTATIONS = {
    "suppress_window_seconds", "threshold_range", "allow_high_cardinality",
    "allowed_lateness_seconds", "percentile", "percentile_field",
}
DEFAULT_LATENESS_SECONDS = 300
_UNIT_SECONDS = {"s": 1, "m": 60, "h": 3600, "d": 86400}
_INFINITY = float("inf")


class RuleError(ValueError):
    """A rule specification that cannot be used."""


class UnknownKind(RuleError):
    """A correlation type that does not exist."""


def slug(title: str) -> str:
    return re.sub(r"\W+", "_", title.strip().lower()).strip("_")


def timespan_seconds(text: Any) -> int:
    m = re.fullmatch(r"\s*(\d+)\s*([smhd])\s*", str(text))
    if not m or int(m.group(1)) == 0:
        raise RuleError(f"bad timespan {text!r}: use a number and s, m, h or d")
    return int(m.group(1)) * _UNIT_SECONDS[m.group(2)]


def _severity(spec: dict, who: str) -> str:
    level = str(spec.get("level") or DEFAULT_SEVERITY).lower()
    if level not in SEVERITIES:
        raise RuleError(f"{who}: unknown level {level!r}")
    return level


@dataclass(frozen=True)
class Rule:
    """A single-event rule."""

    id: str
    title: str
    severity: str
    selections: dict[str, Any]
    condition: str
    tags: tuple[str, ...] = ()
    fields: tuple[str, ...] = ()
    logsource: dict[str, str] = field(default_factory=dict)

    @property
    def name(self) -> str:
        return slug(self.title)

    @classmethod
    def from_dict(cls, spec: dict) -> "Rule":
        title = str(spec.get("title") or spec.get("name") or spec.get("id") or "")
        if not title:
            raise RuleError("rule without title and id")
        detection = dict(spec.get("detection") or {})
        condition = detection.pop("condition", None)
        detection.pop("timeframe", None)
        if not detection or not condition:
            raise RuleError(f"rule {title!r}: detection needs selections and a condition")
        if isinstance(condition, (list, tuple)):
            condition = " or ".join(f"({c})" for c in condition)
        return cls(
            id=str(spec.get("id") or slug(title)),
            title=title,
            severity=_severity(spec, f"rule {title!r}"),
            selections=detection,
            condition=str(condition),
            tags=tuple(str(t) for t in spec.get("tags") or ()),
            fields=tuple(str(f) for f in spec.get("fields") or ()),
            logsource={
                k: str(v) for k, v in (spec.get("logsource") or {}).items()
                if k in ("product", "service", "category") and v is not None
            },
        )


_QUANTIFIER = re.compile(r"\b(1|any|all)\s+of\s+([\w*?-]+)", re.IGNORECASE)
_WORD = re.compile(r"'[^']*'|[\w-]+")


def _of(rule: Rule, how: str, what: str) -> str:
    if what.lower() == "them":
        names = [n for n in rule.selections if not n.startswith("_")]
    else:
        shape = re.compile(re.escape(what).replace(r"\*", ".*").replace(r"\?", ".") + r"\Z")
        names = [n for n in rule.selections if shape.match(n)]
    if not names:
        raise RuleError(f"rule {rule.title!r}: no selection fits {what!r}")
    return "(" + (" and " if how.lower() == "all" else " or ").join(names) + ")"


def condition_sql(rule: Rule, selections: dict[str, str]) -> str:
    """The condition with each selection name replaced by its SQL.

    and / or / not and parentheses mean the same in Spark SQL, with the same
    precedence, so Spark's own expression parser reads the result. A selection
    on a missing field is NULL; where the condition says NOT, it becomes FALSE.
    """
    if "|" in rule.condition:
        raise RuleError(f"rule {rule.title!r}: aggregations in a condition are not supported")
    expanded = _QUANTIFIER.sub(lambda m: _of(rule, m.group(1), m.group(2)), rule.condition)
    if re.search(r"\bnot\b", expanded, re.IGNORECASE):
        selections = {n: predicates.total(s) for n, s in selections.items()}

    def put(m: re.Match) -> str:
        word = m.group(0)
        if word.lower() in ("and", "or", "not"):
            return word.upper()
        if word not in selections:
            raise RuleError(f"rule {rule.title!r}: unknown selection {word!r} in condition")
        return selections[word]

    return "(" + _WORD.sub(put, expanded) + ")"


def rule_sql(
    b: Binder,
    rule: Rule,
    *,
    default_case: str = "insensitive",
    given: dict[str, frozenset[str]] | None = None,
) -> str:
    """One boolean SQL expression for the rule; NULL counts as no match.

    `given` names items (selection -> keys) that the caller has tested already.
    """
    cased = default_case == "sensitive"
    given = given or {}
    selections = {
        name: predicates.selection(
            b, spec, default_cased=cased, given=given.get(name, frozenset())
        )
        for name, spec in rule.selections.items()
    }
    sql = condition_sql(rule, selections)
    scope = [
        f"lower({b.fields.logsource[k]}) = {predicates.lit.sql_str(v.lower())}"
        for k, v in rule.logsource.items() if k in b.fields.logsource
    ]
    # The log source comes first so that it short-circuits the rest.
    return "(" + " AND ".join([*scope, sql]) + ")" if scope else sql


# -- placeholders -----------------------------------------------------------

_PLACEHOLDER = re.compile(r"^%(\w+)%$")


def _expand(spec: Any, table: dict[str, list[str]], title: str) -> Any:
    if isinstance(spec, dict):
        out = {}
        for key, values in spec.items():
            if "expand" in key.split("|")[1:]:
                items = values if isinstance(values, (list, tuple)) else [values]
                full: list = []
                for v in items:
                    m = _PLACEHOLDER.match(v) if isinstance(v, str) else None
                    if m is None:
                        full.append(v)
                    elif m.group(1) not in table:
                        raise RuleError(
                            f"rule {title!r}: placeholder {m.group(1)!r} not found"
                            f" (available: {sorted(table)})"
                        )
                    else:
                        full.extend(table[m.group(1)])
                out[key] = full
            else:
                out[key] = values
        return out
    if isinstance(spec, (list, tuple)):
        return [_expand(s, table, title) for s in spec]
    return spec


def resolve_placeholders(rule: Rule, table: dict[str, list[str]] | None) -> Rule:
    """Replace %name% values of |expand items; an unknown name is an error."""
    return replace(
        rule,
        selections={n: _expand(s, table or {}, rule.title) for n, s in rule.selections.items()},
    )


# -- processing steps chosen by log source ----------------------------------

@dataclass(frozen=True)
class FieldProfile:
    """Renames and added conditions for rules of one log source."""

    when: dict[str, str]
    rename: dict[str, str] = field(default_factory=dict)
    add: dict[str, Any] = field(default_factory=dict)

    def fits(self, rule: Rule) -> bool:
        return all(rule.logsource.get(k) == v for k, v in self.when.items())

    def _renamed(self, spec: Any) -> Any:
        if isinstance(spec, dict):
            out = {}
            for key, v in spec.items():
                name, *mods = key.split("|")
                if "fieldref" in mods:
                    v = [self.rename.get(x, x) for x in v] if isinstance(v, list) else self.rename.get(v, v)
                out["|".join([self.rename.get(name, name), *mods])] = v
            return out
        if isinstance(spec, (list, tuple)):
            return [self._renamed(s) for s in spec]
        return spec

    def apply(self, rule: Rule) -> Rule:
        if not self.fits(rule):
            return rule
        selections = {n: self._renamed(s) for n, s in rule.selections.items()}
        condition = rule.condition
        if self.add:
            # Quantifiers are settled first: the extra selection is not "of them".
            condition = _QUANTIFIER.sub(lambda m: _of(rule, m.group(1), m.group(2)), condition)
            extra = f"_profile{len(selections)}"
            selections[extra] = dict(self.add)
            condition = f"{extra} and ({condition})"
        return replace(
            rule,
            selections=selections,
            condition=condition,
            fields=tuple(self.rename.get(f, f) for f in rule.fields),
        )


# Event numbers of the Sysmon log, by rule category.
SYSMON_EVENT_IDS = {
    "process_creation": 1,
    "file_change": 2,
    "network_connection": 3,
    "process_termination": 5,
    "driver_load": 6,
    "image_load": 7,
    "create_remote_thread": 8,
    "raw_access_thread": 9,
    "process_access": 10,
    "file_event": 11,
    "registry_add": 12,
    "registry_delete": 12,
    "registry_set": 13,
    "registry_rename": 14,
    "create_stream_hash": 15,
    "pipe_created": [17, 18],
    "wmi_event": [19, 20, 21],
    "dns_query": 22,
    "file_delete": 23,
}
# Windows channel names, by rule service.
WINDOWS_CHANNELS = {
    "application": "Application",
    "security": "Security",
    "system": "System",
    "sysmon": "Microsoft-Windows-Sysmon/Operational",
    "powershell": "Microsoft-Windows-PowerShell/Operational",
    "powershell-classic": "Windows PowerShell",
    "taskscheduler": "Microsoft-Windows-TaskScheduler/Operational",
    "wmi": "Microsoft-Windows-WMI-Activity/Operational",
    "dns-server": "DNS Server",
    "windefend": "Microsoft-Windows-Windows Defender/Operational",
}


def sysmon_profiles() -> list[FieldProfile]:
    return [
        FieldProfile({"product": "windows", "category": c}, add={"EventID": ids})
        for c, ids in SYSMON_EVENT_IDS.items()
    ]


def windows_profiles() -> list[FieldProfile]:
    return [
        FieldProfile({"product": "windows", "service": s}, add={"Channel": channel})
        for s, channel in WINDOWS_CHANNELS.items()
    ]


def falcon_profiles() -> list[FieldProfile]:
    """Process events as an endpoint agent's event stream names them."""
    return [
        FieldProfile(
            {"product": "windows", "category": "process_creation"},
            rename={
                "Image": "ImageFileName",
                "ParentImage": "ParentBaseFileName",
                "User": "UserName",
            },
            add={"event_simpleName": "ProcessRollup2"},
        )
    ]


# -- correlations ------------------------------------------------------------

@dataclass(frozen=True)
class Bounds:
    """Inclusive or strict limits that a measured value must lie in."""

    lo: float = -_INFINITY
    hi: float = _INFINITY
    lo_strict: bool = False
    hi_strict: bool = False

    @classmethod
    def of(cls, condition: dict[str, Any], span: Any, who: str) -> "Bounds":
        out = cls()
        for op, t in condition.items():
            if op not in ("gte", "gt", "lte", "lt", "eq"):
                raise RuleError(f"{who}: unknown threshold operator {op!r}")
            t = float(t)
            if op in ("gte", "eq") and t > out.lo:
                out = replace(out, lo=t, lo_strict=False)
            if op == "gt" and t >= out.lo:
                out = replace(out, lo=t, lo_strict=True)
            if op in ("lte", "eq") and t < out.hi:
                out = replace(out, hi=t, hi_strict=False)
            if op == "lt" and t <= out.hi:
                out = replace(out, hi=t, hi_strict=True)
        if span is not None:
            if len(span) != 2:
                raise RuleError(f"{who}: threshold_range needs two values")
            # The range replaces the condition's own threshold.
            out = cls(lo=float(span[0]), hi=float(span[1]))
        return out

    def sql(self, value: str) -> str:
        tests = []
        if self.lo > -_INFINITY:
            tests.append(f"{value} {'>' if self.lo_strict else '>='} {self.lo!r}D")
        if self.hi < _INFINITY:
            tests.append(f"{value} {'<' if self.hi_strict else '<='} {self.hi!r}D")
        return "(" + " AND ".join(tests) + ")" if tests else "TRUE"


@dataclass(frozen=True)
class Correlation:
    """A windowed rule over the matches of other rules."""

    id: str
    title: str
    severity: str
    kind: str
    refs: tuple[str, ...]
    group_by: tuple[str, ...]
    window_seconds: int
    bounds: Bounds = Bounds()
    value_field: str | None = None
    percentile: float | None = None
    tags: tuple[str, ...] = ()
    lateness_seconds: int = DEFAULT_LATENESS_SECONDS
    suppress_seconds: int | None = None
    allow_high_cardinality: bool = False

    @property
    def name(self) -> str:
        return slug(self.title)

    @classmethod
    def from_dict(cls, spec: dict) -> "Correlation":
        body = {**spec, **(spec.get("correlation") or {})}
        title = str(spec.get("title") or spec.get("name") or spec.get("id") or "")
        who = f"correlation {title!r}"
        notes: dict[str, Any] = {}
        for value in spec.values():
            # The annotation block may have any name; its option names are known.
            if isinstance(value, dict) and value and set(value) <= ANNOTATIONS:
                notes.update(value)
        kind = str(body.get("type"))
        kind = _KIND_ALIASES.get(kind, kind)
        if kind not in KINDS:
            raise UnknownKind(f"{who}: unknown type {kind!r}")
        condition = dict(body.get("condition") or {})
        value_field = condition.pop("field", None) or body.get("field")
        percentile = condition.pop("percentile", None)
        percentile = notes.get("percentile", percentile)
        if percentile is not None or notes.get("percentile_field"):
            kind = "percentile"
            value_field = notes.get("percentile_field") or value_field
        if kind == "percentile" and (percentile is None or not value_field):
            raise RuleError(f"{who}: percentile needs percentile and percentile_field")
        if kind == "percentile" and not 0 <= float(percentile) <= 100:
            raise RuleError(f"{who}: percentile must lie in 0..100")
        if kind == "value_count" and not value_field:
            raise RuleError(f"{who}: value_count needs a field")
        span = notes.get("threshold_range")
        if kind in ("event_count", "value_count") and not condition and span is None:
            raise RuleError(f"{who}: {kind} needs a threshold")
        if kind == "percentile" and not condition and span is None:
            condition = {"gte": 0}
        rules = body.get("rules") or ()
        refs = tuple(rules) if isinstance(rules, (list, tuple)) else (str(rules),)
        if not refs:
            raise RuleError(f"{who}: no rules to correlate")
        if len(set(refs)) != len(refs):
            raise RuleError(f"{who}: a rule is listed twice")
        keys = body.get("group-by", body.get("group_by")) or ()
        return cls(
            id=str(spec.get("id") or slug(title)),
            title=title,
            severity=_severity(spec, who),
            kind=kind,
            refs=tuple(str(r) for r in refs),
            group_by=tuple(keys) if isinstance(keys, (list, tuple)) else (str(keys),),
            window_seconds=timespan_seconds(body.get("timespan")),
            bounds=Bounds.of(condition, span, who),
            value_field=value_field,
            percentile=None if percentile is None else float(percentile),
            tags=tuple(str(t) for t in spec.get("tags") or ()),
            lateness_seconds=int(notes.get("allowed_lateness_seconds", DEFAULT_LATENESS_SECONDS)),
            suppress_seconds=(
                int(notes["suppress_window_seconds"])
                if notes.get("suppress_window_seconds") else None
            ),
            allow_high_cardinality=bool(notes.get("allow_high_cardinality", False)),
        )


@dataclass(frozen=True)
class Ruleset:
    """Single-event rules, and correlations in levels: each level needs only earlier ones."""

    rules: tuple[Rule, ...] = ()
    correlations: tuple[Correlation, ...] = ()
    levels: tuple[tuple[Correlation, ...], ...] = ()

    @classmethod
    def of(
        cls,
        rules: Iterable[Rule] = (),
        correlations: Iterable[Correlation] = (),
        *,
        strict: bool = True,
    ) -> "Ruleset":
        rules = tuple(rules)
        named = {r.id: r.id for r in rules} | {r.name: r.id for r in rules}
        correlations = tuple(correlations)
        corr_named = {c.id: c.id for c in correlations} | {c.name: c.id for c in correlations}
        ids = [x.id for x in (*rules, *correlations)]
        twice = {i for i in ids if ids.count(i) > 1} if len(set(ids)) != len(ids) else set()
        if twice:
            raise RuleError(f"rule id used twice: {sorted(twice)}")

        resolved = []
        for c in correlations:
            known = [corr_named.get(r) or named.get(r) for r in c.refs]
            if None in known:
                missing = [r for r, k in zip(c.refs, known) if k is None]
                if strict:
                    raise RuleError(f"correlation {c.id!r}: unknown rules {missing}")
                known = [k for k in known if k]
                if not known:
                    continue
            nested = [k for k in known if k in {x.id for x in correlations}]
            if nested and len(nested) != len(known):
                raise RuleError(f"correlation {c.id!r} mixes rules and correlations")
            if nested:
                odd = [g for g in c.group_by if g not in ALERT_KEY_FIELDS]
                if odd:
                    raise RuleError(
                        f"correlation {c.id!r} groups alerts by {odd};"
                        f" alerts only have {list(ALERT_KEY_FIELDS)}"
                    )
            resolved.append(replace(c, refs=tuple(known)))

        by_id = {c.id: c for c in resolved}
        graph = TopologicalSorter({c.id: [r for r in c.refs if r in by_id] for c in resolved})
        try:
            graph.prepare()
        except CycleError as e:
            raise RuleError(f"Cycle among correlations: {e.args[1]}") from e
        levels = []
        while graph.is_active():
            ready = graph.get_ready()
            levels.append(tuple(by_id[i] for i in sorted(ready)))
            graph.done(*ready)
        return cls(rules, tuple(resolved), tuple(levels))

    @property
    def by_id(self) -> dict[str, Rule]:
        return {r.id: r for r in self.rules}


def ruleset_from_dicts(
    specs: Iterable[dict],
    *,
    placeholders: dict[str, list[str]] | None = None,
    profiles: Iterable[FieldProfile] = (),
    strict: bool = True,
) -> Ruleset:
    profiles = list(profiles)
    rules, correlations = [], []
    for spec in specs:
        if not spec:
            continue
        if "correlation" in spec or ("type" in spec and "detection" not in spec):
            correlations.append(Correlation.from_dict(spec))
        else:
            rule = Rule.from_dict(spec)
            for p in profiles:
                rule = p.apply(rule)
            rules.append(resolve_placeholders(rule, placeholders))
    return Ruleset.of(rules, correlations, strict=strict)


def load_rules(*paths: str, **options: Any) -> Ruleset:
    """Read *.yml / *.yaml rule files, or directories of them (nested too)."""
    import yaml

    files: list[Path] = []
    for p in map(Path, paths):
        if p.is_dir():
            files += sorted(f for f in p.rglob("*") if f.suffix in (".yml", ".yaml"))
        else:
            files.append(p)
    specs = [doc for f in files for doc in yaml.safe_load_all(f.read_text("utf-8"))]
    return ruleset_from_dicts(specs, **options)
