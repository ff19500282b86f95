"""Evaluating a ruleset on every event, and what follows from a match."""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from typing import Callable, Iterable, Sequence

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Observation, SparkSession, functions as F, types as T

from ..functions import literals as lit
from ..functions.fields import Binder, FieldMap
from ..plans.local import literal_frame
from ..schema import REASON_NOT_JSON, REASON_PREDICATE
from .rules import Rule, RuleError, Ruleset, rule_sql

RULE_NO = "__rule"
MATCH_MARKER = "DETECTION_MATCH"
DROP_MARKER = "DETECTION_DROP"


# -- which rules can match at all ------------------------------------------

def _required_selections(rule: Rule) -> list[str]:
    """Selections that must hold whenever the rule does (a safe subset)."""
    text = rule.condition
    while True:
        inner = re.sub(r"\([^()]*\)", " 0 ", text)
        if inner == text:
            break
        text = inner
    if re.search(r"\bor\b|\bof\b|\|", text, re.IGNORECASE):
        return []
    terms = [t.strip() for t in re.split(r"\band\b", text, flags=re.IGNORECASE)]
    return [t for t in terms if t in rule.selections]


def required_values(b: Binder, rule: Rule) -> dict[str, tuple[set[str], str, str]]:
    """field -> (lower-case texts of which one must be present, its selection and item).

    Of several items on a field the first one counts; the others stay tests.
    """
    out: dict[str, tuple[set[str], str, str]] = {}
    for name in _required_selections(rule):
        spec = rule.selections[name]
        if not isinstance(spec, dict):
            continue
        for key, values in spec.items():
            fname, *mods = key.split("|")
            if not fname or any(m not in ("cased", "expand") for m in mods) or b.is_numeric(fname):
                continue
            values = values if isinstance(values, (list, tuple)) else [values]
            texts = set()
            for v in values:
                plain = None
                if isinstance(v, (str, int)) and not isinstance(v, bool):
                    plain = lit.plain_text(lit.split_wildcards(str(v)))
                if plain is None:
                    break
                texts.add(plain.lower())
            else:
                out.setdefault(fname, (texts, name, key))
    return out


_GROUPING_PAYS = 8  # rules that share a field
_COMPILED_RULES = 40  # more tests than this do not fit one compiled method


def _hit_array(arrays: str, n: int) -> str:
    """Drop the -1 of rules that do not match.

    array_remove is compiled together with the tests. Beyond what fits into a
    compiled method the higher-order filter is faster, as it is interpreted
    from the start.
    """
    if n <= _COMPILED_RULES:
        return f"array_remove({arrays}, -1)"
    return f"filter({arrays}, i -> i >= 0)"


def hits_sql(
    b: Binder, rules: Sequence[Rule], *, default_case: str = "insensitive", broken: Iterable[int] = ()
) -> str:
    """SQL for the array of numbers of the rules an event matches.

    Rules whose numbers are `broken` match nothing.

    Rules that require one of a few values in the most used equality field sit
    behind a CASE on that field, so an event is tested only against the rules
    that its own value can satisfy.
    """
    needs = [required_values(b, r) for r in rules]
    votes: dict[str, int] = {}
    for n in needs:
        for f in n:
            votes[f] = votes.get(f, 0) + 1
    key = max(votes, key=lambda f: votes[f], default=None)
    if key is None or votes[key] < _GROUPING_PAYS:
        key = None
    groups: dict[str, list[str]] = {}
    rest = []
    broken = set(broken)
    for i, (rule, need) in enumerate(zip(rules, needs)):
        given = None
        if i in broken:
            continue
        if key in need and default_case == "insensitive" and "cased" not in need[key][2].split("|"):
            # The CASE has settled this very item, and no other.
            given = {need[key][1]: frozenset([need[key][2]])}
        test = f"if({rule_sql(b, rule, default_case=default_case, given=given)}, {i}, -1)"
        if key in need:
            for value in sorted(need[key][0]):
                groups.setdefault(value, []).append(test)
        else:
            rest.append(test)
    if not groups and not rest:
        return "CAST(array() AS ARRAY<INT>)"
    if not groups:
        return _hit_array(f"array({', '.join(rest)})", len(rest))
    branches = " ".join(
        f"WHEN {lit.sql_str(v)} THEN array({', '.join(ts)})" for v, ts in groups.items()
    )
    chosen = f"CASE {b.lower(key)} {branches} ELSE CAST(array() AS ARRAY<INT>) END"
    if rest:
        chosen = f"concat({chosen}, array({', '.join(rest)}))"
    return _hit_array(chosen, sum(map(len, groups.values())) + len(rest))


def _patterns(rule: Rule) -> list[str]:
    """Regular expressions in a rule."""
    found: list[str] = []

    def walk(spec) -> None:
        if isinstance(spec, dict):
            for k, v in spec.items():
                if "re" in k.split("|")[1:]:
                    found.extend(str(x) for x in (v if isinstance(v, list) else [v]))
        elif isinstance(spec, (list, tuple)):
            for s in spec:
                walk(s)

    for s in rule.selections.values():
        walk(s)
    return found


def broken_rules(spark: SparkSession, rules: Sequence[Rule]) -> dict[int, str]:
    """Number of each rule with a regular expression that Java cannot compile, and why.

    The patterns are compiled on the driver; no job runs.
    """
    java = spark._jvm.java.util.regex.Pattern
    out: dict[int, str] = {}
    for i, r in enumerate(rules):
        for p in _patterns(r):
            try:
                java.compile(p)
            except Exception as e:  # Py4J wraps what Java throws
                why = str(getattr(e, "java_exception", e)).splitlines()[0]
                out.setdefault(i, f"pattern {p!r} does not compile: {why}")
    return out


def check_patterns(df: DataFrame, rules: Iterable[Rule]) -> None:
    """Raise now for a regular expression that Java cannot compile."""
    rules = list(rules)
    for i, why in broken_rules(df.sparkSession, rules).items():
        raise RuleError(f"rule {rules[i].title!r}: {why}")


def rule_letters(spark: SparkSession, rules: Sequence[Rule]) -> DataFrame:
    """Dead letters for the rules that cannot run; the others run without them."""
    broken = broken_rules(spark, rules)
    return literal_frame(spark, {
        "reason": (pa.string(), [REASON_PREDICATE] * len(broken)),
        "rule_id": (pa.string(), [rules[i].id for i in broken]),
        "event": (pa.string(), [None] * len(broken)),
        "error": (pa.string(), list(broken.values())),
        "trace": (pa.string(), [None] * len(broken)),
    })


def with_hits(
    df: DataFrame,
    rules: Sequence[Rule],
    fields: FieldMap | None = None,
    *,
    default_case: str = "insensitive",
    binder: Binder | None = None,
    name: str = "hits",
) -> DataFrame:
    """Add `hits`: numbers (positions in `rules`) of the matching rules."""
    b = binder or Binder(df, fields)
    broken = broken_rules(df.sparkSession, rules)
    sql = hits_sql(b, rules, default_case=default_case, broken=broken)
    return b.attach(_parsed(df, b)).selectExpr("*", f"{sql} AS {name}")


def _parsed(df: DataFrame, b: Binder) -> DataFrame:
    """Records that are not JSON go to the dead letters, never through the rules."""
    document = b.fields.document
    return df.where(F.col(document).isNotNull()) if document else df


def explode_hits(
    df: DataFrame,
    rules: Sequence[Rule],
    fields: FieldMap | None = None,
    *,
    keep: Sequence[str] | None = None,
    default_case: str = "insensitive",
) -> DataFrame:
    """One row per (event, matching rule), with the rule's number in `__rule`."""
    b = Binder(df, fields)
    broken = broken_rules(df.sparkSession, rules)
    sql = hits_sql(b, rules, default_case=default_case, broken=broken)
    kept = [lit.sql_ident(c) for c in (df.columns if keep is None else keep)]
    return b.attach(_parsed(df, b)).selectExpr(*kept, f"explode({sql}) AS {RULE_NO}")


def rule_table(df: DataFrame, rules: Sequence[Rule]) -> DataFrame:
    return literal_frame(df.sparkSession, {
        RULE_NO: (pa.int32(), range(len(rules))),
        "rule_id": (pa.string(), [r.id for r in rules]),
        "rule_title": (pa.string(), [r.title for r in rules]),
        "rule_name": (pa.string(), [r.name for r in rules]),
        "severity": (pa.string(), [r.severity for r in rules]),
        "tags": (pa.list_(pa.string()), [list(r.tags) for r in rules]),
    })


def matches(
    df: DataFrame,
    rules: Sequence[Rule],
    fields: FieldMap | None = None,
    *,
    keep: Sequence[str] | None = None,
    default_case: str = "insensitive",
) -> DataFrame:
    """One row per (event, rule) with the rule's id, title, name, severity, tags."""
    hits = explode_hits(df, rules, fields, keep=keep, default_case=default_case)
    return hits.join(rule_table(df, rules), RULE_NO).drop(RULE_NO)


def _event_json(b: Binder, rules: Sequence[Rule]) -> str:
    """The whole event, or the rule's own `fields` of it."""
    cases = []
    for names in sorted({r.fields for r in rules if r.fields}):
        numbers = ", ".join(str(i) for i, r in enumerate(rules) if r.fields == names)
        parts = ", ".join(f"{lit.sql_str(n)}, {b.native(n)}" for n in names)
        cases.append(f"WHEN {RULE_NO} IN ({numbers}) THEN to_json(named_struct({parts}))")
    return f"CASE {' '.join(cases)} ELSE {b.raw()} END" if cases else b.raw()


def alerts(
    df: DataFrame,
    rules: Sequence[Rule],
    fields: FieldMap | None = None,
    *,
    fired_at: Column | str | None = None,
    default_case: str = "insensitive",
) -> DataFrame:
    """Single-event alerts. `fired_at` defaults to the wall clock."""
    if fired_at is None:
        fired_at = F.current_timestamp()
    elif isinstance(fired_at, str):
        fired_at = F.col(fired_at)
    hits = explode_hits(df, rules, fields, default_case=default_case)
    event = _event_json(Binder(df, fields), rules)
    narrow = hits.select(
        RULE_NO,
        fired_at.cast("timestamp").alias("fired_at"),
        F.expr(f"array({event})").alias("matched_events"),
    )
    none = F.lit(None)
    return narrow.join(rule_table(df, rules), RULE_NO).select(
        "rule_id", "rule_title", "severity", "fired_at",
        none.cast("timestamp").alias("window_start"),
        none.cast("timestamp").alias("window_end"),
        none.cast("string").alias("correlation_key"),
        "matched_events", "tags",
    )


def match_records(matched: DataFrame, raw: Column | str) -> DataFrame:
    """The structured log record of each match, as JSON text."""
    raw = F.col(raw) if isinstance(raw, str) else raw
    return matched.select(
        F.to_json(F.struct(
            F.lit(MATCH_MARKER).alias("event"),
            F.col("rule_name"),
            F.col("severity"),
            raw.alias("record"),
            F.concat(F.lit("rule '"), F.col("rule_name"), F.lit("' matched")).alias("message"),
        )).alias("record")
    )


def rule_counters(matched: DataFrame) -> DataFrame:
    """Number of matches per rule."""
    return matched.groupBy("rule_id").agg(F.count(F.lit(1)).alias("matches"))


def observe_matches(matched: DataFrame, rules: Sequence[Rule], name: "str | Observation") -> DataFrame:
    """Count matches per rule on the way through, for a stream's progress reports.

    The counters are named matches_<rule id> and appear under `name`.
    """
    return matched.observe(name, *[
        F.count_if(F.col("rule_id") == r.id).alias(f"matches_{r.id}") for r in rules
    ])


def rule_coverage(matched: DataFrame, rules: Sequence[Rule]) -> DataFrame:
    """Matches per rule, rules without any match included."""
    counts = rule_counters(matched)
    return (
        rule_table(matched, rules).select("rule_id", "rule_name", "severity")
        .join(counts, "rule_id", "left")
        .select("rule_id", "rule_name", "severity", F.coalesce("matches", F.lit(0)).alias("matches"))
    )


# -- dead letters -------------------------------------------------------------

def not_json_letters(df: DataFrame, raw: str = "raw", document: str = "data") -> DataFrame:
    """Dead letters for the records whose text is not JSON."""
    return df.where(F.col(document).isNull()).select(
        F.lit(REASON_NOT_JSON).alias("reason"),
        F.lit(None).cast("string").alias("rule_id"),
        F.col(raw).cast("string").alias("event"),
        F.lit("the text is not a JSON document").alias("error"),
        F.lit(None).cast("string").alias("trace"),
    )


@dataclass(frozen=True)
class PythonRule:
    """A rule whose test is a Python function of one event's columns (a dict).

    `series`, if given, is the same test of many events at once: a function of a pandas
    DataFrame of the columns that returns a boolean Series.
    """

    id: str
    title: str
    test: Callable[[dict], bool]
    columns: tuple[str, ...]
    severity: str = "medium"
    tags: tuple[str, ...] = field(default_factory=tuple)
    series: Callable[[pd.DataFrame], pd.Series] | None = None

    @property
    def name(self) -> str:
        return self.id


def with_python_rule(df: DataFrame, rule: PythonRule, name: str = "outcome") -> DataFrame:
    """Add struct(hit, error, trace): a rule that raises marks only its own outcome."""
    test, columns = rule.test, rule.columns

    @F.pandas_udf(T.StructType([
        T.StructField("hit", T.BooleanType()),
        T.StructField("error", T.StringType()),
        T.StructField("trace", T.StringType()),
    ]))
    def run(frame: pd.DataFrame) -> pd.DataFrame:
        import traceback

        out = []
        traces: dict[tuple, str] = {}  # formatting one is slow, and few differ
        for values in frame.itertuples(index=False, name=None):
            try:
                out.append((bool(test(dict(zip(columns, values)))), None, None))
            except Exception as e:
                error = f"{type(e).__name__}: {e}"
                lines = tuple(at for _, at in traceback.walk_tb(e.__traceback__))
                if (error, lines) not in traces:
                    traces[error, lines] = traceback.format_exc()
                out.append((False, error, traces[error, lines]))
        return pd.DataFrame(out, columns=["hit", "error", "trace"])

    return df.withColumn(name, run(F.struct(*columns)))


def predicate_letters(df: DataFrame, rule: PythonRule, raw: Column, name: str = "outcome") -> DataFrame:
    """Dead letters for the events on which a Python rule raised."""
    return df.where(F.col(f"{name}.error").isNotNull()).select(
        F.lit(REASON_PREDICATE).alias("reason"),
        F.lit(rule.id).alias("rule_id"),
        raw.cast("string").alias("event"),
        F.col(f"{name}.error").alias("error"),
        F.col(f"{name}.trace").alias("trace"),
    )


def _outcomes(rule: PythonRule, frame: pd.DataFrame) -> tuple[list[bool], dict[int, tuple[str, str]]]:
    """Whether each event of a batch matches, and error and trace of those on which the rule raised.

    The events are tested together if the rule can; one by one if it cannot, or if that raises.
    """
    import traceback

    frame = frame[list(rule.columns)]
    if rule.series is not None:
        try:
            found = pd.Series(rule.series(frame)).fillna(False).astype(bool)
            if len(found) == len(frame):
                return found.tolist(), {}
        except Exception:  # which events did it, the tests one by one will tell
            pass
    hits, errors = [], {}
    traces: dict[tuple, str] = {}  # formatting one is slow, and few differ
    for i, values in enumerate(frame.itertuples(index=False, name=None)):
        try:
            hits.append(bool(rule.test(dict(zip(rule.columns, values)))))
        except Exception as e:
            error = f"{type(e).__name__}: {e}"
            lines = tuple(at for _, at in traceback.walk_tb(e.__traceback__))
            if (error, lines) not in traces:
                traces[error, lines] = traceback.format_exc()
            hits.append(False)
            errors[i] = (error, traces[error, lines])
    return hits, errors


def with_python_rules(df: DataFrame, rules: Sequence[PythonRule], name: str = "python") -> DataFrame:
    """Add struct(hits, errors) of all Python rules, from one Arrow pass over the columns they use.

    hits are the positions of the rules that match; errors have the position, the error and
    the trace of each rule that raised on the event, which concerns no other rule or event.
    """
    columns = sorted({c for r in rules for c in r.columns})

    @F.pandas_udf("hits array<int>, errors array<struct<rule:int,error:string,trace:string>>")
    def run(frame: pd.DataFrame) -> pd.DataFrame:
        hits: list[list[int]] = [[] for _ in range(len(frame))]
        errors: list[list[tuple]] = [[] for _ in range(len(frame))]
        for number, rule in enumerate(rules):
            matched, raised = _outcomes(rule, frame)
            for i, hit in enumerate(matched):
                if hit:
                    hits[i].append(number)
            for i, (error, trace) in raised.items():
                errors[i].append((number, error, trace))
        return pd.DataFrame({"hits": hits, "errors": errors})

    return df.withColumn(name, run(F.struct(*columns)))


def python_alerts(
    tested: DataFrame, rules: Sequence[PythonRule], fields: FieldMap | None = None, *,
    fired_at: Column | None = None, name: str = "python",
) -> DataFrame:
    """Alerts of the Python rules that `with_python_rules` found to match."""
    event = Binder(tested.drop(name), fields).raw()
    hits = tested.select(
        F.explode(f"{name}.hits").alias(RULE_NO), F.expr(f"array({event})").alias("matched_events"),
        (F.current_timestamp() if fired_at is None else fired_at).cast("timestamp").alias("fired_at"),
    )
    none = F.lit(None)
    return hits.join(rule_table(tested, rules), RULE_NO).select(
        "rule_id", "rule_title", "severity", "fired_at", none.cast("timestamp").alias("window_start"),
        none.cast("timestamp").alias("window_end"), none.cast("string").alias("correlation_key"), "matched_events", "tags",
    )


def python_letters(
    tested: DataFrame, rules: Sequence[PythonRule], fields: FieldMap | None = None, *, name: str = "python"
) -> DataFrame:
    """Dead letters for the events on which Python rules raised, one per rule."""
    event = Binder(tested.drop(name), fields).raw()
    raised = tested.where(F.size(f"{name}.errors") > 0).select(F.expr(event).alias("event"), F.explode(f"{name}.errors").alias("e"))
    ids = F.array(*(F.lit(r.id) for r in rules))
    return raised.select(
        F.lit(REASON_PREDICATE).alias("reason"), F.get(ids, F.col("e.rule")).alias("rule_id"), "event",
        F.col("e.error").alias("error"), F.col("e.trace").alias("trace"),
    )


# -- replay against expectations -------------------------------------------

def replay_report(
    events: DataFrame,
    ruleset: Ruleset,
    expected: DataFrame,
    fields: FieldMap | None = None,
    *,
    default_case: str = "insensitive",
) -> DataFrame:
    """Compare what fires per file with expected(path, matches, dropped).

    `events` has path, raw and the parsed document `data`. A file without a row
    in `expected`, or the reverse, fails.
    """
    fields = fields or FieldMap(document="data", raw="raw")
    fired = (
        matches(events, ruleset.rules, fields, keep=["path"], default_case=default_case)
        .groupBy("path").agg(F.array_sort(F.collect_set("rule_name")).alias("fired"))
    )
    seen = events.groupBy("path").agg(F.bool_or(F.col("data").isNull()).alias("was_dropped"))
    empty = F.array().cast("array<string>")
    actual = seen.join(fired, "path", "left").withColumn("fired", F.coalesce("fired", empty))
    wanted = expected.select(
        "path", F.array_sort(F.coalesce("matches", empty)).alias("wanted"),
        F.coalesce("dropped", F.lit(False)).alias("want_dropped"),
    )
    return actual.join(wanted, "path", "full").select(
        "path", "fired", "wanted", "was_dropped", "want_dropped",
        (F.col("fired").eqNullSafe(F.col("wanted"))
         & F.col("was_dropped").eqNullSafe(F.col("want_dropped"))).alias("ok"),
    )
