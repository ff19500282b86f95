"""One detection item (field, modifiers, values) as a boolean SQL expression.

A test on a missing field is NULL here, which AND, OR and IF treat as false.
Only NOT would let it through as NULL; `rules.condition_sql` therefore makes
selections total (TRUE or FALSE) in the conditions that use NOT.
"""

from __future__ import annotations

from ..functions import literals as lit
from ..functions.cidr import cidr_sql
from ..functions.fields import SEPARATOR, Binder, searched

_POSITIONS = ("startswith", "endswith", "contains")
_COMPARISONS = {"lt": "<", "lte": "<=", "gt": ">", "gte": ">="}
_ENCODINGS = {"wide": "utf-16-le", "utf16le": "utf-16-le", "utf16be": "utf-16-be"}
_REGEX_FLAGS = {"i": "i", "ignorecase": "i", "m": "m", "multiline": "m", "s": "s", "dotall": "s"}
MODIFIERS = {
    *_POSITIONS, *_COMPARISONS, *_ENCODINGS, *_REGEX_FLAGS,
    "re", "cidr", "cased", "exists", "fieldref", "windash", "base64",
    "base64offset", "all", "expand",
}


def total(sql: str) -> str:
    return f"coalesce({sql}, FALSE)"


def _as_text(value) -> str:
    """Scalar as the text it is compared with (booleans in JSON spelling)."""
    if isinstance(value, bool):
        return "true" if value else "false"
    return str(value)


def _encoded(text: str, mods: list[str]) -> list[str]:
    """Apply base64 and UTF-16 modifiers; more than one text means OR."""
    raw: bytes | None = None
    for m in mods:
        if m in _ENCODINGS:
            raw = lit.widen(text, _ENCODINGS[m])
    raw = raw if raw is not None else text.encode("utf-8")
    if "base64offset" in mods:
        return lit.base64_offsets(raw)
    if "base64" in mods:
        return [lit.to_base64(raw)]
    # UTF-16 without base64 leaves a text with NUL characters in it.
    return [raw.decode("latin-1")]


def string_match(b: Binder, name: str, value, mods: list[str], cased: bool) -> str:
    """Equality, wildcard, prefix, suffix or substring test on one value."""
    subject = b.text(name) if cased else b.lower(name)
    position = next((m for m in mods if m in _POSITIONS), None)
    text = _as_text(value)
    encoded = [m for m in mods if m in _ENCODINGS or m.startswith("base64")]
    if encoded:
        plain = lit.plain_text(lit.split_wildcards(text))
        if plain is None:
            raise ValueError(f"field {name!r}: wildcards cannot be encoded: {text!r}")
        variants = [[("text", t)] for t in _encoded(plain, mods)]
        if "base64offset" in mods and position is None:
            position = "contains"
    else:
        variants = [lit.split_wildcards(text)]

    tests = []
    for pieces in variants:
        if not cased:
            pieces = [(k, s.lower()) for k, s in pieces]
        whole = lit.plain_text(pieces)
        if "windash" in mods and any(k == "text" and lit.has_dash_option(s) for k, s in pieces):
            pattern = lit.dash_regex(pieces)
            head = "" if position in ("contains", "endswith") else "^"
            tail = "" if position in ("contains", "startswith") else "$"
            tests.append(f"{subject} RLIKE {lit.sql_str('(?s)' + head + pattern + tail)}")
        elif whole is None:
            pattern = lit.like_pattern(pieces)
            if position in ("contains", "endswith"):
                pattern = "%" + pattern
            if position in ("contains", "startswith"):
                pattern += "%"
            tests.append(f"{subject} LIKE {lit.sql_str(pattern)} ESCAPE '!'")
        elif position:
            tests.append(f"{position}({subject}, {lit.sql_str(whole)})")
        else:
            tests.append(f"{subject} = {lit.sql_str(whole)}")
    return tests[0] if len(tests) == 1 else "(" + " OR ".join(tests) + ")"


def keyword(b: Binder, value, mods: list[str], cased: bool) -> str:
    """A value looked for within each of the event's values."""
    pieces = [(k, searched(s)) for k, s in lit.split_wildcards(_as_text(value))]
    if not cased:
        pieces = [(k, s.lower()) for k, s in pieces]
    subject = b.words() if cased else b.lower_words()
    whole = lit.plain_text(pieces)
    if whole is not None:
        return f"contains({subject}, {lit.sql_str(whole)})"
    pattern = lit.sql_str("%" + lit.like_pattern(pieces) + "%")
    # The text as a whole is tested first: it is compiled, and seldom holds the pieces in order.
    return (
        f"({subject} LIKE {pattern} ESCAPE '!' AND"
        f" exists(split({subject}, {lit.sql_str(SEPARATOR)}), w -> w LIKE {pattern} ESCAPE '!'))"
    )


def _one(b: Binder, name: str, value, mods: list[str], cased: bool) -> str:
    if "exists" in mods:
        present = b.present(name)
        wanted = value if isinstance(value, bool) else _as_text(value).lower() == "true"
        return present if wanted else f"(NOT {present})"
    if value is None:
        return b.is_null(name)
    if "fieldref" in mods:
        other = str(value)
        if cased:
            return f"{b.text(name)} = {b.text(other)}"
        return f"{b.lower(name)} = {b.lower(other)}"
    if "re" in mods:
        flags = "".join(sorted({_REGEX_FLAGS[m] for m in mods if m in _REGEX_FLAGS}))
        pattern = (f"(?{flags})" if flags else "") + str(value)
        return f"{b.text(name)} RLIKE {lit.sql_str(pattern)}"
    if "cidr" in mods:
        return cidr_sql(b.text(name), str(value))
    for m, op in _COMPARISONS.items():
        if m in mods:
            return f"{b.number(name)} {op} {float(value)!r}D"
    if isinstance(value, (int, float)) and not isinstance(value, bool):
        if b.is_numeric(name) and not any(m in _POSITIONS for m in mods):
            return f"{b.number(name)} = {float(value)!r}D"
    return string_match(b, name, value, mods, cased)


def _is_plain(value) -> bool:
    if value is None or not isinstance(value, (str, bool)):
        return False
    return lit.plain_text(lit.split_wildcards(_as_text(value))) is not None


def detection_item(b: Binder, key: str, values, *, default_cased: bool = False) -> str:
    """SQL for `field|modifier|...: value or [values]`."""
    name, *mods = key.split("|")
    unknown = [m for m in mods if m not in MODIFIERS]
    if unknown:
        raise ValueError(f"field {name!r}: unknown modifier {unknown[0]!r}")
    cased = default_cased or "cased" in mods
    values = list(values) if isinstance(values, (list, tuple)) else [values]
    if not name:
        tests = [keyword(b, v, mods, cased) for v in values]
    else:
        effective = [m for m in mods if m not in ("cased", "all", "expand")]
        if not effective and "all" not in mods and len(values) > 1 and all(map(_is_plain, values)):
            texts = [lit.plain_text(lit.split_wildcards(_as_text(v))) for v in values]
            subject = b.text(name) if cased else b.lower(name)
            inside = ", ".join(lit.sql_str(t if cased else t.lower()) for t in texts)
            return f"{subject} IN ({inside})"
        tests = [_one(b, name, v, mods, cased) for v in values]
    if not tests:
        raise ValueError(f"field {name!r}: empty value list")
    return tests[0] if len(tests) == 1 else (
        "(" + (" AND " if "all" in mods else " OR ").join(tests) + ")"
    )


def selection(
    b: Binder, spec, *, default_cased: bool = False, given: frozenset[str] = frozenset()
) -> str:
    """A selection: map = AND of items, list = OR of its maps and keywords.

    Items of a map whose key is in `given` are already known to hold.
    """
    if isinstance(spec, dict):
        if not spec:
            raise ValueError("empty selection")
        parts = [
            detection_item(b, k, v, default_cased=default_cased)
            for k, v in spec.items() if k not in given
        ] or ["TRUE"]
        return parts[0] if len(parts) == 1 else "(" + " AND ".join(parts) + ")"
    if isinstance(spec, (list, tuple)):
        if not spec:
            raise ValueError("empty selection")
        parts = [selection(b, s, default_cased=default_cased) for s in spec]
        return parts[0] if len(parts) == 1 else "(" + " OR ".join(parts) + ")"
    return keyword(b, spec, [], default_cased)
