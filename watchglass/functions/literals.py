"""Encodings of rule literals, all done once when a rule is bound.

Every function returns Spark SQL text or plain strings, so nothing here runs
per row.
"""

from __future__ import annotations

import base64
import re

# Characters that stand for a command-line dash.
DASHES = "-/–—―"

_DASH = re.compile(r"\B[-/]\b")
_JAVA_SPECIAL = set("\\^$.|?*+()[]{}#&~-<>")


def sql_str(text: str) -> str:
    """Quote text as a Spark SQL string literal."""
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def sql_ident(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def split_wildcards(text: str) -> list[tuple[str, str]]:
    """Split a rule value into ('text', s), ('any', '*') and ('one', '?') pieces.

    A backslash takes the special meaning away from *, ? and backslash; before
    any other character it is an ordinary character (Windows paths).
    """
    pieces: list[tuple[str, str]] = []
    buf: list[str] = []

    def flush() -> None:
        if buf:
            pieces.append(("text", "".join(buf)))
            buf.clear()

    i = 0
    while i < len(text):
        ch = text[i]
        if ch == "\\" and i + 1 < len(text) and text[i + 1] in "*?\\":
            buf.append(text[i + 1])
            i += 2
            continue
        if ch in "*?":
            flush()
            pieces.append(("any", ch) if ch == "*" else ("one", ch))
        else:
            buf.append(ch)
        i += 1
    flush()
    return pieces


def plain_text(pieces: list[tuple[str, str]]) -> str | None:
    """The literal text when there is no wildcard, else None."""
    if any(kind != "text" for kind, _ in pieces):
        return None
    return "".join(s for _, s in pieces)


def like_pattern(pieces: list[tuple[str, str]]) -> str:
    """LIKE pattern (escape character '!') for the pieces."""
    out = []
    for kind, s in pieces:
        if kind == "any":
            out.append("%")
        elif kind == "one":
            out.append("_")
        else:
            out.append(s.replace("!", "!!").replace("%", "!%").replace("_", "!_"))
    return "".join(out)


def java_quote(text: str) -> str:
    return "".join("\\" + c if c in _JAVA_SPECIAL else c for c in text)


def has_dash_option(text: str) -> bool:
    return _DASH.search(text) is not None


def dash_regex(pieces: list[tuple[str, str]]) -> str:
    """Regular expression in which each option dash matches any dash variant."""
    out = []
    any_dash = "[" + "".join("\\" + c if c in "-/" else c for c in DASHES) + "]"
    for kind, s in pieces:
        if kind == "any":
            out.append(".*")
        elif kind == "one":
            out.append(".")
        else:
            pos = 0
            for m in _DASH.finditer(s):
                out.append(java_quote(s[pos:m.start()]))
                out.append(any_dash)
                pos = m.end()
            out.append(java_quote(s[pos:]))
    return "".join(out)


def to_base64(raw: bytes) -> str:
    return base64.b64encode(raw).decode("ascii")


def base64_offsets(raw: bytes) -> list[str]:
    """The three texts that the bytes may leave inside a longer base64 text.

    With i bytes in front, the first whole output character that depends on
    our bytes alone is ceil(8i/6) and the last one ends at floor(8(i+n)/6).
    """
    out = []
    for i in range(3):
        first = -(-8 * i // 6)
        last = 8 * (i + len(raw)) // 6
        out.append(to_base64(b"\0" * i + raw)[first:last])
    return out


def widen(text: str, encoding: str = "utf-16-le") -> bytes:
    return text.encode(encoding)
