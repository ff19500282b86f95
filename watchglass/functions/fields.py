"""From a rule's field name to a Spark SQL expression over one DataFrame.

Typed columns, nested structs, VARIANT documents and JSON text columns are all
addressed with the same dotted names. Paths are extracted once per row into
helper columns that every rule shares.
"""

from __future__ import annotations

from dataclasses import dataclass, field as dc_field

from pyspark.sql import DataFrame, types as T

from .literals import sql_ident, sql_str


def _variant_path(parts: list[str]) -> str:
    """Path of nested keys; the path syntax has no escapes, only two kinds of quotes."""
    out = "$"
    for p in parts:
        if "'" in p and '"' in p:
            raise ValueError(f"field name with both kinds of quotes: {p!r}")
        out += f'["{p}"]' if "'" in p else f"['{p}']"
    return out


SEPARATOR = "\u0003"  # JSON text holds no control characters, so these can stand in it
_BACKSLASH, _QUOTE = "\u0001", "\u0002"
_MARKS = r"[\[\]{},:]+"
_OTHER = "\ufffd"  # what a control character without an escape of its own becomes
_ESCAPES = (("\\n", "\n"), ("\\t", "\t"), ("\\r", "\r"), ("\\b", "\b"), ("\\f", "\f"), ("\\/", "/"))


def leaf_texts(json: str) -> str:
    """SQL of all values in JSON text as Spark writes it, unescaped, apart by SEPARATOR.

    Once escaped backslashes and quotes have stand-ins, quotes are what splits the text:
    every other part is a string, and a name if a colon follows. Numbers, TRUE and FALSE
    stand in the parts between.
    """
    clear = f"replace(replace({json}, {sql_str(chr(92) * 2)}, {sql_str(_BACKSLASH)}), {sql_str(chr(92) + chr(34))}, {sql_str(_QUOTE)})"
    strings = (
        "filter(transform(parts, (x, i) -> if(i % 2 = 1 AND NOT startswith(get(parts, i + 1), ':'), x, NULL)),"
        " x -> x IS NOT NULL)"
    )
    between = "array_join(filter(parts, (x, i) -> i % 2 = 0), ',')"
    others = f"filter(split({between}, {sql_str(_MARKS)}), x -> x <> '' AND x <> 'null')"
    # A variable of a function: the text is split once, not again for each of its parts.
    joined = f"parts -> array_join(concat({strings}, {others}), {sql_str(SEPARATOR)})"
    out = f"get(transform(array(split({clear}, {sql_str(chr(34))})), {joined}), 0)"
    out = f"replace({out}, {sql_str(_QUOTE)}, {sql_str(chr(34))})"
    for escaped, plain in _ESCAPES:
        out = f"replace({out}, {sql_str(escaped)}, {sql_str(plain)})"
    out = f"regexp_replace({out}, {sql_str(chr(92) * 2 + 'u00[01][0-9a-fA-F]')}, {sql_str(_OTHER)})"
    return f"replace({out}, {sql_str(_BACKSLASH)}, {sql_str(chr(92))})"


def searched(text: str) -> str:
    """A keyword in the form in which `leaf_texts` has its control characters."""
    return "".join(_OTHER if c < " " and c not in "\n\t\r\b\f" else c for c in text)


@dataclass
class FieldMap:
    """How field names map onto a DataFrame.

    aliases: rule field name -> field name to use instead.
    exprs: rule field name -> SQL expression giving its value.
    document: VARIANT column that holds the whole event, if there is one.
    json_columns: string columns whose text is a JSON document.
    raw: SQL for the event's text, used by alerts, and by keywords where there is no document.
    """

    aliases: dict[str, str] = dc_field(default_factory=dict)
    exprs: dict[str, str] = dc_field(default_factory=dict)
    document: str | None = None
    json_columns: tuple[str, ...] = ()
    raw: str | None = None
    logsource: dict[str, str] = dc_field(default_factory=dict)


class Binder:
    """Collects the field expressions that a set of rules needs."""

    def __init__(self, df: DataFrame, fields: FieldMap | None = None) -> None:
        self.fields = fields or FieldMap()
        self._schema = df.schema
        self._types = {f.name: f.dataType for f in df.schema.fields}
        self._parsed: dict[str, str] = {}
        self._text: dict[str, str] = {}
        self._lower: dict[str, str] = {}
        self._number: dict[str, str] = {}
        self._state: dict[str, str] = {}
        self._words = False

    # -- names -----------------------------------------------------------

    def _target(self, name: str) -> str:
        return self.fields.aliases.get(name, name)

    def _locate(self, name: str) -> tuple[str, object]:
        """('typed', (sql, type)), ('variant', [paths of (column, path)]) or ('absent', None)."""
        name = self._target(name)
        if name in self.fields.exprs:
            return "typed", (f"({self.fields.exprs[name]})", None)
        if name in self._types:
            return self._column(sql_ident(name), self._types[name], name, [])
        parts = name.split(".")
        if parts[0] in self._types and len(parts) > 1:
            return self._column(sql_ident(parts[0]), self._types[parts[0]], parts[0], parts[1:])
        if self.fields.document:
            paths = [[name]] if len(parts) == 1 else [[name], parts]
            return "variant", [(sql_ident(self.fields.document), p) for p in paths]
        return "absent", None

    def _column(self, sql, dtype, root, rest):
        if root in self.fields.json_columns and rest:
            parsed = self._parsed.setdefault(root, f"__doc{len(self._parsed)}")
            paths = [rest] if len(rest) == 1 else [[".".join(rest)], rest]
            return "variant", [(parsed, p) for p in paths]
        while rest:
            if isinstance(dtype, T.StructType) and rest[0] in dtype.names:
                sql += "." + sql_ident(rest[0])
                dtype = dtype[rest[0]].dataType
                rest = rest[1:]
            elif isinstance(dtype, T.VariantType):
                return "variant", [(sql, rest)]
            elif isinstance(dtype, T.MapType):
                sql = f"try_element_at({sql}, {sql_str('.'.join(rest))})"
                dtype, rest = dtype.valueType, []
            else:
                return "absent", None
        return "typed", (sql, dtype)

    # -- expressions over helper columns ------------------------------------

    def text(self, name: str) -> str:
        """String form of a field; NULL when it is missing or null."""
        return self._text.setdefault(name, f"__t{len(self._text)}")

    def lower(self, name: str) -> str:
        self.text(name)
        return self._lower.setdefault(name, f"__l{len(self._lower)}")

    def number(self, name: str) -> str:
        return self._number.setdefault(name, f"__n{len(self._number)}")

    def present(self, name: str) -> str:
        """TRUE when the event carries the field, even as JSON null."""
        return self._state.setdefault(name, f"__p{len(self._state)}")

    def is_null(self, name: str) -> str:
        return f"({self.text(name)} IS NULL)"

    def is_numeric(self, name: str) -> bool:
        kind, where = self._locate(name)
        return kind == "typed" and isinstance(where[1], T.NumericType)

    def raw(self) -> str:
        """SQL for the text of the whole event."""
        if self.fields.raw:
            return f"({self.fields.raw})"
        if self.fields.document:
            return f"to_json({sql_ident(self.fields.document)})"
        names = ", ".join(sql_ident(n) for n in self._types if not n.startswith("__"))
        return f"to_json(struct({names}))"

    def words(self) -> str:
        """Column of the texts of all the event's values, apart by SEPARATOR; what keywords search.

        A document's values are its leaves, at any depth, unescaped; names of fields are
        none. Events that are not documents have the values of all their columns, and a
        `raw` text is searched as it is.
        """
        self._words = True
        return "__kw"

    def lower_words(self) -> str:
        self._words = True
        return "__kwl"

    def _word_sql(self) -> str:
        if self.fields.document:
            return leaf_texts(f"to_json({sql_ident(self.fields.document)})")
        if self.fields.raw:
            return self.fields.raw
        names = [n for n in self._types if not n.startswith("__")]
        parsed = [n for n in names if n in self.fields.json_columns]
        plain = ", ".join(sql_ident(n) for n in names if n not in parsed)
        parts = [leaf_texts(f"to_json(struct({plain}))")] if plain else []
        for n in parsed:  # text that is not JSON is a value itself
            text = sql_ident(n)
            parts.append(f"coalesce({leaf_texts(f'to_json(try_parse_json({text}))')}, {text})")
        return f"concat_ws({sql_str(SEPARATOR)}, {', '.join(parts)})"

    def native(self, name: str) -> str:
        """The field with its own type, read directly from the event."""
        kind, where = self._locate(name)
        if kind == "absent":
            return "CAST(NULL AS STRING)"
        if kind == "typed":
            return where[0]
        columns = {v: f"try_parse_json({sql_ident(c)})" for c, v in self._parsed.items()}
        reads = [
            f"try_variant_get({columns.get(col, col)}, {sql_str(_variant_path(p))}, 'variant')"
            for col, p in where
        ]
        return reads[0] if len(reads) == 1 else f"coalesce({', '.join(reads)})"

    # -- SQL of the helper columns -----------------------------------------

    def _value(self, name: str, as_type: str) -> str:
        kind, where = self._locate(name)
        if kind == "absent":
            return f"CAST(NULL AS {as_type})"
        if kind == "typed":
            sql, dtype = where
            if as_type == "STRING":
                return sql if isinstance(dtype, T.StringType) else f"CAST({sql} AS STRING)"
            return f"try_cast({sql} AS {as_type})"
        reads = [
            f"try_variant_get({col}, {sql_str(_variant_path(p))}, 'string')" for col, p in where
        ]
        text = reads[0] if len(reads) == 1 else f"coalesce({', '.join(reads)})"
        return text if as_type == "STRING" else f"try_cast({text} AS {as_type})"

    def _presence(self, name: str) -> str:
        kind, where = self._locate(name)
        if kind == "absent":
            return "FALSE"
        if kind == "typed":
            return f"({where[0]} IS NOT NULL)"
        return "(" + " OR ".join(
            f"try_variant_get({col}, {sql_str(_variant_path(p))}, 'variant') IS NOT NULL"
            for col, p in where
        ) + ")"

    def attach(self, df: DataFrame) -> DataFrame:
        """Add every helper column the bound rules asked for."""
        values = [f"{self._value(n, 'STRING')} AS {c}" for n, c in self._text.items()]
        values += [f"{self._value(n, 'DOUBLE')} AS {c}" for n, c in self._number.items()]
        values += [f"{self._presence(n)} AS {c}" for n, c in self._state.items()]
        if self._parsed:
            df = df.selectExpr(
                "*", *(f"try_parse_json({sql_ident(c)}) AS {v}" for c, v in self._parsed.items())
            )
        if self._words:
            values.append(f"{self._word_sql()} AS __kw")
        if values:
            df = df.selectExpr("*", *values)
        if self._words:
            df = df.selectExpr("*", "lower(__kw) AS __kwl")
        if self._lower:
            df = df.selectExpr(
                "*", *(f"lower({self._text[n]}) AS {c}" for n, c in self._lower.items())
            )
        return df

    @property
    def helper_columns(self) -> list[str]:
        return [
            *self._parsed.values(), *self._text.values(), *self._lower.values(),
            *self._number.values(), *self._state.values(), *(["__kw", "__kwl"] if self._words else []),
        ]
