"""Shaping records before detection: parse, remap, syslog, event time."""

from __future__ import annotations

from typing import Callable

from pyspark.sql import Column, DataFrame, functions as F


def parse_events(df: DataFrame, value: str = "value", *, raw: str = "raw", document: str = "data") -> DataFrame:
    """Bytes or text -> `raw` text and VARIANT `data`.

    `data` is NULL when the bytes are not UTF-8 or the text is not JSON; those
    rows are what `matching.not_json_letters` reports.
    """
    # Of a key given twice the last one counts, as JSON parsers commonly have it.
    df.sparkSession.conf.set("spark.sql.variant.allowDuplicateKeys", "true")
    text = F.col(value).cast("string")
    return df.select(
        *[c for c in df.columns if c not in (value, raw, document)],
        F.make_valid_utf8(text).alias(raw),
        F.try_parse_json(F.try_validate_utf8(text)).alias(document),
    )


def remap(df: DataFrame, change: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """Apply a DataFrame function to the stream; identity when none is given."""
    return df if change is None else df.transform(change)


def event_time(source: Column | str) -> Column:
    """Timestamp from ISO 8601 text or a number since the epoch, in UTC.

    Numbers are seconds (whole or fractional) below 10^11, milliseconds below
    10^14, microseconds below 10^17 and nanoseconds below 9 * 10^18; that puts
    all of them between the years 1970 and 5138. Anything else is NULL.
    """
    text = (F.col(source) if isinstance(source, str) else source).cast("string")
    number = text.try_cast("double")
    whole = text.try_cast("bigint")
    size = F.abs(number)
    # Whole seconds stay exact; fractions are rounded to microseconds.
    seconds = F.coalesce(
        F.try_multiply(whole, F.lit(1000000)), F.round(number * 1000000).try_cast("bigint")
    )
    count = F.coalesce(whole, number.try_cast("bigint"))
    micros = (
        F.when(size < 1e11, seconds)
        .when(size < 1e14, F.try_multiply(count, F.lit(1000)))
        .when(size < 1e17, count)
        .when(size < 9e18, F.floor(count / 1000).cast("bigint"))
    )
    return F.coalesce(
        F.when(number.isNotNull(), F.timestamp_micros(micros)),
        F.when(number.isNull(), text.try_cast("timestamp")),
    )


def attach_event_time(df: DataFrame, source: Column | str = "timestamp", *, name: str = "event_time") -> DataFrame:
    return df.withColumn(name, event_time(source))


# Syslog severity and facility names, by number.
SYSLOG_SEVERITIES = ("emerg", "alert", "crit", "err", "warning", "notice", "info", "debug")
SYSLOG_FACILITIES = (
    "kern", "user", "mail", "daemon", "auth", "syslog", "lpr", "news", "uucp", "cron",
    "authpriv", "ftp", "ntp", "security", "console", "solaris-cron",
    "local0", "local1", "local2", "local3", "local4", "local5", "local6", "local7",
)

# Header fields are free of control characters, so one can separate the parts.
_SEP = "\u0001"
_WORD = r"([^\s\p{Cntrl}]+)"
_RFC5424 = rf"(?s)^<(\d{{1,3}})>(\d{{1,2}}) {_WORD} {_WORD} {_WORD} {_WORD} {_WORD} (.*)$"
_RFC3164 = (
    r"(?s)^(?:<(\d{1,3})>)?([A-Z][a-z]{2} [ \d]\d \d{2}:\d{2}:\d{2}) ([^\s\p{Cntrl}]+) "
    r"([^\s:\[\p{Cntrl}]+)(?:\[(\d+)\])?: ?(.*)$"
)
_STRUCTURED = r"(?s)^(-|(?:\[(?:[^\]\\]|\\.)*\])+)(?: .*)?$"


def _parts(line: Column, pattern: str, groups: int) -> Column:
    """The groups of a pattern that covers the line, from one regex pass; else NULL."""
    joined = F.regexp_replace(
        line, F.lit(pattern), F.lit(_SEP + _SEP.join(f"${i}" for i in range(1, groups + 1)))
    )
    found = F.split(joined, _SEP, groups + 1)
    return F.when(joined.startswith(_SEP) & (F.size(found) == groups + 1), found)


def parse_syslog(df: DataFrame, message: str = "message", *, year: int | None = None) -> DataFrame:
    """Merge the parts of a syslog line over the record; parsed parts win.

    Adds or replaces timestamp, hostname, appname, procid, msgid, version,
    facility, severity, structured_data and message, plus `syslog_ok`. Lines of
    neither format keep their own columns and have `syslog_ok` FALSE. RFC 3164
    lines carry no year: give `year`, or the current one is taken.
    """
    line = F.col(message)
    # A line that begins with the separator itself cannot be told apart: not syslog.
    clean = F.when(~line.startswith(_SEP), line)
    read = df.withColumn("__new", _parts(clean, _RFC5424, 8))
    read = read.withColumn("__sd", F.regexp_extract(F.get("__new", F.lit(8)), _STRUCTURED, 1))
    read = read.withColumn("__new", F.when(F.col("__sd") != "", F.col("__new")))
    # The older format is tried only where the newer one does not fit.
    read = read.withColumn(
        "__old", F.when(F.col("__new").isNull(), _parts(clean, _RFC3164, 6))
    )

    def part(side: str, i: int) -> Column:
        text = F.get(side, F.lit(i))
        return F.when(~text.isin("", "-"), text)

    priority = F.coalesce(part("__new", 1), part("__old", 1)).cast("int")
    years = F.lit(str(year)) if year is not None else F.date_format(F.current_date(), "yyyy")
    stamp = F.coalesce(
        part("__new", 3).try_cast("timestamp"),
        F.try_to_timestamp(
            F.concat(years, F.lit(" "), F.replace(part("__old", 2), F.lit("  "), F.lit(" "))),
            F.lit("yyyy MMM d HH:mm:ss"),
        ),
    )
    facility = F.get(F.array(*map(F.lit, SYSLOG_FACILITIES)), F.floor(priority / 8).cast("int"))
    severity = F.get(F.array(*map(F.lit, SYSLOG_SEVERITIES)), F.pmod(priority, F.lit(8)))
    sd, rest = F.col("__sd"), F.get("__new", F.lit(8))
    parsed = {
        "timestamp": stamp,
        "hostname": F.coalesce(part("__new", 4), part("__old", 3)),
        "appname": F.coalesce(part("__new", 5), part("__old", 4)),
        "procid": F.coalesce(part("__new", 6), part("__old", 5)),
        "msgid": part("__new", 7),
        "version": part("__new", 2).cast("int"),
        "facility": facility,
        "severity": severity,
        "structured_data": F.when(F.col("__new").isNotNull() & (sd != "-"), sd),
        # The free-text part may be empty, and may be a lone dash.
        message: F.coalesce(
            F.substring(rest, F.length(sd) + 2, F.length(rest)), F.get("__old", F.lit(6))
        ),
    }
    merged = {
        name: F.coalesce(value, F.col(name)) if name in df.columns else value
        for name, value in parsed.items()
    }
    ok = F.col("__new").isNotNull() | F.col("__old").isNotNull()
    return read.withColumns({**merged, "syslog_ok": ok}).drop("__new", "__old", "__sd")
