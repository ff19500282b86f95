"""Notification routing: which alerts go to which channels, and how often."""

from __future__ import annotations

from dataclasses import dataclass, field
from typing import Any, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from ..functions.literals import sql_str
from ..plans.local import literal_frame
from .suppress import keep_spaced

# Channel types, route match keys, and seconds between notifications.
CHANNEL_TYPES = ("email", "webhook_tokenauth", "webhook_basicauth", "pagerduty", "sms", "slack")
MATCH_KEYS = ("severity", "rule_name")
RATE_LIMIT_SECONDS = 300


def rule_name(title: Column | str) -> Column:
    """The slug of a rule title."""
    lowered = F.lower(F.trim(F.col(title) if isinstance(title, str) else title))
    return F.regexp_replace(F.regexp_replace(lowered, r"\W+", "_"), "^_+|_+$", "")


@dataclass(frozen=True)
class Channel:
    name: str
    type: str
    labels: dict[str, str] = field(default_factory=dict)


@dataclass(frozen=True)
class Route:
    match: dict[str, str]
    channels: tuple[str, ...]


@dataclass(frozen=True)
class Notifications:
    channels: tuple[Channel, ...]
    routes: tuple[Route, ...]

    @classmethod
    def from_dict(cls, spec: dict[str, Any]) -> "Notifications":
        """Channels by name and the route table over them; raises ValueError for what cannot deliver."""
        by_name: dict[str, Channel] = {}
        for entry in spec.get("channels") or ():
            channel = Channel(str(entry["name"]), str(entry["type"]), dict(entry.get("labels") or {}))
            if channel.type not in CHANNEL_TYPES:
                raise ValueError(f"channel {channel.name!r} is of no known type: {channel.type!r}")
            if by_name.setdefault(channel.name, channel) is not channel:
                raise ValueError(f"two channels are called {channel.name!r}")
        return cls(tuple(by_name.values()), tuple(_route(e, by_name) for e in spec.get("routes") or ()))


def _route(entry: dict[str, Any], by_name: dict[str, Channel]) -> Route:
    """A route that reaches somebody: its alerts go to known channels, one at least."""
    route = Route(dict(entry.get("match") or {}), tuple(entry.get("channels") or ()))
    problems = [
        *(f"unknown channel {c!r}" for c in route.channels if c not in by_name),
        *(f"unknown match key {k!r}" for k in route.match if k not in MATCH_KEYS),
        *([] if route.channels else ["no channel, so its alerts would reach nobody"]),
    ]
    if problems:
        raise ValueError(f"route {entry!r}: {'; '.join(problems)}")
    return route


def routed(alerts: DataFrame, config: Notifications) -> DataFrame:
    """One row per (alert, matching route); a route matches when all its keys do."""
    tests = []
    for i, r in enumerate(config.routes):
        keys = [f"{k} = {sql_str(v)}" for k, v in r.match.items()]
        tests.append(f"CASE WHEN {' AND '.join(keys) or 'TRUE'} THEN {i} END")
    named = alerts if "rule_name" in alerts.columns else alerts.withColumn("rule_name", rule_name("rule_title"))
    return named.selectExpr("*", f"explode(array_compact(array({', '.join(tests)}))) AS route")


def to_channels(routed_alerts: DataFrame, config: Notifications) -> DataFrame:
    """One row per (routed alert, channel), with the channel's type."""
    types = {c.name: c.type for c in config.channels}
    pairs = [(i, c) for i, r in enumerate(config.routes) for c in r.channels]
    table = literal_frame(routed_alerts.sparkSession, {
        "route": (pa.int32(), [i for i, _ in pairs]),
        "channel": (pa.string(), [c for _, c in pairs]),
        "channel_type": (pa.string(), [types[c] for _, c in pairs]),
    })
    return routed_alerts.join(table, "route")


def rate_limited(
    routed_alerts: DataFrame,
    seconds: int = RATE_LIMIT_SECONDS,
    *,
    order: Sequence[str] = ("rule_id",),
) -> DataFrame:
    """At most one notification per route in `seconds`."""
    return keep_spaced(routed_alerts, ["route"], "fired_at", seconds, order=order)
