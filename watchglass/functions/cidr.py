"""CIDR tests as SQL expressions."""

from __future__ import annotations

import ipaddress


def ipv4_range_sql(text: str, network: ipaddress.IPv4Network) -> str:
    """`text` (SQL for a string) is an IPv4 address inside the network."""
    # Octets without leading zeros, as the ipaddress module reads them.
    octet = r"(25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9]?[0-9])"
    pattern = "^" + r"\\.".join([octet] * 4) + "$"
    part = f"split({text}, '\\\\.')"
    number = (
        f"try_cast(get({part}, 0) AS BIGINT) * 16777216"
        f" + try_cast(get({part}, 1) AS BIGINT) * 65536"
        f" + try_cast(get({part}, 2) AS BIGINT) * 256"
        f" + try_cast(get({part}, 3) AS BIGINT)"
    )
    lo, hi = int(network.network_address), int(network.broadcast_address)
    return f"({text} RLIKE '{pattern}' AND ({number}) BETWEEN {lo}L AND {hi}L)"


def _ipv6_hex(text: str) -> str:
    """SQL for the 32 hexadecimal digits of an IPv6 address, NULL for anything else."""
    octet = r"(25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9]?[0-9])"
    tail = "^(.*:)" + r"\\.".join([octet] * 4) + "$"
    pair = "lpad(lower(hex(CAST(regexp_extract(t, '{0}', {1}) AS INT) * 256 + CAST(regexp_extract(t, '{0}', {2}) AS INT))), 4, '0')"
    mapped = (
        f"if(t RLIKE '{tail}', concat(regexp_extract(t, '{tail}', 1), {pair.format(tail, 2, 3)}, ':',"
        f" {pair.format(tail, 4, 5)}), t)"
    )
    side = "if(get(h, {0}) = '', CAST(array() AS ARRAY<STRING>), split(get(h, {0}), ':'))"
    left, right = side.format(0), side.format(1)
    zeros = f"(8 - size({left}) - size({right}))"
    groups = (
        f"CASE WHEN size(h) = 1 THEN split(get(h, 0), ':')"
        f" WHEN size(h) = 2 AND {zeros} > 0 THEN concat({left}, array_repeat('0', {zeros}), {right}) END"
    )
    digits = (
        "if(size(g) = 8 AND forall(g, x -> x RLIKE '^[0-9a-f]{1,4}$'),"
        " array_join(transform(g, x -> lpad(x, 4, '0')), ''), NULL)"
    )
    # Each step is bound to a name by a one-element transform.
    steps = f"transform(array(lower({text})), t -> {mapped})"
    steps = f"transform({steps}, t -> split(t, '::'))"
    steps = f"transform({steps}, h -> {groups})"
    return f"get(transform({steps}, g -> {digits}), 0)"


def cidr_sql(text: str, cidr: str) -> str:
    network = ipaddress.ip_network(cidr, strict=False)
    if network.version == 4:
        return ipv4_range_sql(text, network)
    lo, hi = (f"{int(a):032x}" for a in (network.network_address, network.broadcast_address))
    # Digits of equal number sort as their values; only a text with a colon is looked at.
    return f"({text} LIKE '%:%' AND {_ipv6_hex(text)} BETWEEN '{lo}' AND '{hi}')"
