"""Address arithmetic as SQL text.

IPv4 becomes a BIGINT and IPv6 a 32-digit hex string, so that membership in a
network is a plain range comparison Spark can evaluate (or join on) directly.
"""

from __future__ import annotations

import ipaddress

_OCTET = "(25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
IPV4_STRICT = f"^{_OCTET}\\\\.{_OCTET}\\\\.{_OCTET}\\\\.{_OCTET}$"


def is_ipv4(s: str) -> str:
    return f"({s} RLIKE '{IPV4_STRICT}')"


def ipv4_num(s: str) -> str:
    """BIGINT of a dotted quad, NULL for anything else."""
    parts = [f"CAST(split({s}, '\\\\.')[{i}] AS BIGINT)" for i in range(4)]
    total = f"({parts[0]} * 16777216L + {parts[1]} * 65536L + {parts[2]} * 256L + {parts[3]})"
    return f"CASE WHEN {is_ipv4(s)} THEN {total} END"


def ipv6_hex(s: str) -> str:
    """Full 32-digit lower-case hex of an IPv6 text, NULL when it is not one."""
    tail = f"substring_index({s}, ':', -1)"
    quad = ipv4_num(tail)
    as_groups = (
        f"concat(substr({s}, 1, length({s}) - length({tail})),"
        f" hex(({quad}) DIV 65536L), ':', hex(pmod({quad}, 65536L)))"
    )
    plain = f"lower(CASE WHEN contains({tail}, '.') THEN {as_groups} ELSE {s} END)"

    def side(half: str) -> str:
        return f"CASE WHEN {half} = '' THEN CAST(array() AS ARRAY<STRING>) ELSE split({half}, ':', -1) END"

    def widen(arr: str) -> str:
        return f"array_join(transform({arr}, g -> lpad(g, 4, '0')), '')"

    def good(arr: str) -> str:
        return f"forall({arr}, g -> g RLIKE '^[0-9a-f]{{1,4}}$')"

    body = (
        "CASE WHEN size(h) = 1 AND size(split(h[0], ':', -1)) = 8 AND " + good("split(h[0], ':', -1)") +
        " THEN " + widen("split(h[0], ':', -1)") +
        " WHEN size(h) = 2 THEN element_at(transform(array(struct(" + side("h[0]") + " AS l, " + side("h[1]") +
        " AS r)), p -> CASE WHEN size(p.l) + size(p.r) <= 7 AND " + good("p.l") + " AND " + good("p.r") +
        " THEN concat(" + widen("p.l") + ", repeat('0000', 8 - size(p.l) - size(p.r)), " + widen("p.r") +
        ") END), 1) END"
    )
    return (
        f"CASE WHEN contains({s}, ':') THEN"
        f" element_at(transform(array(split({plain}, '::', -1)), h -> {body}), 1) END"
    )


def _ipv6_pattern() -> str:
    """Every way to write an IPv6 address, built group count by group count."""
    h, v4 = "[0-9A-Fa-f]{1,4}", "\\\\.".join(["(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"] * 4)
    forms = [f"(?:{h}:){{7}}{h}", f"(?:{h}:){{6}}{v4}", f"(?:{h}:){{1,7}}:", f":(?::{h}){{1,7}}", "::"]
    forms += [f"(?:{h}:){{1,{n}}}(?::{h}){{1,{7 - n}}}" for n in range(1, 7)]
    forms += [f"::(?:{h}:){{0,5}}{v4}"]
    forms += [f"(?:{h}:){{1,{n}}}:(?:{h}:){{0,{5 - n}}}{v4}" for n in range(1, 6)]
    return "^(?:" + "|".join(forms) + ")$"


IPV6_STRICT = _ipv6_pattern()


def is_ip(s: str) -> str:
    return f"({is_ipv4(s)} OR (contains({s}, ':') AND {s} RLIKE '{IPV6_STRICT}'))"


def cidr_bounds(cidr: str) -> tuple[int, object, object]:
    """(version, low, high): integers for IPv4, 32-digit hex strings for IPv6."""
    net = ipaddress.ip_network(cidr, strict=False)
    low, high = int(net.network_address), int(net.broadcast_address)
    if net.version == 4:
        return 4, low, high
    return 6, f"{low:032x}", f"{high:032x}"


def in_cidrs(num4: str, hex6: str, cidrs) -> str:
    """BOOLEAN; NULL when the address is not valid (both inputs NULL)."""
    v4, v6 = [], []
    for c in cidrs:
        version, low, high = cidr_bounds(c)
        if version == 4:
            v4.append(f"{num4} BETWEEN {low}L AND {high}L")
        else:
            v6.append(f"{hex6} BETWEEN '{low}' AND '{high}'")
    return (
        f"CASE WHEN {num4} IS NOT NULL THEN {'(' + ' OR '.join(v4) + ')' if v4 else 'false'}"
        f" WHEN {hex6} IS NOT NULL THEN {'(' + ' OR '.join(v6) + ')' if v6 else 'false'} END"
    )
