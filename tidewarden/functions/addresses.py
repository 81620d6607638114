"""IP address and prefix column expressions.

Addresses become strings of '0' and '1' (32 or 128 characters), so a network test is a
string-prefix test and a longest-prefix match is an equi-join on the leading bits. All of
it is plain column arithmetic; no Python runs per row.
"""

from __future__ import annotations

import ipaddress
from collections.abc import Iterable

from pyspark.sql import Column, functions as F

from tidewarden.functions.binding import let

_OCTET = r"(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9]?[0-9])"
_V4 = rf"{_OCTET}(?:\.{_OCTET}){{3}}"
_GROUP = r"[0-9a-f]{1,4}"
_GROUPS = rf"{_GROUP}(?::{_GROUP})*"
_V6_FULL = rf"^{_GROUP}(?::{_GROUP}){{7}}$"
_V6_SHORT = rf"^(?:{_GROUPS})?::(?:{_GROUPS})?$"

# Networks that are never public. The last one applies to IPv4 only.
PRIVATE_NETWORKS = (
    "10.0.0.0/8", "172.16.0.0/12", "192.168.0.0/16", "127.0.0.0/8", "169.254.0.0/16",
    "0.0.0.0/32", "::1/128", "::/128", "fc00::/7", "fe80::/10", "100.64.0.0/10",
)
# IPv4 networks that stay private when written as ::ffff:a.b.c.d
_MAPPED_PRIVATE = PRIVATE_NETWORKS[:5]
_MAPPED_LEAD = "0" * 80 + "1" * 16


# -- SQL text; arguments are names of columns or of lambda variables ------------------------


def _v4_bits(text: str) -> str:
    return rf"array_join(transform(split({text}, r'\.'), o -> lpad(conv(o, 10, 2), 8, '0')), '')"


def _inline_v4_tail(text: str) -> str:
    """Rewrite a dotted tail (``::ffff:1.2.3.4``) as two hexadecimal groups."""
    hexed = rf"transform(split(regexp_extract({text}, r':({_V4})$', 1), r'\.'), o -> lower(lpad(conv(o, 10, 16), 2, '0')))"
    joined = let(hexed, "h", rf"concat(regexp_extract({text}, r'^(.*:){_V4}$', 1), h[0], h[1], ':', h[2], h[3])")
    return f"CASE WHEN {text} RLIKE r':{_V4}$' THEN {joined} ELSE {text} END"


def _v6_bits(text: str) -> str:
    """Bits of an IPv6 text, null when it is malformed."""

    def groups(part: str) -> str:
        return f"filter(split({part}, ':'), g -> g <> '')"

    eight = (
        f"CASE WHEN p RLIKE r'{_V6_FULL}' THEN split(p, ':') "
        f"WHEN p RLIKE r'{_V6_SHORT}' AND size(l) + size(r) < 8 "
        f"THEN concat(l, array_repeat('0', greatest(8 - size(l) - size(r), 0)), r) END")
    halves = let(groups("substring_index(p, '::', 1)"), "l", let(groups("substring_index(p, '::', -1)"), "r", eight))
    bits = f"array_join(transform({halves}, g -> lpad(conv(g, 16, 2), 16, '0')), '')"
    return let(f"lower({text})", "w", let(_inline_v4_tail("w"), "p", bits))


def _host_bits(host: str) -> str:
    return f"CASE WHEN {host} RLIKE r'^{_V4}$' THEN {_v4_bits(host)} WHEN contains({host}, ':') THEN {_v6_bits(host)} END"


def parse_address_sql(column: str) -> str:
    described = (
        "CASE WHEN b IS NOT NULL AND coalesce(n, length(b)) <= length(b) THEN named_struct("
        "'kind', CASE WHEN n IS NULL THEN 'address' ELSE 'prefix' END, "
        "'family', CASE WHEN length(b) = 32 THEN 4 ELSE 6 END, "
        "'bits', b, 'prefix_len', coalesce(n, length(b))) END")
    host = (
        "CASE WHEN contains(t, '/') THEN regexp_extract(t, r'^([^/%]+)/(?:0|[1-9][0-9]{0,2})$', 1) "
        "WHEN contains(t, ':') THEN regexp_replace(t, '%.+$', '') ELSE t END")
    # only digits reach the cast: a failing one costs more than all the rest
    length = (
        "CASE WHEN t RLIKE r'^[^/%]+/(?:0|[1-9][0-9]{0,2})$' "
        "THEN CAST(regexp_extract(t, r'/([0-9]+)$', 1) AS INT) END")
    return let(column, "t", let(length, "n", let(host, "a", let(_host_bits("a"), "b", described))))


# -- columns --------------------------------------------------------------------------------


def parse_address(column: str) -> Column:
    """``struct(kind, family, bits, prefix_len)`` of a named column; null when its text is
    neither address nor prefix.

    ``kind`` is ``address`` or ``prefix``. Octets with leading zeros, zones on prefixes
    and prefix lengths with signs or leading zeros are refused.
    """
    return F.expr(parse_address_sql(column))


def network_bits(cidr: str) -> str:
    """Leading bits of a network given as Python text, for use as a literal."""
    net = ipaddress.ip_network(cidr)
    return format(int(net.network_address), f"0{net.max_prefixlen}b")[: net.prefixlen]


def _within(bits: str, cidrs: Iterable[str]) -> str:
    tests = []
    for cidr in cidrs:
        width = ipaddress.ip_network(cidr).max_prefixlen
        tests.append(f"(length({bits}) = {width} AND startswith({bits}, '{network_bits(cidr)}'))")
    return " OR ".join(tests)


def is_private(column: str) -> Column:
    """Private, loopback, link-local, unspecified or carrier-grade NAT address.

    A prefix is judged by its own address; text that is neither gives false.
    """
    mapped = let("substring(b, 97, 32)", "m", _within("m", _MAPPED_PRIVATE))
    hit = f"{_within('b', PRIVATE_NETWORKS)} OR (startswith(b, '{_MAPPED_LEAD}') AND {mapped})"
    return F.expr(f"coalesce({let(parse_address_sql(column) + '.bits', 'b', hit)}, false)")


def is_unspecified(column: str) -> Column:
    return F.expr(f"coalesce(NOT contains({parse_address_sql(column)}.bits, '1'), false)")
