import ipaddress

import pytest
from pyspark.sql import functions as F

from tests.helpers import values
from tidewarden.functions import addresses, domains, text
from tidewarden.params import Params

C = F.col


def one_column(spark, inputs, column, ddl="a string"):
    got = values(spark, [(i,) for i in inputs], ddl, a=C("a"), x=column)
    return dict(got)


def test_base_domain(spark):
    want = {
        "a.b.example.com": "example.com", "a.b.example.co.uk": "example.co.uk", "espn.go.com": "espn.go.com",
        "go.com": "go.com", "localhost": "", "co.uk": "co.uk", "a..com": ".com", "x.com.info": "com.info",
        "x.co.рф": "co.рф", "x.co.ф": "x.co.ф", "": "", "x.": "x.", "example.com": "example.com", "x.org.name": "org.name",
    }
    assert one_column(spark, want, domains.base_domain(C("a"))) == want


def test_below_base_domain_agrees_with_base(spark):
    names = ["a.b.example.com", "example.com", "www.example.com", "espn.go.com", "a.espn.go.com", "localhost", "", "a..com", "x.co.uk", "y.x.co.uk"]
    got = values(spark, [(n,) for n in names], "a string", base=domains.base_domain(C("a")), a=C("a"), below=domains.below_base_domain(C("a")))
    assert all(below == (base != "" and base != a) for base, a, below in got)


def test_watchlist(spark):
    listed = domains.watchlisted(C("a"), [" .Microsoft.com ", "x.org"])
    want = {"microsoft.com": True, "login.microsoft.com": True, "evil-microsoft.com": False, "microsoft.com.evil.net": False, "x.org": True}
    assert one_column(spark, want, listed) == want
    off = domains.watchlisted(C("a"), ["x.org"], enabled=False)
    assert one_column(spark, ["x.org"], off) == {"x.org": False}


def test_parent_names(spark):
    assert one_column(spark, ["a.b.c"], domains.parent_names(C("a"))) == {"a.b.c": ["a.b.c", "b.c", "c"]}


def test_hostname(spark):
    want = {"a.b": True, "single": True, "a..b": False, "": False, "a/b": False, "a:b": False, "x" * 63: True, "x" * 64: False,
            ".".join(["x" * 50] * 5): False, "ä" * 32: False}
    assert one_column(spark, want, domains.is_hostname(C("a"))) == want


ADDRESSES = [
    "1.2.3.4", "1.2.3.4/24", "1.2.3.4/33", "256.1.1.1", "1.2.3", "::1", "::", "fd00::1", "fe80::/10", "2001:db8::/32",
    "1:2:3:4:5:6:7:8", "1:2:3:4:5:6:7::", "1::2:3:4:5:6:7:8", "::ffff:1.2.3.4", "1:2:3:4:5:6:1.2.3.4", ":::", "1::2::3",
    "12345::", "g::1", "", "a.b", "2001:db8::1/129", "/24", "::/0", "01.2.3.4", "ABCD::Ef",
]


def test_parse_address_agrees_with_the_standard_library(spark):
    got = one_column(spark, ADDRESSES, addresses.parse_address("a"))
    for written, parsed in got.items():
        try:
            ref = ipaddress.ip_interface(written)
        except ValueError:
            assert parsed is None, written
            continue
        assert parsed.bits == format(int(ref.ip), f"0{ref.max_prefixlen}b"), written
        assert parsed.family == ref.version
        assert parsed.kind == ("prefix" if "/" in written else "address")
        assert parsed.prefix_len == (ref.network.prefixlen if "/" in written else ref.max_prefixlen)


def test_parse_address_is_stricter_than_the_standard_library(spark):
    refused = ["1.2.3.4/08", "1.2.3.4/+8", "fe80::1%", "1.2.3.4%x", "2001:db8::%e/64", "1.2.3.4/255.255.255.0"]
    assert set(one_column(spark, refused, addresses.parse_address("a")).values()) == {None}
    assert one_column(spark, ["fe80::1%eth0"], addresses.parse_address("a"))["fe80::1%eth0"].kind == "address"


def test_private(spark):
    private = ["127.0.0.1", "192.168.1.10", "10.1.2.3", "100.64.0.1", "100.127.255.255", "::1", "fd00::1", "fe80::1", "0.0.0.0", "::",
               "172.16.0.1", "172.31.255.255", "169.254.9.9", "10.0.0.0/8", "::ffff:10.0.0.1"]
    public = ["8.8.8.8", "100.63.255.255", "100.128.0.0", "172.15.0.1", "172.32.0.1", "2001:db8::1", "not an ip", "", "0.0.0.1", "::ffff:8.8.8.8",
              "::ffff:100.64.0.1"]
    got = one_column(spark, private + public, addresses.is_private("a"))
    assert [a for a in private if not got[a]] == []
    assert [a for a in public if got[a]] == []


def test_protocols_and_reasons(spark):
    label = {"doh": "DoH", " DoT ": "DoT", "doq": "DoQ", "dnscrypt": "DNSCrypt", "": "DNS", "dns": "DNS", "Odd": "Odd"}
    assert one_column(spark, label, text.protocol_label(C("a"))) == label
    upper = {"": "DNS", "-": "DNS", "doh": "DOH"}
    assert one_column(spark, upper, text.protocol_upper(C("a"))) == upper
    reason = {"dns-flood-watchlist": "DNS-Flood-Watchlist", "rate-limit": "Rate-Limit", "subdomain-flood": "Subdomain-Flood",
              "external-blocklist": "Externe Blocklist", "geoip": "GeoIP", "manual_FLUSH": "Manual-Flush", "": "Unbekannt", "--": "Unbekannt"}
    assert one_column(spark, reason, text.reason_label(C("a"))) == reason
    assert one_column(spark, ["allowlist", "x"], text.geo_mode_label(C("a"))) == {"allowlist": "Allowlist", "x": "Blocklist"}


def test_durations(spark):
    want = {0: "PERMANENT", 45: "45s", 60: "1m", 310: "5m 10s", 3600: "1h 0m", 7325: "2h 2m"}
    assert one_column(spark, want, text.duration_label(C("a"), F.lit(False)), "a long") == want
    plain = {0: "permanent", 3600: "3600s"}
    assert one_column(spark, plain, text.duration_text(C("a"), F.lit(False)), "a long") == plain
    levels = {0: 100, 1: 100, 2: 200, 5: 1600, 1000: text.MAX_DURATION}
    assert one_column(spark, levels, text.duration_for_level(100, C("a"), 2), "a int") == levels
    flat = {1: 100, 3: 100}
    assert one_column(spark, flat, text.duration_for_level(100, C("a"), 0), "a int") == flat


def test_ban_messages(spark):
    p = Params(rate_limit_window=60, subdomain_flood_window=120, progressive_max_level=3)
    window = text.detection_window(C("reason"), C("domain"), p.rate_limit_window, p.subdomain_flood_window)
    ddl = "count int, domain string, protocol string, reason string, seconds long, permanent boolean, level int"
    got = values(
        spark,
        [(110, "abb.com", "dns", "rate-limit", 3600, False, 1), (60, "*.abb.com", "-", "dns-flood-watchlist", 0, True, 3),
         (0, "abb.com", "dns", "manual", 30, False, 0), (5, "-", "dns", "subdomain-flood", 30, False, 0)], ddl,
        reason=text.ban_reason_label(C("count"), C("domain"), C("protocol"), C("reason"), window),
        length=text.ban_duration_label(C("seconds"), C("permanent"), C("level"), 3),
        comment=text.abuse_comment(C("count"), C("domain"), window, "DNS Guard", "https://x.invalid/100%"))
    assert got == [
        ("110x abb.com in 60s via DNS, Rate-Limit", "1h 0m [Stufe 1/3]", "DNS flooding on our DNS server: 110x abb.com in 60s. Banned by DNS Guard 🔗 https://x.invalid/100%"),
        ("60x *.abb.com in 120s via DNS, DNS-Flood-Watchlist", "PERMANENT [Stufe 3/3]", "DNS flooding on our DNS server: 60x *.abb.com in 120s. Banned by DNS Guard 🔗 https://x.invalid/100%"),
        ("Manual", "30s", "DNS flooding on our DNS server: 0x abb.com in 60s. Banned by DNS Guard 🔗 https://x.invalid/100%"),
        ("Subdomain-Flood", "30s", "DNS flooding on our DNS server: 5x - in 120s. Banned by DNS Guard 🔗 https://x.invalid/100%"),
    ]


def test_alert_action(spark):
    got = values(spark, [("service_start", "service", ""), ("manual-flush", "", ""), ("manual", "", ""), ("manual", "manual", "manual")],
                 "reason string, source string, domain string", x=text.alert_action(C("reason"), C("source"), C("domain")))
    assert [g[0] for g in got] == ["service_start", "manual-flush", "unban", "ban"]


def test_report_helpers(spark):
    assert one_column(spark, ["2024-05-06 07:08:09", "short"], text.short_time(C("a"))) == {"2024-05-06 07:08:09": "05-06 07:08", "short": "short"}
    assert one_column(spark, ["DNScrypt", "DoH", "x"], text.protocol_class(C("a"))) == {"DNScrypt": "dns", "DoH": "doh", "x": ""}
    assert one_column(spark, ["Subdomain-Flood", "external-x", "geoip"], text.reason_class(C("a"))) == {
        "Subdomain-Flood": "subdomain-flood", "external-x": "external", "geoip": "rate-limit"}
    assert one_column(spark, [" ", "-", "x"], text.dash_if_blank(C("a"))) == {" ": "-", "-": "-", "x": "x"}
    assert one_column(spark, ["abcdef", "abc"], text.clip(C("a"), 4)) == {"abcdef": "abc~", "abc": "abc"}
    assert one_column(spark, ["  x "], text.strip(C("a"))) == {"  x ": "x"}


def test_log_levels(spark):
    lines = {"x [ERROR] [WARN]": "ERROR", "[WARN] x": "WARN", "[DEBUG] [INFO]": "INFO", "[DEBUG] x": "DEBUG", "bare": "INFO"}
    assert one_column(spark, lines, text.log_line_level(C("a"))) == lines
    names = {"debug": 0, "": 1, " warning ": 2, "ERR": 3, "odd": 1}
    assert {n: text.level_number(n) for n in names} == names


@pytest.mark.parametrize("epoch,permanent,want", [(0, False, "permanent"), (5, True, "permanent"), (1700000000, False, "2023-11-14 22:13:20")])
def test_until_label(spark, epoch, permanent, want):
    got = values(spark, [(epoch, permanent)], "u long, p boolean", x=text.until_label(C("u"), C("p")))
    assert got == [(want,)]
