"""Labels, durations and message fragments as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# Largest duration kept exact by floating-point arithmetic; longer bans are clamped to it.
MAX_DURATION = 2**53

# The characters Unicode calls white space.
WHITE_SPACE = (
    "\t\n\v\f\r \u0085\u00a0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006"
    "\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
)

# Protocol labels, ban reasons and log levels shown to people.
PROTOCOL_LABELS = {"doh": "DoH", "dot": "DoT", "doq": "DoQ", "dnscrypt": "DNSCrypt", "": "DNS", "dns": "DNS"}
REASON_LABELS = {
    "dns-flood-watchlist": "DNS-Flood-Watchlist",
    "rate-limit": "Rate-Limit",
    "subdomain-flood": "Subdomain-Flood",
    "external-blocklist": "Externe Blocklist",
    "geoip": "GeoIP",
}
LOG_LEVELS = {"DEBUG": 0, "INFO": 1, "WARN": 2, "ERROR": 3}
LOG_LEVEL_ALIASES = {"": "INFO", "WARNING": "WARN", "ERR": "ERROR"}


def strip(text: Column) -> Column:
    """Trim all Unicode white space, not only blanks."""
    return F.trim(text, F.lit(WHITE_SPACE))


def blank_to(text: Column, default: str) -> Column:
    """Null or all-blank text becomes ``default``; other text is kept as it is."""
    return F.when(F.coalesce(strip(text), F.lit("")) == "", F.lit(default)).otherwise(text)


def _lookup(key: Column, table: dict[str, str], default: Column) -> Column:
    out = F
    for name, label in table.items():
        out = out.when(key == name, F.lit(label))
    return out.otherwise(default)


def protocol_label(proto: Column) -> Column:
    """Mixed-case protocol name for tables; unknown names pass through."""
    return _lookup(F.lower(strip(proto)), PROTOCOL_LABELS, proto)


def protocol_upper(proto: Column) -> Column:
    """Upper-case protocol name for messages; blank and ``-`` read as DNS."""
    name = strip(proto)
    return F.when(name.isin("", "-"), F.lit("DNS")).otherwise(F.upper(name))


def reason_label(reason: Column) -> Column:
    words = F.filter(F.split(reason, "[-_]"), lambda w: w != "")
    spelled = F.array_join(
        F.transform(words, lambda w: F.concat(F.upper(F.substring(w, 1, 1)), F.lower(F.substring(w, 2, 10**9)))), "-")
    return _lookup(
        F.lower(strip(reason)), REASON_LABELS,
        F.when(spelled == "", F.lit("Unbekannt")).otherwise(spelled))


def geo_mode_label(mode: Column) -> Column:
    return F.when(F.lower(strip(mode)) == "allowlist", F.lit("Allowlist")).otherwise(F.lit("Blocklist"))


def duration_for_level(base: int, level: Column, multiplier: int) -> Column:
    """``base * multiplier ** (level - 1)`` from level 2 on, clamped instead of overflowing."""
    factor = F.pow(F.lit(float(max(multiplier, 1))), (level - 1).cast("double"))
    grown = F.least(F.lit(float(base)) * factor, F.lit(float(MAX_DURATION))).cast("long")
    return F.when(level <= 1, F.lit(base).cast("long")).otherwise(grown)


def duration_text(seconds: Column, permanent: Column) -> Column:
    return F.when(permanent | (seconds == 0), F.lit("permanent")).otherwise(
        F.concat(seconds.cast("string"), F.lit("s")))


def duration_label(seconds: Column, permanent: Column) -> Column:
    """Human duration: ``PERMANENT``, ``45s``, ``1h 0m``, ``5m 10s`` or ``5m``."""
    hours = F.floor(seconds / 3600).cast("long").cast("string")
    minutes = F.floor((seconds % 3600) / 60).cast("long").cast("string")
    rest = seconds % 60
    return (
        F.when(permanent | (seconds == 0), F.lit("PERMANENT"))
        .when(seconds < 60, F.concat(seconds.cast("string"), F.lit("s")))
        .when(seconds >= 3600, F.concat(hours, F.lit("h "), minutes, F.lit("m")))
        .when(rest > 0, F.concat(minutes, F.lit("m "), rest.cast("string"), F.lit("s")))
        .otherwise(F.concat(minutes, F.lit("m")))
    )


def detection_window(reason: Column, domain: Column, rate_window: int, subdomain_window: int) -> Column:
    """Seconds of the detector that produced a ban."""
    by_subdomains = (reason == "subdomain-flood") | F.coalesce(domain.startswith("*."), F.lit(False))
    return F.when(by_subdomains, F.lit(subdomain_window)).otherwise(F.lit(rate_window))


def ban_reason_label(count: Column, domain: Column, protocol: Column, reason: Column, window: Column) -> Column:
    counted = (count > 0) & (F.coalesce(strip(domain), F.lit("")) != "") & (domain != "-")
    return F.when(
        counted,
        F.format_string("%dx %s in %ds via %s, %s", count, domain, window,
                        protocol_upper(protocol), reason_label(reason)),
    ).otherwise(reason_label(reason))


def ban_duration_label(seconds: Column, permanent: Column, level: Column, max_level: int) -> Column:
    stage = F.format_string(f" [Stufe %d/{max_level}]", level) if max_level > 0 else F.format_string(" [Stufe %d]", level)
    return F.concat(duration_label(seconds, permanent), F.when(level > 0, stage).otherwise(F.lit("")))


def alert_action(reason: Column, source: Column, domain: Column) -> Column:
    return (
        F.when(reason.startswith("service_") | reason.endswith("-flush"), reason)
        .when((source == "") & (domain == ""), F.lit("unban"))
        .otherwise(F.lit("ban"))
    )


def abuse_check_url(ip: Column) -> Column:
    return F.concat(F.lit("https://www.abuseipdb.com/check/"), ip)


def abuse_comment(count: Column, domain: Column, window: Column, product: str, url: str) -> Column:
    closing = f". Banned by {product} \U0001F517 {url}".replace("%", "%%")
    return F.format_string(f"DNS flooding on our DNS server: %dx %s in %ds{closing}", count, domain, window)


def short_time(value: Column) -> Column:
    """Characters 6 to 16 of a time text (month to minute); shorter text is kept."""
    return F.when(F.length(value) >= 16, F.substring(value, 6, 11)).otherwise(value)


def protocol_class(proto: Column) -> Column:
    name = F.lower(proto)
    head = F.substring(name, 1, 3)
    return F.when(head.isin("dns", "doh", "dot", "doq"), head).otherwise(F.lit(""))


def reason_class(reason: Column) -> Column:
    name = F.lower(reason)
    return (
        F.when(F.contains(name, F.lit("subdomain")), F.lit("subdomain-flood"))
        .when(F.contains(name, F.lit("external")), F.lit("external"))
        .otherwise(F.lit("rate-limit"))
    )


def dash_if_blank(value: Column) -> Column:
    return F.when(F.coalesce(strip(value), F.lit("")).isin("", "-"), F.lit("-")).otherwise(value)


def level_number(name: str, default: str = "INFO") -> int:
    """Numeric severity of a configured level name."""
    key = name.strip().upper()
    key = LOG_LEVEL_ALIASES.get(key, key)
    return LOG_LEVELS.get(key, LOG_LEVELS[default])


def log_line_level(line: Column) -> Column:
    """Severity name of a log line; the most severe tag wins, none means INFO."""
    out = F
    for name in sorted(LOG_LEVELS, key=LOG_LEVELS.get, reverse=True):
        out = out.when(F.contains(line, F.lit(f"[{name}]")), F.lit(name))
    return out.otherwise(F.lit("INFO"))


def until_label(until: Column, permanent: Column) -> Column:
    return F.when(permanent | (until == 0), F.lit("permanent")).otherwise(epoch_text(until))


def epoch_text(epoch: Column) -> Column:
    return F.date_format(F.timestamp_seconds(epoch), "yyyy-MM-dd HH:mm:ss")


def clip(text: Column, limit: int) -> Column:
    """Cut to ``limit`` characters, the last one a ``~``."""
    if limit <= 1:
        return F.substring(text, 1, limit)
    return F.when(F.length(text) > limit, F.concat(F.substring(text, 1, limit - 1), F.lit("~"))).otherwise(text)
