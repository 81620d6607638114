"""Alert outbox: the messages to send, as rows. Delivery happens elsewhere."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from tidewarden.functions.text import (
    abuse_check_url, abuse_comment, alert_action, ban_duration_label, ban_reason_label, detection_window,
    duration_label, geo_mode_label, reason_label,
)
from tidewarden.params import Params

TITLE_MARK = "\U0001F6E1️"
UNKNOWN_HOST = "(unbekannt)"


def _lines(*parts: Column | str) -> Column:
    """Join by line breaks, leaving out nulls."""
    return F.concat_ws("\n", *[F.lit(p) if isinstance(p, str) else p for p in parts])


def _labelled(label: str, value: Column) -> Column:
    return F.concat(F.lit(f"{label}: "), value)


def _window(params: Params) -> Column:
    return detection_window(F.col("reason"), F.col("domain"), params.rate_limit_window, params.subdomain_flood_window)


def abuse_wanted(params: Params) -> Column:
    """Only permanent bans of the monitor are worth a public report."""
    return F.lit(params.abuse_enabled) & (F.col("source") == "monitor") & F.col("is_permanent")


def _host_name(df: DataFrame) -> Column:
    return F.coalesce("host_name", F.lit(UNKNOWN_HOST)) if "host_name" in df.columns else F.lit(UNKNOWN_HOST)


def _ban_message(df: DataFrame, params: Params) -> Column:
    url = _labelled("AbuseIPDB", abuse_check_url(F.col("client_ip")))
    ip = _labelled("IP", F.col("client_ip"))
    country = _lines(
        f"\U0001F30D {params.product_name} GeoIP-Sperre auf {params.host_name}", "---", ip,
        _labelled("Land", F.coalesce("geoip_country", F.lit(""))), _labelled("Modus", geo_mode_label(F.col("geoip_mode"))),
        _labelled("Dauer", duration_label(F.col("ban_duration"), F.col("is_permanent"))), "", url)
    other = _lines(
        f"\U0001F6AB {params.product_name} Ban auf {params.host_name}",
        F.when(abuse_wanted(params), F.lit("⚠️ IP wurde an AbuseIPDB gemeldet")), "---", ip,
        _labelled("Hostname", _host_name(df)),
        _labelled("Grund", ban_reason_label(
            F.col("count"), F.col("domain"), F.col("protocol"), F.col("reason"), _window(params))),
        _labelled("Dauer", ban_duration_label(
            F.col("ban_duration"), F.col("is_permanent"), F.col("offense_level"), params.progressive_max_level)),
        "", url)
    return F.when(F.col("source") == "geoip", country).otherwise(other)


def payload(title: Column, message: Column, client: Column, action: Column, kind: str) -> Column:
    """Request body of a channel as JSON; null for an unknown channel."""
    both = F.concat_ws("\n\n", title, message)
    shapes = {
        "discord": [both.alias("content")],
        "slack": [both.alias("text")],
        "generic": [title.alias("title"), message.alias("message"), client.alias("client"), action.alias("action")],
        "gotify": [title.alias("title"), message.alias("message"), F.lit("5").alias("priority")],
        "ntfy": [title.alias("title"), message.alias("message")],
    }
    fields = shapes.get(kind)
    return F.to_json(F.struct(*fields)) if fields else F.lit(None).cast("string")


def _outgoing(rows: DataFrame, params: Params) -> DataFrame:
    title = F.lit(f"{TITLE_MARK} {params.product_name}")
    out = rows.withColumn("title", title).withColumn(
        "payload", payload(title, F.col("message"), F.col("client_ip"), F.col("action"), params.notify_type))
    return out.filter(F.lit(params.notify_enabled))


def ban_alerts(bans: DataFrame, params: Params) -> DataFrame:
    """One alert per new ban, unless its source is muted."""
    muted = ([] if params.geoip_notify else ["geoip"]) + ([] if params.blocklist_notify else ["external-blocklist"])
    heard = bans.filter(~F.col("source").isin(*muted)) if muted else bans
    action = alert_action(F.col("reason"), F.col("source"), F.col("domain"))
    return _outgoing(heard.select("client_ip", action.alias("action"), _ban_message(heard, params).alias("message")), params)


def unban_alerts(history: DataFrame, params: Params) -> DataFrame:
    """One alert per UNBAN row of whatever origin; flushes are summed up instead."""
    single = history.filter("action = 'UNBAN'").filter(~F.col("reason").endswith("-flush"))
    message = _lines(
        f"✅ {params.product_name} Freigabe auf {params.host_name}", "---",
        _labelled("IP", F.col("client_ip")), _labelled("Hostname", _host_name(single)), "",
        _labelled("AbuseIPDB", abuse_check_url(F.col("client_ip"))))
    return _outgoing(single.select("client_ip", F.lit("unban").alias("action"), message.alias("message")), params)


def flush_alerts(history: DataFrame, params: Params) -> DataFrame:
    """One alert per kind of flush, with the number of lifted bans."""
    flushed = history.filter("action = 'UNBAN'").filter(F.col("reason").endswith("-flush")).groupBy("reason").agg(
        F.count("*").alias("n"))
    message = _lines(
        f"✅ {params.product_name} Bulk-Freigabe auf {params.host_name}", "---",
        _labelled("Freigegebene IPs", F.col("n").cast("string")), _labelled("Aktion", reason_label(F.col("reason"))))
    return _outgoing(flushed.select(F.lit("").alias("client_ip"), F.col("reason").alias("action"), message.alias("message")), params)


def alert_outbox(bans: DataFrame, history: DataFrame, params: Params) -> DataFrame:
    """Alerts for new ``bans`` and for the UNBAN rows of ``history``."""
    return ban_alerts(bans, params).unionByName(unban_alerts(history, params)).unionByName(flush_alerts(history, params))


def abuse_candidates(bans: DataFrame, params: Params) -> DataFrame:
    """Public abuse reports to file: address, categories and comment."""
    return bans.filter(abuse_wanted(params)).select(
        F.col("client_ip").alias("ip"), F.lit(params.abuse_categories).alias("categories"),
        abuse_comment(F.col("count"), F.col("domain"), _window(params), params.product_name, params.project_url).alias("comment"))
