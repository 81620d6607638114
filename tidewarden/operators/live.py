"""The live view: top talkers, recent rows and counters."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, functions as F

from tidewarden.functions.text import (
    LOG_LEVELS, clip, level_number, log_line_level, protocol_label, until_label,
)
from tidewarden.operators.bans import active_bans_list
from tidewarden.operators.detect import in_window, subdomain_queries
from tidewarden.params import Params


def _protocol_names() -> Column:
    return F.array_join(F.array_sort(F.collect_set(F.nullif(F.col("label"), F.lit("")))), ",").alias("protocol")


def _top(groups: DataFrame, limit: int) -> DataFrame:
    """Largest first; equal counts by the text ``client|domain``."""
    return groups.orderBy(F.desc("n"), F.concat_ws("|", "client", "domain")).limit(limit)


def live_top_pairs(events: DataFrame, params: Params, as_of: datetime, limit: int = 10) -> DataFrame:
    """Busiest (client, domain) pairs with the protocols they used."""
    per_label = in_window(events, params.rate_limit_window, as_of).groupBy(
        "client", "domain", protocol_label(F.col("protocol")).alias("label")).agg(F.count("*").alias("n"))
    return _top(per_label.groupBy("client", "domain").agg(F.sum("n").alias("n"), _protocol_names()), limit)


def live_top_subdomain_groups(events: DataFrame, params: Params, as_of: datetime, limit: int = 10) -> DataFrame:
    """Clients with most distinct names below one base domain.

    Names are made distinct first. A name asked over several protocols counts once: it is
    counted with the smallest of its labels only.
    """
    names = subdomain_queries(in_window(events, params.subdomain_flood_window, as_of)).select(
        "client", F.col("base").alias("parent"), "domain", protocol_label(F.col("protocol")).alias("label")).distinct()
    first = names.groupBy("client", "parent", "domain").agg(F.min("label").alias("counted"))
    per_label = names.groupBy("client", "parent", "label").agg(F.lit(0).cast("long").alias("n")).unionByName(
        first.groupBy("client", "parent", F.col("counted").alias("label")).agg(F.count("*").alias("n")))
    return _top(per_label.groupBy("client", F.col("parent").alias("domain")).agg(
        F.sum("n").alias("n"), _protocol_names()), limit)


def live_recent_queries(events: DataFrame, limit: int = 12) -> DataFrame:
    """Newest queries; equal times by nanosecond, client and domain."""
    return events.orderBy(F.desc("at"), F.desc("at_ns"), "client", "domain", "protocol").limit(limit).select(
        "at", clip(F.col("client"), 39).alias("client"), protocol_label(F.col("protocol")).alias("protocol"),
        clip(F.col("domain"), 44).alias("domain"))


def live_active_bans(bans: DataFrame, limit: int = 10, newest: str = "ban_time") -> DataFrame:
    """Newest bans with the number of those not shown."""
    total = bans.agg(F.count("*")).scalar()
    return active_bans_list(bans, newest).limit(limit).select(
        "client_ip", clip(F.col("source"), 20).alias("source"), clip(F.col("reason"), 18).alias("reason"),
        until_label(F.col("ban_until_epoch"), F.col("is_permanent")).alias("until"),
        F.greatest(total - F.lit(limit), F.lit(0)).alias("more"))


def live_counters(items: DataFrame, bans: DataFrame, offenses: DataFrame, whitelist: DataFrame,
                  params: Params, now: int) -> DataFrame:
    """One row with the numbers of the status line."""
    old = F.col("last_offense_epoch") <= now - params.progressive_reset_after
    return items.agg(F.count("*").alias("log_rows")).select(
        "log_rows",
        offenses.agg(F.count("*")).scalar().alias("offenses"),
        offenses.agg(F.count_if(old)).scalar().alias("expired_offenses"),
        whitelist.agg(F.count("*")).scalar().alias("whitelist_size"),
        bans.agg(F.count("*")).scalar().alias("active_bans"),
        bans.agg(F.count_if(F.col("source") == "external-blocklist")).scalar().alias("blocklist_bans"),
        bans.agg(F.count_if(F.col("reason") == "geoip")).scalar().alias("geoip_bans"))


def recent_log_lines(lines: DataFrame, min_level: str = "INFO", limit: int = 12,
                     order: tuple[str, ...] = ("file", "line_no")) -> DataFrame:
    """The last ``limit`` lines of at least ``min_level``, oldest first; ``off`` gives none."""
    if min_level.strip().lower() == "off" or limit <= 0:
        return lines.filter("false")
    floor = level_number(min_level)
    loud = [name for name, number in LOG_LEVELS.items() if number >= floor]
    kept = lines.filter(log_line_level(F.col("line")).isin(*loud))
    return kept.orderBy(*[F.desc(c) for c in order]).limit(limit).orderBy(*order)
