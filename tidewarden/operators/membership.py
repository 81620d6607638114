"""Allow- and block-list membership."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from tidewarden.operators.networks import matching_networks
from tidewarden.params import Params
from tidewarden.sources.querylog import distinct_clients


def static_whitelist(df: DataFrame, params: Params, column: str = "client") -> DataFrame:
    """Drop rows of the clients named in the configuration."""
    return df.filter(~F.col(column).isin(*params.whitelist)) if params.whitelist else df


def whitelist_exclude(df: DataFrame, whitelist: DataFrame, column: str = "client", match: str = "exact") -> DataFrame:
    """Rows whose client is not allowed.

    ``exact`` compares text, so a network in the list only covers the same text. ``cidr``
    also lets a network cover its addresses.
    """
    listed = whitelist.select(F.col("ip_address").alias(column))
    kept = df.join(listed, column, "left_anti")
    if match == "exact":
        return kept
    covered = matching_networks(distinct_clients(kept.select(F.col(column).alias("client"))),
                                whitelist.select(F.col("ip_address").alias("network")))
    return kept.join(covered.select(F.col("client").alias(column)).distinct(), column, "left_anti")


def not_already_banned(df: DataFrame, bans: DataFrame, column: str = "client") -> DataFrame:
    return df.join(bans.select(F.col("client_ip").alias(column)), column, "left_anti")


def blocklist_new(desired: DataFrame, whitelist: DataFrame, bans: DataFrame) -> DataFrame:
    """Listed addresses that still need a ban."""
    allowed = whitelist_exclude(desired, whitelist, "address")
    return not_already_banned(allowed, bans, "address")


def blocklist_removed(bans: DataFrame, desired: DataFrame) -> DataFrame:
    """Bans that came from a block list and are on none any more."""
    listed = desired.select(F.col("address").alias("client_ip"))
    return bans.filter("source = 'external-blocklist'").join(listed, "client_ip", "left_anti")


def whitelist_hits(bans: DataFrame, whitelist: DataFrame) -> DataFrame:
    """Bans of clients that are allowed by now."""
    return bans.join(whitelist.select(F.col("ip_address").alias("client_ip")), "client_ip", "left_semi")
