"""Country policy."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, functions as F

from tidewarden.functions.addresses import is_private
from tidewarden.functions.times import instant
from tidewarden.operators.membership import not_already_banned, static_whitelist, whitelist_exclude
from tidewarden.operators.networks import matching_networks
from tidewarden.params import Params
from tidewarden.sources.querylog import distinct_clients
from tidewarden.sources.tables import upsert


def should_block(country: Column, params: Params) -> Column:
    """Policy verdict; unknown countries and an empty policy never block."""
    if not params.geoip_countries:
        return F.lit(False)
    listed = F.upper(country).isin(*params.geoip_countries)
    verdict = ~listed if params.geoip_mode.lower() == "allowlist" else listed
    return F.when(F.coalesce(country, F.lit("")) == "", F.lit(False)).otherwise(verdict)


def geo_lookup(clients: DataFrame, ranges: DataFrame) -> DataFrame:
    """Country of every distinct client, '' when no range covers it.

    The most specific range decides, even when it names no country at all.
    """
    iso = F.coalesce(F.nullif(F.col("country_iso"), F.lit("")), F.col("registered_iso"), F.lit(""))
    named = ranges.groupBy("network").agg(F.max(F.upper(iso)).alias("country"))
    distinct = distinct_clients(clients)
    best = matching_networks(distinct, named).groupBy("client").agg(
        F.max_by("country", "prefix_len").alias("country"))
    return distinct.join(best, "client", "left").fillna("", subset=["country"])


def geo_public_clients(clients: DataFrame, params: Params) -> DataFrame:
    return clients.filter(~is_private("client")) if params.geoip_skip_private else clients


def _geo_detections(located: DataFrame, params: Params, as_of: datetime) -> DataFrame:
    return located.filter(should_block(F.col("country"), params)).select(
        instant(as_of).alias("at"), "client", F.concat(F.lit("GeoIP:"), F.col("country")).alias("target"),
        F.lit(0).cast("long").alias("n"), F.lit("-").alias("protocol"), F.lit("geoip").alias("reason"),
        F.lit("geoip").alias("source"), F.lit(True).alias("permanent"), "country")


def geo_detect(events: DataFrame, ranges: DataFrame, whitelist: DataFrame, bans: DataFrame,
               params: Params, as_of: datetime) -> DataFrame:
    """Permanent detections for clients from blocked countries.

    Each client is judged once; its addresses are made distinct before anything is joined.
    """
    clients = geo_public_clients(distinct_clients(events), params)
    open_ = not_already_banned(whitelist_exclude(static_whitelist(clients, params), whitelist), bans)
    return _geo_detections(geo_lookup(open_, ranges), params, as_of)


def geo_cache_valid(cache: DataFrame, params: Params, now: int, db_mtime: int) -> DataFrame:
    return cache.filter(
        (F.col("looked_up_at_epoch") >= now - params.geoip_cache_ttl)
        & ((F.col("db_mtime") == db_mtime) | (F.col("db_mtime") == 0)))


def geo_cached_lookup(clients: DataFrame, cache: DataFrame, ranges: DataFrame, params: Params,
                      now: int, db_mtime: int) -> DataFrame:
    """``client, country, cached``: a valid cache row wins, the ranges answer the rest."""
    valid = geo_cache_valid(cache, params, now, db_mtime).select(
        F.col("ip").alias("client"), F.col("country_code").alias("country"))
    distinct = distinct_clients(clients)
    known = distinct.join(valid, "client").withColumn("cached", F.lit(True))
    missing = distinct.join(valid, "client", "left_anti")
    return known.unionByName(geo_lookup(missing, ranges).withColumn("cached", F.lit(False)))


def geo_cache_refresh(clients: DataFrame, cache: DataFrame, ranges: DataFrame, params: Params,
                      now: int, db_mtime: int) -> DataFrame:
    """The cache after looking up ``clients``: found countries replace stale rows."""
    found = geo_cached_lookup(clients, cache, ranges, params, now, db_mtime).filter(
        "NOT cached AND country <> ''").select(
        F.col("client").alias("ip"), F.col("country").alias("country_code"),
        F.lit(now).cast("long").alias("looked_up_at_epoch"), F.lit(db_mtime).cast("long").alias("db_mtime"))
    return upsert(cache, found, ["ip"])


def geo_cache_clear(cache: DataFrame) -> DataFrame:
    return cache.filter("false")


def geo_auto_unban(bans: DataFrame, params: Params) -> DataFrame:
    """Country bans the present policy would not set."""
    mode, country = F.coalesce("geoip_mode", F.lit("")), F.coalesce("geoip_country", F.lit(""))
    stale = F.lit(True) if not params.geoip_enabled else (
        ((mode != "") & (mode != params.geoip_mode))
        | ((country != "") & ~should_block(country, params)))
    return bans.filter(F.col("reason") == "geoip").filter(stale)
