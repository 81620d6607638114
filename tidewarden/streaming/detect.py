"""Detection on a live query log.

The stream drops late rows by the watermark, removes repeats from overlapping reads, and
counts in the same hopping windows as the batch tick jobs.
"""

from __future__ import annotations

from math import gcd

from pyspark.sql import DataFrame, functions as F

from tidewarden.operators.detect import flood_verdict, rate_verdict, subdomain_queries
from tidewarden.params import Params
from tidewarden.sources.querylog import EVENT_KEY, normalize_queries


def stream_events(items: DataFrame, params: Params) -> DataFrame:
    """Normalised, watermarked and deduplicated events of a stream of log items."""
    delay = f"{params.retention} seconds"
    return normalize_queries(items).withWatermark("at", delay).dropDuplicatesWithinWatermark(EVENT_KEY)


def _pane(window: int, params: Params):
    return F.window("at", f"{gcd(window, params.check_interval)} seconds").alias("pane")


def _hops(window: int, params: Params):
    """Windows of the evaluation grid that hold a closed pane."""
    return F.window(F.window_time("pane"), f"{window} seconds", f"{params.check_interval} seconds").alias("tick")


def stream_rate_limit_ticks(events: DataFrame, params: Params) -> DataFrame:
    """Rate violations per closed window; append mode emits a window once it is final.

    Queries are counted once per pane, the longest step that divides both window and grid. Closed panes, not
    queries, are copied into the windows that overlap them.
    """
    panes = events.groupBy(_pane(params.rate_limit_window, params), "client", "domain").agg(
        F.count("*").alias("n"), F.max(F.struct("at", "at_ns", "protocol")).alias("last"))
    counted = panes.groupBy(_hops(params.rate_limit_window, params), "client", "domain").agg(
        F.sum("n").alias("n"), F.max("last").alias("last"))
    hits = counted.filter(F.col("n") > params.rate_limit_max_requests)
    return rate_verdict(hits.withColumn("at", F.col("tick.end")).withColumn("protocol", F.col("last.protocol")), params)


def stream_subdomain_flood_ticks(events: DataFrame, params: Params) -> DataFrame:
    """Distinct-name violations per closed window.

    Distinct aggregates do not run on streams, and a set per key would grow with it. The
    names are therefore made distinct per pane, then per window, and counted last, so that
    state is spread over names and a name asked often is copied into windows once per pane.
    """
    window = params.subdomain_flood_window
    asked = subdomain_queries(events.select("at", "client", "domain"))
    panes = asked.groupBy(_pane(window, params), "client", "base", "domain").agg(F.count("*").alias("asked"))
    names = panes.groupBy(_hops(window, params), "client", "base", "domain").agg(F.sum("asked").alias("asked"))
    counted = names.groupBy("tick", "client", "base").agg(F.count("*").alias("n"))
    hits = counted.filter(F.col("n") > params.subdomain_flood_max_unique).withColumn("at", F.col("tick.end"))
    return flood_verdict(hits, params)
