"""Flood detectors: request rate per (client, domain), distinct names per (client, base domain).

Each comes in three forms with one meaning: at a single evaluation time (snapshot), at
the time of every query (trailing), and on the regular evaluation grid (ticks). A window
is closed on both sides for the first two and ``[start, end)`` for ticks.
"""

from __future__ import annotations

from datetime import datetime, timedelta
from math import gcd

from pyspark.sql import Column, DataFrame, Window, functions as F

from tidewarden.functions.domains import base_domain, below_base_domain, parent_names, watchlisted
from tidewarden.functions.text import strip
from tidewarden.functions.times import instant
from tidewarden.operators.slices import SECOND, running_count, slice_seconds, slice_start
from tidewarden.params import Params
from tidewarden.sources.querylog import nanos_since
from tidewarden.sources.tables import prune_days

RATE, FLOOD, WATCHLIST = "rate-limit", "subdomain-flood", "dns-flood-watchlist"
DETECTION_COLUMNS = ["at", "client", "target", "n", "protocol", "reason", "source", "permanent"]


def _verdict(hits: DataFrame, name: Column, target: Column, reason: str, params: Params) -> DataFrame:
    """Detection rows; a watch-listed name turns any violation into a permanent one."""
    listed = watchlisted(name, params.watchlist, params.watchlist_enabled)
    return hits.select(
        "at", "client", target.alias("target"), F.col("n").cast("long").alias("n"), "protocol",
        F.when(listed, F.lit(WATCHLIST)).otherwise(F.lit(reason)).alias("reason"),
        F.lit("monitor").alias("source"), listed.alias("permanent"),
    )


def rate_verdict(hits: DataFrame, params: Params) -> DataFrame:
    return _verdict(hits, F.col("domain"), F.col("domain"), RATE, params)


def flood_verdict(hits: DataFrame, params: Params) -> DataFrame:
    target = F.concat(F.lit("*."), F.col("base"))
    return _verdict(hits.withColumn("protocol", F.lit("dns")), F.col("base"), target, FLOOD, params)


def in_window(events: DataFrame, window: int, as_of: datetime) -> DataFrame:
    """Events from ``as_of - window`` to ``as_of``, both included."""
    first, last = instant(as_of - timedelta(seconds=window)), instant(as_of)
    return prune_days(events.filter(F.col("at").between(first, last)), first, last)


def subdomain_queries(events: DataFrame) -> DataFrame:
    """Queries for a name below its base domain, with that ``base``."""
    return events.filter(below_base_domain(F.col("domain"))).withColumn("base", base_domain(F.col("domain")))


# -- request rate ---------------------------------------------------------------------------


def rate_limit_snapshot(events: DataFrame, params: Params, as_of: datetime) -> DataFrame:
    """(client, domain) pairs with more than the allowed queries in the last window.

    Counting per protocol first keeps the big aggregation on numbers; the protocol of the
    latest query is then chosen among one row per protocol.
    """
    per_protocol = in_window(events, params.rate_limit_window, as_of).groupBy(
        "client", "domain", "protocol").agg(
        F.count("*").alias("n"), F.max(nanos_since(F.col("at"), F.col("at_ns"), F.unix_micros(instant(as_of)))).alias("last"))
    hits = per_protocol.groupBy("client", "domain").agg(
        F.sum("n").alias("n"), F.max_by("protocol", F.struct("last", "protocol")).alias("protocol"),
    ).filter(F.col("n") > params.rate_limit_max_requests).withColumn("at", instant(as_of))
    return rate_verdict(hits, params)


def trailing_counts(events: DataFrame, keys: list[str], window: int, limit: int, params: Params) -> DataFrame:
    """Every event with more than ``limit`` events of its key in the window that ends at it.

    Counts per (key, slice) come first. They bound the trailing count of a slice from
    above, so only slices that can exceed the limit go on, each with the count of the
    slices that lie wholly inside its windows. Their events, and the events that leave
    their windows, then give the exact count by one running sum per slice, or per cell where
    a slice has more than ``max_slice_rows`` rows.
    """
    width = slice_seconds(window, params.max_slice_seconds) * SECOND
    span = window * SECOND
    at_us = F.unix_micros("at")
    counts = events.groupBy(*keys, slice_start(at_us, width).alias("slice")).agg(F.count("*").alias("c"))
    along = Window.partitionBy(*keys).orderBy("slice")
    inside, leaving = along.rangeBetween(-span, -width), along.rangeBetween(-span, -span)
    busy = counts.withColumn("before", F.coalesce(F.sum("c").over(inside), F.lit(0))).withColumn(
        "dense", F.col("c") + F.coalesce(F.sum("c").over(leaving), F.lit(0)) > params.max_slice_rows).filter(
        F.col("before") + F.col("c") > limit).drop("c")

    own = slice_start(at_us, width)
    moves = F.array(
        F.struct(own.alias("slice"), (at_us * 2).alias("ord"), F.lit(1).alias("delta")),
        F.struct((own + span).alias("slice"), ((at_us + span) * 2 + 1).alias("ord"), F.lit(-1).alias("delta")),
    )
    rows = events.select("*", F.inline(moves)).join(busy, [*keys, "slice"])
    return running_count(rows, keys, width).filter(
        (F.col("delta") == 1) & (F.col("n") > limit)).drop("slice", "ord", "delta", "before")


def rate_limit_trailing(events: DataFrame, params: Params) -> DataFrame:
    """One detection per query that is over the limit at its own time."""
    queries = events.select("at", "client", "domain", "protocol")
    hits = trailing_counts(
        queries, ["client", "domain"], params.rate_limit_window, params.rate_limit_max_requests, params)
    return rate_verdict(hits, params)


def _panes(at_us: Column, window: int, hop: int) -> Column:
    return slice_start(at_us, gcd(window, hop) * SECOND)


def _start_range(pane: Column, window: int, hop: int) -> tuple[Column, Column]:
    """First and last start of the hopping windows that hold a pane; first is later where none does."""
    pane_us, span, step = gcd(window, hop) * SECOND, window * SECOND, hop * SECOND
    lowest = pane + pane_us - span
    return lowest + F.pmod(-lowest, F.lit(step)), slice_start(pane, step)


def _window_starts(pane: Column, window: int, hop: int) -> Column:
    """Starts of all hopping windows that hold a pane; empty when windows leave gaps."""
    first, last = _start_range(pane, window, hop)
    return F.when(first <= last, F.sequence(first, last, F.lit(hop * SECOND)))


def rate_limit_ticks(events: DataFrame, params: Params) -> DataFrame:
    """The rate test on every window ``[tick - W, tick)`` of the evaluation grid.

    Queries are counted once per pane; only pane counts are copied into the overlapping
    windows.
    """
    window, hop = params.rate_limit_window, params.check_interval
    pane = _panes(F.unix_micros("at"), window, hop)
    panes = events.groupBy("client", "domain", "protocol", pane.alias("pane")).agg(
        F.count("*").alias("n"), F.max(nanos_since(F.col("at"), F.col("at_ns"), pane)).alias("in_pane"))
    # pane rows do not combine before they meet, so one exchange serves both aggregations; a
    # group holds one row per pane and protocol
    windows = panes.withColumn("start", F.explode(_window_starts(F.col("pane"), window, hop))).withColumn(
        "last", (F.col("pane") - F.col("start")) * 1000 + F.col("in_pane")).repartition("client", "domain", "start")
    hits = windows.groupBy("client", "domain", "protocol", "start").agg(
        F.sum("n").alias("n"), F.max("last").alias("last")
    ).groupBy("client", "domain", "start").agg(
        F.sum("n").alias("n"), F.max_by("protocol", F.struct("last", "protocol")).alias("protocol"),
    ).filter(F.col("n") > params.rate_limit_max_requests)
    return rate_verdict(hits.withColumn("at", F.timestamp_micros(F.col("start") + window * SECOND)), params)


# -- distinct subdomains --------------------------------------------------------------------


def subdomain_flood_snapshot(events: DataFrame, params: Params, as_of: datetime) -> DataFrame:
    """(client, base domain) pairs with too many distinct names in the last window."""
    names = subdomain_queries(in_window(events, params.subdomain_flood_window, as_of))
    hits = names.groupBy("client", "base").agg(F.count_distinct("domain").alias("n")).filter(
        F.col("n") > params.subdomain_flood_max_unique).withColumn("at", instant(as_of))
    return flood_verdict(hits, params)


def subdomain_flood_trailing(events: DataFrame, params: Params) -> DataFrame:
    """One detection per query at whose time the distinct names exceed the limit.

    A name is live from a query until the window after its last one has passed. First and
    last query per (name, slice) are enough to find these live spans, so a name asked a
    billion times weighs no more than its slices. Each span adds one when it opens and
    takes one when it closes; the queries are then counted against that sum.
    """
    window, limit = params.subdomain_flood_window, params.subdomain_flood_max_unique
    width = slice_seconds(window, params.max_slice_seconds) * SECOND
    span = window * SECOND
    queries = subdomain_queries(events.select("at", "client", "domain"))
    at_us = F.unix_micros("at")
    queries = queries.withColumn("slice", slice_start(at_us, width)).withColumn("ord", at_us * 2)

    seen = queries.groupBy("client", "base", "domain", "slice").agg(
        F.min(at_us).alias("first"), F.max(at_us).alias("last"), F.count("*").alias("c"))
    along = Window.partitionBy("client", "base", "domain").orderBy("slice")
    opens = F.coalesce(F.col("first") - F.lag("last").over(along) > span, F.lit(True))
    closes = F.coalesce(F.lead("first").over(along) - F.col("last") > span, F.lit(True))
    spans = seen.withColumn("opens", opens).withColumn("closes", closes)
    gone = F.col("last") + span
    changes = spans.select("client", "base", F.inline(F.array(
        F.struct("slice", (F.col("first") * 2).alias("ord"), F.col("opens").cast("int").alias("delta"), F.col("c").alias("asked")),
        F.struct(slice_start(gone, width).alias("slice"), (gone * 2 + 1).alias("ord"),
                 (-F.col("closes").cast("int")).alias("delta"), F.lit(0).cast("long").alias("asked")),
    )))

    totals = changes.groupBy("client", "base", "slice").agg(
        F.sum("delta").alias("net"), F.sum(F.greatest("delta", F.lit(0))).alias("opened"),
        F.sum("asked").alias("asked"), F.count("*").alias("changes"))
    earlier = Window.partitionBy("client", "base").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    busy = totals.withColumn("before", F.coalesce(F.sum("net").over(earlier), F.lit(0))).filter(
        (F.col("asked") > 0) & (F.col("before") + F.col("opened") > limit)).select(
        "client", "base", "slice", "before", (F.col("asked") + F.col("changes") > params.max_slice_rows).alias("dense"))

    points = queries.select("client", "base", "slice", "ord", F.lit(0).alias("delta"), "at")
    rows = points.unionByName(
        changes.filter("delta <> 0").drop("asked").withColumn("at", F.lit(None).cast("timestamp"))
    ).join(busy, ["client", "base", "slice"])
    hits = running_count(rows, ["client", "base"], width).filter(F.col("at").isNotNull() & (F.col("n") > limit))
    return flood_verdict(hits, params)


def subdomain_flood_ticks(events: DataFrame, params: Params) -> DataFrame:
    """The distinct-name test on every window of the evaluation grid.

    The windows that hold a name are runs of neighbouring starts. A run adds one to the count where it
    begins and takes one where it has ended, so a name gives two rows per run, whatever the overlap of
    the windows; only counts over the limit are written out for every start.
    """
    window, hop = params.subdomain_flood_window, params.check_interval
    step = hop * SECOND
    names = subdomain_queries(events).select(
        "client", "base", "domain", _panes(F.unix_micros("at"), window, hop).alias("pane")).distinct()
    first, last = _start_range(F.col("pane"), window, hop)
    held = names.select("client", "base", "domain", "pane", first.alias("first"), last.alias("last")).filter("first <= last")
    along = Window.partitionBy("client", "base", "domain").orderBy("pane")
    begins = F.coalesce(F.col("first") - F.lag("last").over(along) > step, F.lit(True)).cast("int")
    ends = F.coalesce(F.lead("first").over(along) - F.col("last") > step, F.lit(True)).cast("int")
    changes = held.select("client", "base", "first", "last", begins.alias("begins"), ends.alias("ends")).select(
        "client", "base", F.inline(F.array(
            F.struct(F.col("first").alias("start"), F.col("begins").alias("delta")),
            F.struct((F.col("last") + step).alias("start"), (-F.col("ends")).alias("delta"))))).filter("delta <> 0")
    # one row per start at most from here on
    nets = changes.groupBy("client", "base", "start").agg(F.sum("delta").alias("net"))
    onwards = Window.partitionBy("client", "base").orderBy("start")
    counted = nets.select("client", "base", "start", F.sum("net").over(onwards).alias("n"), F.lead("start").over(onwards).alias("until"))
    hits = counted.filter(F.col("n") > params.subdomain_flood_max_unique).select(
        "client", "base", "n", F.explode(F.sequence(F.col("start"), F.col("until") - step, F.lit(step))).alias("start"))
    return flood_verdict(hits.withColumn("at", F.timestamp_micros(F.col("start") + window * SECOND)), params)


# -- watch list -----------------------------------------------------------------------------


def escalate_watchlisted(detections: DataFrame, watchlist: DataFrame) -> DataFrame:
    """Watch-list verdict against a table of names (``domain``) of any length.

    The configured list of the detectors is a chain of comparisons; here the names above
    each target are looked up by equality. Targets are made distinct first, so a target
    hit a billion times is looked up once.
    """
    listed = watchlist.select(F.regexp_replace(F.lower(strip(F.col("domain"))), r"^\.", "").alias("name")).distinct()
    targets = detections.select("target").distinct()
    plain = F.regexp_replace("target", r"^\*\.", "")
    watched = targets.select("target", F.explode(parent_names(plain)).alias("name")).join(
        listed, "name", "left_semi").select("target", F.lit(True).alias("watched")).distinct()
    hit = F.coalesce("watched", F.lit(False))
    return detections.join(watched, "target", "left").withColumn(
        "reason", F.when(hit, F.lit(WATCHLIST)).otherwise(F.col("reason"))).withColumn(
        "permanent", hit | F.col("permanent")).select(detections.columns)


# -- combining ------------------------------------------------------------------------------


def detections_at(events: DataFrame, params: Params, as_of: datetime) -> DataFrame:
    """Both detectors at one evaluation time."""
    found = rate_limit_snapshot(events, params, as_of)
    if params.subdomain_flood_enabled:
        found = found.unionByName(subdomain_flood_snapshot(events, params, as_of))
    return found


def detections_over_time(events: DataFrame, params: Params) -> DataFrame:
    """Both detectors at the time of every query."""
    found = rate_limit_trailing(events, params)
    if params.subdomain_flood_enabled:
        found = found.unionByName(subdomain_flood_trailing(events, params))
    return found


def detection_order() -> Column:
    """Which of several simultaneous hits decides a ban: rate test first, then the larger
    count, then the name. A total order, so that a rerun bans for the same reason."""
    return F.struct(
        F.when(F.col("target").startswith("*."), F.lit(1)).otherwise(F.lit(0)).alias("detector"),
        (-F.col("n")).alias("neg_n"), F.col("target").alias("name"), F.col("protocol").alias("proto"))


def first_detection_per_client(detections: DataFrame) -> DataFrame:
    """At one evaluation a client is banned once."""
    rest = [c for c in detections.columns if c != "client"]
    return detections.groupBy("client").agg(
        F.min_by(F.struct(*rest), detection_order()).alias("d")).select("client", "d.*").select(detections.columns)
