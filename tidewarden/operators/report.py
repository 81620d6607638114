"""Reports over the ban history.

All times are epoch seconds; day boundaries follow the time zone of ``as_of``, which is
the session zone (UTC). Ranges are closed on both sides.
"""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame, Window, functions as F

from tidewarden.functions.text import (
    blank_to, dash_if_blank, protocol_class, reason_class, short_time,
)
from tidewarden.functions.times import utc
from tidewarden.operators.bans import history_recent
from tidewarden.params import Params
from tidewarden.sources.logs import log_time
from tidewarden.sources.tables import prune_days

# Days and title of each report interval, and labels of the overview rows.
INTERVALS = {
    "daily": (1, "Tagesbericht"), "weekly": (7, "Wochenbericht"),
    "biweekly": (14, "Zweiwochenbericht"), "monthly": (30, "Monatsbericht"),
}
OTHER_INTERVAL = (7, "Bericht")
OVERVIEW_DAYS = {"Letzte 7 Tage": 7, "Letzte 14 Tage": 14, "Letzte 30 Tage": 30}
REPORT_ROWS = 20


def epoch(at: datetime) -> int:
    return int(utc(at).timestamp())


def midnight(at: datetime) -> datetime:
    return at.replace(hour=0, minute=0, second=0, microsecond=0)


def report_window(interval: str, as_of: datetime) -> tuple[int, int, str]:
    """First second, last second and title of the report due at ``as_of``."""
    days, title = INTERVALS.get(interval.lower(), OTHER_INTERVAL)
    start, end = midnight(as_of) - timedelta(days=days), midnight(as_of) - timedelta(seconds=1)
    span = f"{start:%d.%m.%Y}" if interval.lower() == "daily" else f"{start:%d.%m.%Y} - {end:%d.%m.%Y}"
    return epoch(start), epoch(end), f"{title}: {span}"


def busiest_since(params: Params, as_of: datetime, since: int) -> int:
    if params.report_busiest_day_range <= 0:
        return since
    return epoch(midnight(as_of) - timedelta(days=params.report_busiest_day_range))


def in_range(history: DataFrame, since: int, until: int) -> DataFrame:
    within = history.filter(F.col("timestamp_epoch").between(since, until))
    return prune_days(within, F.timestamp_seconds(F.lit(since)), F.timestamp_seconds(F.lit(until)))


def _bans(history: DataFrame, since: int, until: int) -> DataFrame:
    return in_range(history, since, until).filter("action = 'BAN'")


def _like(column: str, pattern: str) -> Column:
    return F.lower(F.coalesce(column, F.lit(""))).like(pattern)


def report_kpis(history: DataFrame, active_bans: DataFrame, since: int, until: int) -> DataFrame:
    """All single numbers of a report in one pass over the history."""
    ban = F.col("action") == "BAN"
    return in_range(history, since, until).agg(
        F.count_if(ban).alias("total_bans"),
        F.count_if(F.col("action") == "UNBAN").alias("total_unbans"),
        F.count_distinct(F.when(ban, F.col("client_ip"))).alias("unique_ips"),
        F.count_if(ban & _like("duration", "%permanent%")).alias("permanent_bans"),
        F.count_if(ban & _like("reason", "%rate%limit%")).alias("rate_limit_bans"),
        F.count_if(ban & _like("reason", "%subdomain%flood%")).alias("subdomain_flood_bans"),
        F.count_if(ban & _like("reason", "%external%blocklist%")).alias("external_blocklist_bans"),
    ).withColumn("active_bans", active_bans.agg(F.count("*")).scalar())


def report_busiest_day(history: DataFrame, since: int, until: int) -> DataFrame:
    """The day with most bans; of equal days the latest. No rows without bans."""
    return _bans(history, since, until).groupBy(F.substring("timestamp_text", 1, 10).alias("day")).agg(
        F.count("*").alias("n")).orderBy(F.desc("n"), F.desc("day")).limit(1)


def _ranked(groups: DataFrame, limit: int) -> DataFrame:
    return groups.agg(F.count("*").alias("n")).orderBy(F.desc("n"), "name").limit(limit)


def with_bars(top: DataFrame) -> DataFrame:
    """Rank, bar width in percent and top-three mark for an already limited list."""
    order = Window.partitionBy(F.lit(0)).orderBy(F.desc("n"), "name")
    most = F.first("n").over(order)
    return top.withColumn("rank", F.row_number().over(order)).withColumn(
        "width", F.floor(F.col("n") * 100 / most).cast("long")).withColumn("top3", F.col("rank") <= 3)


def report_top_clients(history: DataFrame, since: int, until: int, limit: int = REPORT_ROWS) -> DataFrame:
    return _ranked(_bans(history, since, until).groupBy(F.col("client_ip").alias("name")), limit)


def report_top_domains(history: DataFrame, since: int, until: int, limit: int = REPORT_ROWS) -> DataFrame:
    named = _bans(history, since, until).filter(~F.coalesce("domain", F.lit("")).isin("", "-"))
    return _ranked(named.groupBy(F.col("domain").alias("name")), limit)


def _or_default(column: str, default: str) -> Column:
    return F.coalesce(F.nullif(F.col(column), F.lit("")), F.lit(default)).alias("name")


def report_protocols(history: DataFrame, since: int, until: int, limit: int = REPORT_ROWS) -> DataFrame:
    return _ranked(_bans(history, since, until).groupBy(_or_default("protocol", "unbekannt")), limit).withColumn(
        "css_class", protocol_class(F.col("name")))


def report_reasons(history: DataFrame, since: int, until: int, limit: int = REPORT_ROWS) -> DataFrame:
    return _ranked(_bans(history, since, until).groupBy(_or_default("reason", "unknown")), limit)


def report_lists(history: DataFrame, since: int, until: int, day_since: int | None = None, limit: int = REPORT_ROWS) -> DataFrame:
    """(list, rank, name, n, width, top3): every ranked list of bans, from one pass over the history.

    A ban goes on as one row per list that counts it and is counted per (list, name) before the shuffle; each task
    then passes on no more than ``limit`` rows of a list. Days are counted from ``day_since`` on, and only the
    busiest stays.
    """
    first = since if day_since is None else day_since
    inside, day = F.col("timestamp_epoch") >= since, F.substring("timestamp_text", 1, 10)
    named = inside & ~F.coalesce("domain", F.lit("")).isin("", "-")

    def counted(held: Column, title: str, name: Column) -> Column:
        return F.when(held, F.struct(F.lit(title).alias("list"), name.alias("name")))

    entries = F.array_compact(F.array(
        counted(inside, "top_clients", F.col("client_ip")), counted(named, "top_domains", F.col("domain")),
        counted(inside, "protocols", _or_default("protocol", "unbekannt")), counted(inside, "reasons", _or_default("reason", "unknown")),
        counted(F.col("timestamp_epoch") >= first, "busiest_day", day)))
    counts = _bans(history, min(since, first), until).select(F.inline(entries)).groupBy("list", "name").agg(F.count("*").alias("n"))
    latest = F.when(F.col("list") == "busiest_day", F.col("name"))
    order = Window.partitionBy("list").orderBy(F.desc("n"), latest.desc(), "name")
    ranked = counts.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= limit)
    shown = ranked.withColumn("most", F.max("n").over(Window.partitionBy("list"))).filter("list <> 'busiest_day' OR rank = 1")
    return shown.select("list", "rank", "name", "n", F.floor(F.col("n") * 100 / F.col("most")).cast("long").alias("width"),
                        (F.col("rank") <= 3).alias("top3"))


def report_sources(active_bans: DataFrame, limit: int = REPORT_ROWS) -> DataFrame:
    return _ranked(active_bans.groupBy(_or_default("source", "unknown")), limit)


def report_recent_bans(history: DataFrame, since: int, until: int, limit: int = 10) -> DataFrame:
    reason = blank_to(F.col("reason"), "rate-limit")
    return _bans(history, since, until).orderBy(F.desc("id")).limit(limit).select(
        "id", short_time(F.col("timestamp_text")).alias("shown_at"), "client_ip",
        dash_if_blank(F.col("domain")).alias("domain"), reason.alias("reason"),
        reason_class(reason).alias("css_class"))


def report_recent_events(history: DataFrame, limit: int = REPORT_ROWS) -> DataFrame:
    return history_recent(history, limit)


def overview_periods(as_of: datetime) -> list[tuple[str, int, int]]:
    """Label, first and last second of the overview rows; today only from 20:00 on."""
    today, now = midnight(as_of), epoch(as_of)
    rows = [("Heute", epoch(today), now)] if as_of.hour >= 20 else []
    rows.append(("Gestern", epoch(today - timedelta(days=1)), epoch(today) - 1))
    return rows + [(label, epoch(today - timedelta(days=d)), now) for label, d in OVERVIEW_DAYS.items()]


def report_period_overview(history: DataFrame, as_of: datetime) -> DataFrame:
    """Bans, unbans, clients and permanent bans of each period; empty periods are zeros.

    One aggregation by client counts all periods together; a client then adds one to the
    client number of every period it was banned in.
    """
    periods = overview_periods(as_of)
    ban, unban = F.col("action") == "BAN", F.col("action") == "UNBAN"
    lasting = _like("duration", "%permanent%")
    per_client, totals = [], []
    for i, (_, since, until) in enumerate(periods):
        inside = F.col("timestamp_epoch").between(since, until)
        per_client += [F.count_if(inside & ban).alias(f"b{i}"), F.count_if(inside & unban).alias(f"u{i}"),
                       F.count_if(inside & ban & lasting).alias(f"p{i}")]
        totals.append(F.struct(
            F.lit(i).alias("position"), F.lit(periods[i][0]).alias("label"),
            F.coalesce(F.sum(f"b{i}"), F.lit(0)).alias("bans"), F.coalesce(F.sum(f"u{i}"), F.lit(0)).alias("unbans"),
            F.count_if(F.col(f"b{i}") > 0).alias("unique_ips"),
            F.coalesce(F.sum(f"p{i}"), F.lit(0)).alias("permanent_bans")))
    first, last = min(p[1] for p in periods), max(p[2] for p in periods)
    clients = in_range(history, first, last).groupBy("client_ip").agg(*per_client)
    return clients.agg(F.array(*totals).alias("rows")).select(F.inline("rows"))


def abuse_report_count(lines: DataFrame, since: int, until: int) -> DataFrame:
    """Successful abuse reports noted in the service log."""
    noted = F.contains(F.col("line"), F.lit("AbuseIPDB:")) & F.contains(F.col("line"), F.lit("erfolgreich gemeldet"))
    return lines.filter(noted).filter(
        F.unix_seconds(log_time(F.col("line"))).between(since, until)).agg(F.count("*").alias("n"))


def report_bundle(history: DataFrame, active_bans: DataFrame, lines: DataFrame | None, params: Params,
                  as_of: datetime) -> dict[str, DataFrame]:
    """Every table of the report due at ``as_of``.

    The ranked lists come from one pass over the history, kept in memory: at most 20 rows of each list.
    """
    since, until, title = report_window(params.report_interval, as_of)
    day_since = busiest_since(params, as_of, since)
    kpis = report_kpis(history, active_bans, since, until).select(
        F.lit(title).alias("period"), F.lit(f"{as_of:%d.%m.%Y %H:%M:%S}").alias("generated"), "*")
    lists = report_lists(history, since, until, day_since).cache()

    def ranked(name: str, *columns: Column | str) -> DataFrame:
        return lists.filter(F.col("list") == name).orderBy("rank").select(*columns)

    bars = ("name", "n", "rank", "width", "top3")
    tables = {
        "kpis": kpis,
        "busiest_day": ranked("busiest_day", F.col("name").alias("day"), "n"),
        "top_clients": ranked("top_clients", *bars),
        "top_domains": ranked("top_domains", *bars),
        "protocols": ranked("protocols", "name", "n", protocol_class(F.col("name")).alias("css_class")),
        "reasons": ranked("reasons", "name", "n"),
        "sources": report_sources(active_bans),
        "recent_bans": report_recent_bans(history, since, until),
        "recent_events": report_recent_events(history),
        "period_overview": report_period_overview(history, as_of),
    }
    if lines is not None:
        tables["abuse_reports"] = abuse_report_count(lines, since, until)
    return tables


def write_report(tables: dict[str, DataFrame], path: str) -> None:
    for name, table in tables.items():
        table.write.mode("overwrite").parquet(f"{path}/{name}")
