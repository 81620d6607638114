"""Registered queries: every job on the test tables, with plain column types."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce, wraps
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from tidewarden.operators import bans, detect, geo, ledger, live, membership, outbox, report
from tidewarden.plans.fixtures import AS_OF, AS_OF_EPOCH, DAY, DEMO, NOW, REPORT_AS_OF, Tables
from tidewarden.schemas import ACTIVE_BANS, OFFENSES
from tidewarden.session import prepare
from tidewarden.sources import lists, logs, querylog, tables

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}

WATCHED = DEMO.with_(watchlist_enabled=True)
DAY_OLD = DEMO.with_(progressive_reset_after=86_400)
GEO = DEMO.with_(geoip_enabled=True, geoip_countries=("BB", "CH", "ZZ", "DI", "AX", "DX"))
GEO_ALLOW = GEO.with_(geoip_mode="allowlist")
GEO_DB_MTIME = 123
ALERTS = DEMO.with_(host_name="dns1", abuse_enabled=True, geoip_notify=True, blocklist_notify=False)
REPORT_SINCE, REPORT_UNTIL, _ = report.report_window(DEMO.report_interval, REPORT_AS_OF)
#: after the last query of the test log
LOG_END = AS_OF_EPOCH + 40 * DAY
LOG_SINCE, LOG_UNTIL, _ = report.report_window(DEMO.report_interval, AS_OF)


def _plain(df: DataFrame) -> DataFrame:
    """Timestamps become microseconds and counts become longs, so that engines agree."""
    out = []
    for field in df.schema.fields:
        if isinstance(field.dataType, T.TimestampType):
            out.append(F.unix_micros(field.name).alias(f"{field.name}_us"))
        elif isinstance(field.dataType, T.IntegralType):
            out.append(F.col(field.name).cast("long").alias(field.name))
        else:
            out.append(F.col(field.name))
    return df.select(*out)


def query(fn: Callable[[Tables], DataFrame]) -> Callable[[Tables], DataFrame]:
    @wraps(fn)
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return _plain(fn(Tables(prepare(spark), sf_dir)))

    QUERIES[fn.__name__] = run
    return fn


# -- ingest ---------------------------------------------------------------------------------


@query
def normalize_queries(t: Tables) -> DataFrame:
    return querylog.normalize_queries(t.raw_items())


@query
def dedupe_queries(t: Tables) -> DataFrame:
    return querylog.dedupe_queries(normalize_queries(t))


@query
def retain_recent(t: Tables) -> DataFrame:
    return querylog.retain_recent(t.queries(), DEMO, AS_OF)


@query
def distinct_clients(t: Tables) -> DataFrame:
    return querylog.distinct_clients(normalize_queries(t))


# -- detection ------------------------------------------------------------------------------


@query
def rate_limit_snapshot(t: Tables) -> DataFrame:
    return detect.rate_limit_snapshot(t.queries(), DEMO, AS_OF)


@query
def rate_limit_trailing(t: Tables) -> DataFrame:
    return detect.rate_limit_trailing(t.queries(), DEMO)


@query
def rate_limit_ticks(t: Tables) -> DataFrame:
    return detect.rate_limit_ticks(t.queries(), DEMO)


@query
def subdomain_flood_snapshot(t: Tables) -> DataFrame:
    return detect.subdomain_flood_snapshot(t.queries(), DEMO, AS_OF)


@query
def subdomain_flood_trailing(t: Tables) -> DataFrame:
    return detect.subdomain_flood_trailing(t.queries(), DEMO)


@query
def subdomain_flood_ticks(t: Tables) -> DataFrame:
    return detect.subdomain_flood_ticks(t.queries(), DEMO)


@query
def watchlist_escalation(t: Tables) -> DataFrame:
    return detect.detections_at(t.queries(), WATCHED, AS_OF)


@query
def watchlist_table(t: Tables) -> DataFrame:
    """The watch list as a table: the hosts of all pages that are served encrypted."""
    watched = t.raw("pages").filter("url LIKE 'https:%'").select(
        F.regexp_extract("url", r"^https?://([^/:?#]+)", 1).alias("domain"))
    return detect.escalate_watchlisted(detect.detections_at(t.queries(), DEMO, AS_OF), watched)


@query
def first_detection_per_client(t: Tables) -> DataFrame:
    return detect.first_detection_per_client(detect.detections_at(t.queries(), WATCHED, AS_OF))


@query
def flood_pipeline(t: Tables) -> DataFrame:
    """Raw log to watch-list-aware detections at every query time."""
    events = querylog.dedupe_queries(querylog.normalize_queries(t.raw_items()))
    return detect.rate_limit_trailing(events, WATCHED)


@query
def live_top_pairs(t: Tables) -> DataFrame:
    return live.live_top_pairs(t.queries(), DEMO, AS_OF)


@query
def live_top_subdomain_groups(t: Tables) -> DataFrame:
    return live.live_top_subdomain_groups(t.queries(), DEMO, AS_OF)


@query
def live_recent_queries(t: Tables) -> DataFrame:
    return live.live_recent_queries(t.queries())


# -- membership -----------------------------------------------------------------------------


@query
def whitelist_exclude(t: Tables) -> DataFrame:
    return membership.whitelist_exclude(detect.detections_at(t.queries(), WATCHED, AS_OF), t.whitelist())


@query
def whitelist_exclude_networks(t: Tables) -> DataFrame:
    return membership.whitelist_exclude(
        t.active_bans().select("client_ip", "reason"), t.whitelist(), "client_ip", match="cidr")


@query
def not_already_banned(t: Tables) -> DataFrame:
    return membership.not_already_banned(detect.detections_at(t.queries(), WATCHED, AS_OF), t.client_bans())


@query
def ban_exists(t: Tables) -> DataFrame:
    clients = t.ban_history().select(F.col("client_ip").alias("client")).distinct()
    return bans.ban_exists(clients, t.active_bans())


# -- lists ----------------------------------------------------------------------------------


def _entries(t: Tables) -> DataFrame:
    return lists.parse_list(lists.list_latest_good(t.list_snapshots(), "fetched_seq", t.list_fetches()))


def _desired(t: Tables) -> DataFrame:
    return lists.list_desired_set(lists.resolve_list(_entries(t), t.dns_answers()))


@query
def list_latest_good(t: Tables) -> DataFrame:
    return lists.list_latest_good(t.list_snapshots(), "fetched_seq", t.list_fetches()).select("source_name", "fetched_seq", "line")


@query
def parse_list(t: Tables) -> DataFrame:
    return lists.parse_list(t.list_lines())


@query
def resolve_list(t: Tables) -> DataFrame:
    return lists.resolve_list(_entries(t), t.dns_answers())


@query
def list_desired_set(t: Tables) -> DataFrame:
    return _desired(t)


@query
def blocklist_new(t: Tables) -> DataFrame:
    return membership.blocklist_new(_desired(t), t.whitelist(), t.active_bans())


@query
def blocklist_removed(t: Tables) -> DataFrame:
    return membership.blocklist_removed(t.active_bans(), _desired(t)).select("client_ip", "domain", "source")


@query
def whitelist_hits(t: Tables) -> DataFrame:
    return membership.whitelist_hits(
        t.active_bans(), _desired(t).select(F.col("address").alias("ip_address"))).select("client_ip", "reason")


@query
def whitelist_replace(t: Tables) -> DataFrame:
    return tables.whitelist_replace(t.whitelist(), _desired(t), "external")


@query
def whitelist_sync(t: Tables) -> DataFrame:
    return ledger.whitelist_sync(t.active_bans(), t.whitelist(), _desired(t), NOW).history


@query
def blocklist_sync(t: Tables) -> DataFrame:
    return ledger.blocklist_sync(t.active_bans(), t.whitelist(), _desired(t), DEMO, NOW,
                                 lists.good_copies(t.list_fetches(), "fetched_seq")).history


@query
def bans_upsert(t: Tables) -> DataFrame:
    changes = ledger.blocklist_bans(_desired(t), DEMO, NOW)
    return tables.upsert(t.active_bans(), changes, ["client_ip"]).select(
        "client_ip", "domain", "count", "ban_until_epoch", "is_permanent", "reason")


# -- geo ------------------------------------------------------------------------------------


@query
def geo_lookup(t: Tables) -> DataFrame:
    return geo.geo_lookup(t.queries(), t.geo_ranges())


@query
def geo_public_clients(t: Tables) -> DataFrame:
    return geo.geo_public_clients(querylog.distinct_clients(t.queries()), GEO)


@query
def geo_detect(t: Tables) -> DataFrame:
    return geo.geo_detect(t.queries(), t.geo_ranges(), t.whitelist(), t.client_bans(), GEO, AS_OF)


@query
def geo_detect_allowlist(t: Tables) -> DataFrame:
    return geo.geo_detect(t.queries(), t.geo_ranges(), t.whitelist(), t.client_bans(), GEO_ALLOW, AS_OF)


@query
def geo_cache_valid(t: Tables) -> DataFrame:
    return geo.geo_cache_valid(t.geo_cache(), GEO, NOW, GEO_DB_MTIME)


@query
def geo_cache_refresh(t: Tables) -> DataFrame:
    return geo.geo_cache_refresh(t.queries(), t.geo_cache(), t.geo_ranges(), GEO, NOW, GEO_DB_MTIME)


@query
def geo_auto_unban(t: Tables) -> DataFrame:
    return ledger.lift_geo_bans(t.active_bans(), GEO, NOW).history


# -- ledger ---------------------------------------------------------------------------------


@query
def ban_rows(t: Tables) -> DataFrame:
    found = ledger.gate(detect.detections_at(t.queries(), WATCHED, AS_OF), t.whitelist(), t.client_bans(), WATCHED)
    return ledger.ban_rows(found, t.client_offenses(), WATCHED, AS_OF_EPOCH)


@query
def offense_update(t: Tables) -> DataFrame:
    opened = ban_rows(t)
    return ledger.raised_offenses(opened, t.client_offenses(), AS_OF_EPOCH).select(
        "client_ip", "offense_level", "last_offense_epoch")


@query
def dry_run_history(t: Tables) -> DataFrame:
    found = ledger.gate(detect.rate_limit_ticks(t.queries(), WATCHED), t.whitelist(), t.client_bans(), WATCHED)
    return ledger.dry_run_history(found, F.unix_seconds("at"))


@query
def ledger_replay(t: Tables) -> DataFrame:
    return ledger.ledger_replay(detect.rate_limit_trailing(t.queries(), DEMO), DEMO)


@query
def ledger_replay_watched(t: Tables) -> DataFrame:
    """Both detectors, the watch list and the allow list, lifted up to the evaluation time."""
    return ledger.ledger_replay(_watched_hits(t), WATCHED, AS_OF_EPOCH)


def _shared_folder(t: Tables) -> str:
    """A new folder in the shared one of ``spark.checkpoint.dir``; only where that is unset, as in tests, a temporary one."""
    return f"{t.spark.conf.get('spark.checkpoint.dir', None) or tempfile.mkdtemp(prefix='tables-')}/{uuid.uuid4().hex}"


def _watched_hits(t: Tables) -> DataFrame:
    return membership.whitelist_exclude(detect.detections_over_time(t.queries(), WATCHED), t.whitelist())


@query
def ledger_replay_steps(t: Tables) -> DataFrame:
    """As ``ledger_replay_watched``, in two steps: the second starts from the tables that the first has written."""
    folder = _shared_folder(t)
    found = tables.kept_once(_watched_hits(t), f"{folder}/found")
    none = [t.spark.createDataFrame([], s) for s in (ACTIVE_BANS, OFFENSES)]
    first = ledger.replay_step(found, *none, WATCHED, AS_OF_EPOCH - 5 * DAY, f"{folder}/first")
    tables.write_snapshot(first.active_bans, f"{folder}/bans")
    tables.write_snapshot(first.offenses, f"{folder}/offenses")
    later = found.filter(F.unix_seconds("at") > AS_OF_EPOCH - 5 * DAY)
    second = ledger.replay_step(later, tables.read_snapshot(t.spark, f"{folder}/bans", ACTIVE_BANS),
                                tables.read_snapshot(t.spark, f"{folder}/offenses", OFFENSES), WATCHED, LOG_END, f"{folder}/second")
    return first.history.unionByName(second.history)


@query
def ledger_replay_dry_run(t: Tables) -> DataFrame:
    return ledger.ledger_replay(_watched_hits(t), WATCHED.with_(dry_run=True)).drop("offense_level")


@query
def history_append(t: Tables) -> DataFrame:
    """From detections to the report's recent events: replayed, appended twice as one batch, and read back by day."""
    path = f"{_shared_folder(t)}/history"
    written = ledger.ledger_replay(_watched_hits(t), WATCHED, AS_OF_EPOCH).drop("offense_level")
    for _ in range(2):
        tables.history_append(written, path, "replay", 0)
    recent = tables.read_history(t.spark, path, AS_OF_EPOCH - 7 * DAY, AS_OF_EPOCH)
    return report.report_recent_events(recent, 50).drop("id", "day")


@query
def ban_changes(t: Tables) -> DataFrame:
    """The ban table folded from the change logs of two writers, with a repeated batch and a compaction in between."""
    path = f"{_shared_folder(t)}/bans"
    orders, no = t.ban_history(), F.col("id")
    at = F.col("timestamp_epoch") * 10_000_000 + no
    for batch in (0, 1, 1):
        for run in ("lists", "monitor"):
            mine = (no % 2 == int(run == "monitor")) & (no % 3 == 0 if batch else no % 3 > 0)
            rows = orders.filter(mine).withColumn("second", at)
            tables.change_bans(t.spark, path, run, batch, rows.filter("action <> 'UNBAN'").withColumn("ban_until_epoch", F.col("timestamp_epoch")),
                               rows.filter("action = 'UNBAN'"), F.col("second"), F.col("second"))
        if batch == 0:
            tables.compact_bans(t.spark, path)
    return tables.read_bans(t.spark, path).select("client_ip", "domain", "count", "ban_until_epoch", "reason", "protocol")


@query
def whitelist_flush(t: Tables) -> DataFrame:
    return ledger.whitelist_flush(t.whitelist())


@query
def manual_actions_dry_run(t: Tables) -> DataFrame:
    in_force = ledger.expire_bans(t.active_bans(), NOW).active_bans
    return ledger.manual_actions(t.commands(), in_force, t.whitelist(), NOW, DEMO.with_(dry_run=True))


@query
def expire_bans(t: Tables) -> DataFrame:
    return ledger.expire_bans(t.active_bans(), NOW).history


@query
def unban_rows(t: Tables) -> DataFrame:
    return ledger.unban_rows(t.active_bans(), F.concat(F.col("reason"), F.lit("-flush")), NOW)


@query
def flush_bans(t: Tables) -> DataFrame:
    return ledger.flush_bans(t.active_bans(), NOW, "geoip").history


@query
def enforcement_set(t: Tables) -> DataFrame:
    return ledger.enforcement_set(t.active_bans(), NOW)


@query
def manual_actions(t: Tables) -> DataFrame:
    in_force = ledger.expire_bans(t.active_bans(), NOW).active_bans
    return ledger.manual_actions(t.commands(), in_force, t.whitelist(), NOW)


@query
def manual_ban_rows(t: Tables) -> DataFrame:
    in_force = ledger.expire_bans(t.active_bans(), NOW).active_bans
    return ledger.manual_ban_rows(t.commands(), in_force, t.whitelist(), DEMO, NOW).select(
        "client_ip", "domain", "count", "is_permanent", "reason", "source")


@query
def reset_offenses(t: Tables) -> DataFrame:
    return ledger.reset_offenses(t.offenses(), t.commands())


@query
def bans_by_source(t: Tables) -> DataFrame:
    return bans.bans_by_source(t.active_bans(), "monitor")


@query
def bans_by_reason(t: Tables) -> DataFrame:
    return bans.bans_by_reason(t.active_bans(), "geoip")


@query
def active_bans_list(t: Tables) -> DataFrame:
    return bans.active_bans_list(t.active_bans(), "created_seq")


@query
def expired_bans(t: Tables) -> DataFrame:
    return bans.expired_bans(t.active_bans(), NOW).select("client_ip", "ban_until_epoch")


@query
def expired_offenses(t: Tables) -> DataFrame:
    return bans.expired_offenses(t.offenses(), DAY_OLD.progressive_reset_after, NOW)


@query
def offense_cleanup(t: Tables) -> DataFrame:
    return bans.offense_cleanup(t.offenses(), DAY_OLD.progressive_reset_after, NOW)


@query
def offense_status(t: Tables) -> DataFrame:
    return bans.offense_status(t.offenses(), DAY_OLD.progressive_reset_after, NOW)


@query
def live_active_bans(t: Tables) -> DataFrame:
    return live.live_active_bans(t.active_bans(), newest="created_seq")


@query
def live_counters(t: Tables) -> DataFrame:
    return live.live_counters(t.raw_items(), t.active_bans(), t.offenses(), t.whitelist(), DAY_OLD, NOW)


@query
def history_recent(t: Tables) -> DataFrame:
    return bans.history_recent(t.ban_history())


# -- logs -----------------------------------------------------------------------------------


@query
def parse_log_lines(t: Tables) -> DataFrame:
    return logs.parse_log_lines(t.log_lines()).drop("line")


@query
def recent_log_lines(t: Tables) -> DataFrame:
    return live.recent_log_lines(t.log_lines(), "WARN", 12, order=("event_id",))


@query
def abuse_report_count(t: Tables) -> DataFrame:
    return report.abuse_report_count(t.log_lines(), LOG_SINCE, LOG_UNTIL)


# -- reports --------------------------------------------------------------------------------


@query
def report_window(t: Tables) -> DataFrame:
    """History rows that fall into the window of each report interval."""
    history = t.ban_history()
    windows = {name: report.report_window(name, REPORT_AS_OF) for name in [*report.INTERVALS, "other"]}
    found = history.filter(F.col("timestamp_epoch") <= REPORT_UNTIL).agg(*[
        F.count_if(F.col("timestamp_epoch").between(since, until)).alias(name)
        for name, (since, until, _) in windows.items()])
    return found.select(F.inline(F.array(*[
        F.struct(F.lit(name).alias("name"), F.lit(since).cast("long").alias("since"), F.lit(until).cast("long").alias("until"),
                 F.lit(label).alias("label"), F.col(name).alias("n"))
        for name, (since, until, label) in windows.items()])))


@query
def report_kpis(t: Tables) -> DataFrame:
    return report.report_kpis(t.ban_history(), t.active_bans(), REPORT_SINCE, REPORT_UNTIL)


@query
def report_busiest_day(t: Tables) -> DataFrame:
    since = report.busiest_since(DEMO, REPORT_AS_OF, REPORT_SINCE)
    return report.report_busiest_day(t.ban_history(), since, REPORT_UNTIL)


@query
def report_top_clients(t: Tables) -> DataFrame:
    return report.with_bars(report.report_top_clients(t.ban_history(), REPORT_SINCE, REPORT_UNTIL))


@query
def report_top_domains(t: Tables) -> DataFrame:
    return report.with_bars(report.report_top_domains(t.ban_history(), REPORT_SINCE, REPORT_UNTIL))


@query
def report_protocols(t: Tables) -> DataFrame:
    return report.report_protocols(t.ban_history(), REPORT_SINCE, REPORT_UNTIL)


@query
def report_reasons(t: Tables) -> DataFrame:
    return report.report_reasons(t.ban_history(), REPORT_SINCE, REPORT_UNTIL)


@query
def report_sources(t: Tables) -> DataFrame:
    return report.report_sources(t.active_bans())


@query
def report_recent_bans(t: Tables) -> DataFrame:
    return report.report_recent_bans(t.ban_history(), REPORT_SINCE, REPORT_UNTIL)


@query
def report_recent_events(t: Tables) -> DataFrame:
    return report.report_recent_events(t.ban_history())


@query
def report_period_overview(t: Tables) -> DataFrame:
    return report.report_period_overview(t.ban_history(), REPORT_AS_OF)


@query
def report_bundle(t: Tables) -> DataFrame:
    """From detections to the tables of a report: replayed, written, and read back as history and ban table."""
    folder = _shared_folder(t)
    none = [t.spark.createDataFrame([], s) for s in (ACTIVE_BANS, OFFENSES)]
    found = tables.kept_once(_watched_hits(t), f"{folder}/found")
    step = ledger.replay_step(found, *none, WATCHED, LOG_END, f"{folder}/opened")
    tables.history_append(step.history, f"{folder}/history", "replay", 0)
    tables.write_snapshot(step.active_bans, f"{folder}/bans")
    made = report.report_bundle(tables.read_history(t.spark, f"{folder}/history"),
                                tables.read_snapshot(t.spark, f"{folder}/bans", ACTIVE_BANS), None, WATCHED, AS_OF)

    def listed(table: str, name: str, n: str = "n") -> DataFrame:
        return made[table].select(F.lit(table).alias("table"), F.col(name).alias("name"), F.col(n).alias("n"))

    numbers = [c for c in made["kpis"].columns if c not in ("period", "generated")]
    kpis = made["kpis"].select(F.inline(F.array(*[
        F.struct(F.lit("kpis").alias("table"), F.lit(c).alias("name"), F.col(c).alias("n")) for c in numbers])))
    parts = [listed(x, "name") for x in ("top_clients", "top_domains", "protocols", "reasons", "sources")]
    parts += [listed("busiest_day", "day"), listed("period_overview", "label", "bans"), listed("recent_bans", "client_ip", "id").withColumn("n", F.lit(1).cast("long"))]
    return reduce(DataFrame.unionByName, parts, kpis)


# -- alerts ---------------------------------------------------------------------------------


@query
def alert_outbox(t: Tables) -> DataFrame:
    expired = ledger.expire_bans(t.active_bans(), NOW).history
    flushed = ledger.flush_bans(t.active_bans(), NOW, "geoip").history
    return outbox.alert_outbox(t.active_bans(), expired.unionByName(flushed), ALERTS).drop("payload")


@query
def abuse_candidates(t: Tables) -> DataFrame:
    return outbox.abuse_candidates(t.active_bans(), ALERTS)
