import random

import pytest
from pyspark.sql import functions as F

from tests.helpers import T0, at, rows
from tidewarden.operators import bans as ban_tables
from tidewarden.operators import ledger, membership
from tidewarden.params import Params
from tidewarden.plans import catalog
from tidewarden.plans.fixtures import AS_OF_EPOCH, DAY
from tidewarden.schemas import ACTIVE_BANS, DETECTIONS, OFFENSES, WHITELIST
from tidewarden.sources import lists, tables

NOW = 1_700_000_000
P = Params(ban_duration=100, progressive_multiplier=2, progressive_max_level=3, progressive_reset_after=1000)


def found(spark, *given):
    """Rows of (second, client[, target, n, reason, source, permanent])."""
    full = []
    for g in given:
        t, client, target, n, reason, source, permanent = (*g, "x.com", 9, "rate-limit", "monitor", False)[:2] + (
            *g[2:], *("x.com", 9, "rate-limit", "monitor", False)[len(g) - 2:])
        full.append((at(t), client, target, n, "dns", reason, source, permanent, ""))
    return spark.createDataFrame(full, DETECTIONS)


def ban(ip, until=0, permanent=False, reason="rate-limit", source="monitor", country="", mode="blocklist", level=0, domain="x.com", count=9, seconds=100):
    return (ip, domain, count, "2023-11-14 00:00:00", until, seconds, level, permanent, reason, "dns", source, country, mode)


def bans(spark, *made):
    return spark.createDataFrame(list(made), ACTIVE_BANS)


def offenses(spark, *made):
    return spark.createDataFrame([(ip, level, last, None, "start") for ip, level, last in made], OFFENSES)


def whitelist(spark, *ips):
    return spark.createDataFrame([(ip, "external") for ip in ips], WHITELIST)


def GOOD(spark):
    return spark.createDataFrame([("list",)], "source_name string")


def test_levels_and_durations(spark):
    past = offenses(spark, ("again", 1, NOW - 10), ("edge", 1, NOW - 1000), ("old", 2, NOW - 1001), ("top", 2, NOW), ("zero", 4, 0))
    hits = found(spark, *[(0, c) for c in ("new", "again", "edge", "old", "top", "zero")],
                 (0, "geo", "GeoIP:XX", 0, "geoip", "geoip", True), (0, "watched", "x.com", 9, "dns-flood-watchlist", "monitor", True))
    got = ledger.ban_rows(hits, past, P, NOW)
    assert rows(got, "client_ip", "offense_level", "ban_duration", "ban_until_epoch", "is_permanent") == sorted([
        ("new", 1, 100, NOW + 100, False), ("again", 2, 200, NOW + 200, False), ("edge", 2, 200, NOW + 200, False),
        ("old", 1, 100, NOW + 100, False), ("top", 3, 0, 0, True), ("zero", 5, 0, 0, True),
        ("geo", 0, 100, 0, True), ("watched", 0, 100, 0, True)])
    history = ledger.ban_history(got, NOW)
    assert rows(history.filter("client_ip IN ('again', 'top')"), "client_ip", "action", "count", "duration", "timestamp_text") == [
        ("again", "BAN", "9", "200s", "2023-11-14 22:13:20"), ("top", "BAN", "9", "permanent", "2023-11-14 22:13:20")]
    raised = ledger.raised_offenses(got, past, NOW)
    assert rows(raised.filter("client_ip IN ('again', 'old', 'new')"), "client_ip", "offense_level", "last_offense_epoch", "first_offense") == [
        ("again", 2, NOW, "start"), ("new", 1, NOW, "2023-11-14 22:13:20"), ("old", 1, NOW, "2023-11-14 22:13:20")]
    assert raised.filter("client_ip IN ('geo', 'watched')").count() == 0


@pytest.mark.parametrize("change,want", [
    ({"progressive_max_level": 0}, (5, 1600, False)), ({"progressive_multiplier": 0, "progressive_max_level": 0}, (5, 100, False)),
    ({"progressive_enabled": False}, (0, 100, False)), ({"ban_duration": 0, "progressive_max_level": 0}, (5, 0, False)),
])
def test_ladder_settings(spark, change, want):
    got = ledger.ban_rows(found(spark, (0, "c")), offenses(spark, ("c", 4, NOW - 1)), P.with_(**change), NOW)
    assert rows(got, "offense_level", "ban_duration", "is_permanent") == [want]


def test_one_evaluation(spark):
    p = P.with_(whitelist=("static",))
    hits = found(spark, (0, "a"), (0, "a", "*.y.com", 99, "subdomain-flood"), (0, "banned"), (0, "allowed"), (0, "static"))
    step = ledger.apply_detections(hits, whitelist(spark, "allowed"), bans(spark, ban("banned", 1)), offenses(spark, ("q", 1, 1)), p, NOW)
    assert rows(step.active_bans, "client_ip", "domain") == [("a", "x.com"), ("banned", "x.com")]
    assert rows(step.history, "action", "client_ip") == [("BAN", "a")]
    assert rows(step.offenses, "client_ip", "offense_level") == [("a", 1), ("q", 1)]


def test_dry_run_only_writes_history(spark):
    step = ledger.apply_detections(found(spark, (0, "a"), (0, "a", "*.y.com", 99, "subdomain-flood")), whitelist(spark, "z"),
                                   bans(spark, ban("b")), offenses(spark, ("q", 1, 1)), P.with_(dry_run=True), NOW)
    assert rows(step.active_bans, "client_ip") == [("b",)]
    assert rows(step.history, "action", "client_ip", "duration", "reason") == [
        ("DRY", "a", "dry-run", "dry-run (rate-limit)"), ("DRY", "a", "dry-run", "dry-run (subdomain-flood)")]


def test_expiry_and_enforcement(spark):
    table = bans(spark, ban("due", NOW), ban("past", NOW - 1), ban("later", NOW + 7), ban("never", 0), ban("kept", NOW - 5, True),
                 ban("10.0.0.0/8", 0, True), ban("2001:db8::1", NOW + 9), ban("1.2.3.4", NOW - 1))
    step = ledger.expire_bans(table, NOW)
    assert rows(step.lifted, "client_ip") == [("1.2.3.4",), ("due",), ("past",)]
    assert rows(step.active_bans, "client_ip") == [("10.0.0.0/8",), ("2001:db8::1",), ("kept",), ("later",), ("never",)]
    assert rows(step.history.filter("client_ip = 'due'"), "action", "domain", "count", "duration", "protocol", "reason") == [
        ("UNBAN", "-", "-", "-", "-", "expired")]
    assert rows(ledger.enforcement_set(table, NOW)) == [(4, "10.0.0.0/8", 0), (6, "2001:db8::1", 9)]


def test_unban_leaves_a_row_without_a_ban(spark):
    who = spark.createDataFrame([("ghost",)], "client_ip string")
    assert rows(ledger.unban_rows(who, "manual", NOW), "action", "client_ip", "reason") == [("UNBAN", "ghost", "manual")]


def test_flushes(spark):
    table = bans(spark, ban("a"), ban("g", reason="geoip", source="geoip"), ban("m", reason="geoip", source="manual"),
                 ban("l", reason="external-blocklist", source="external-blocklist"))
    assert rows(ledger.flush_bans(table, NOW).history, "client_ip", "reason") == [(c, "manual-flush") for c in "aglm"]
    geo = ledger.flush_bans(table, NOW, "geoip")
    assert rows(geo.history, "client_ip", "reason") == [("g", "geoip-flush"), ("m", "geoip-flush")]
    lists = ledger.flush_bans(table, NOW, "external-blocklist")
    assert rows(lists.active_bans, "client_ip") == [("a",), ("g",), ("m",)]
    assert rows(lists.history, "reason") == [("external-blocklist-flush",)]


def test_geo_auto_unban(spark):
    table = bans(spark, ban("stays", reason="geoip", source="geoip", country="CN"), ban("mode", reason="geoip", country="CN", mode="allowlist"),
                 ban("freed", reason="geoip", country="DE"), ban("unknown", reason="geoip", mode=""), ban("other", country="DE"))
    on = P.with_(geoip_enabled=True, geoip_countries=("cn",))
    assert rows(ledger.lift_geo_bans(table, on, NOW).lifted, "client_ip") == [("freed",), ("mode",)]
    assert rows(ledger.lift_geo_bans(table, P, NOW).history, "client_ip", "reason") == [
        (c, "geoip-auto-unban") for c in ("freed", "mode", "stays", "unknown")]


def addresses(spark, *ips):
    return spark.createDataFrame([(ip,) for ip in ips], "address string")


def test_whitelist_sync(spark):
    step = ledger.whitelist_sync(bans(spark, ban("a"), ban("b")), whitelist(spark, "gone"), addresses(spark, "b", "c"), NOW)
    assert rows(step.whitelist) == [("b", "external"), ("c", "external")]
    assert rows(step.history, "client_ip", "reason") == [("b", "external-whitelist")]
    assert rows(step.active_bans, "client_ip") == [("a",)]


def test_emptied_good_list_lifts(spark):
    table = spark.createDataFrame([("gone", "external-blocklist")], "client_ip string, source string")
    table = table.withColumns({c: F.lit(v) for c, v in {
        "domain": "-", "count": 0, "ban_time": "", "ban_until_epoch": 0, "ban_duration": 0, "offense_level": 0, "is_permanent": True,
        "reason": "external-blocklist", "protocol": "-", "geoip_country": "", "geoip_mode": ""}.items()})
    empty, good = addresses(spark, "x").filter("false"), spark.createDataFrame([("list",)], "source_name string")
    kept = ledger.blocklist_sync(table, whitelist(spark, "z"), empty, P, NOW, good.filter("false"))
    lifted = ledger.blocklist_sync(table, whitelist(spark, "z"), empty, P, NOW, good)
    assert kept.active_bans.count() == 1 and lifted.active_bans.count() == 0


def test_emptied_copy_is_the_newest(spark):
    fetches = spark.createDataFrame([("a", 1, 200), ("a", 2, 200), ("b", 1, 503)], "source_name string, fetched_at int, status int")
    lines = spark.createDataFrame([("a", 1, 200, "1.2.3.4")], "source_name string, fetched_at int, status int, line string")
    entries = lists.parse_list(lists.list_latest_good(lines, fetches=fetches))
    desired = entries.select(F.col("entry").alias("address"))
    table = bans(spark, ban("1.2.3.4", source="external-blocklist"))
    step = ledger.blocklist_sync(table, whitelist(spark, "z"), desired, P, NOW, lists.good_copies(fetches))
    assert rows(step.history, "action", "client_ip") == [("UNBAN", "1.2.3.4")] and step.active_bans.count() == 0
    failed = lists.good_copies(fetches.filter("source_name = 'b'"))
    assert rows(ledger.blocklist_sync(table, whitelist(spark, "z"), desired, P, NOW, failed).history) == []


def test_blocklist_sync(spark):
    table = bans(spark, ban("listed", source="external-blocklist"), ban("dropped", source="external-blocklist"), ban("mine"))
    step = ledger.blocklist_sync(table, whitelist(spark, "allowed"), addresses(spark, "listed", "new", "allowed", "mine"), P, NOW, GOOD(spark))
    assert rows(step.history, "action", "client_ip", "count", "duration", "reason") == [
        ("BAN", "new", "-", "permanent", "external-blocklist"), ("UNBAN", "dropped", "-", "-", "external-blocklist-removed")]
    assert rows(step.active_bans, "client_ip") == [("listed",), ("mine",), ("new",)]
    timed = ledger.blocklist_sync(table, whitelist(spark, "z"), addresses(spark, "new"), P.with_(blocklist_duration=60, blocklist_auto_unban=False), NOW, GOOD(spark))
    assert rows(timed.opened, "client_ip", "ban_until_epoch", "is_permanent") == [("new", NOW + 60, False)]
    assert rows(timed.history, "action", "duration") == [("BAN", "60s")]


def test_blocklist_sync_compares_all_tables_in_one_pass(spark):
    table = bans(spark, ban("listed", source="external-blocklist"), ban("gone", source="external-blocklist"), ban("mine"), ban("noted", source=None))
    named = addresses(spark, "listed", "new", "new", "allowed", "mine", "home", None)
    allowed = spark.createDataFrame([("allowed", "a"), ("allowed", "b"), (None, "c")], WHITELIST)
    home = P.with_(whitelist=("home",))
    step = ledger.blocklist_sync(table, allowed, named, home, NOW, GOOD(spark))
    assert rows(step.history, "action", "client_ip") == [("BAN", "new"), ("UNBAN", "gone")]
    assert rows(step.active_bans, "client_ip") == [("listed",), ("mine",), ("new",), ("noted",)] and step.active_bans.columns == table.columns
    assert rows(step.lifted, "client_ip") == [("gone",)] and rows(step.opened, "client_ip") == [("new",)]
    dry = ledger.blocklist_sync(table, allowed, named, home.with_(dry_run=True), NOW, GOOD(spark))
    assert rows(dry.history, "action", "client_ip", "duration", "reason") == [
        ("DRY", ip, "dry-run", "dry-run (external-blocklist)") for ip in ("listed", "mine", "new")] + [("UNBAN", "gone", "-", "external-blocklist-removed")]
    assert rows(dry.active_bans, "client_ip") == [("listed",), ("mine",), ("noted",)] and dry.opened is None
    nobody = bans(spark, ban("x")).limit(0)
    assert rows(ledger.blocklist_sync(nobody, allowed.limit(0), named.limit(0), P, NOW, GOOD(spark)).history) == []
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        with_exchanges = ledger.blocklist_sync(table, allowed, named, home, NOW, GOOD(spark)).history
        plan = with_exchanges._jdf.queryExecution().executedPlan().toString()
        assert plan.count("Exchange hashpartitioning") == 3
        assert rows(with_exchanges, "action", "client_ip") == [("BAN", "new"), ("UNBAN", "gone")]
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_total_list_failure_lifts_nothing(spark):
    table = bans(spark, ban("listed", source="external-blocklist"))
    step = ledger.blocklist_sync(table, whitelist(spark, "z"), addresses(spark, "x").filter("false"), P, NOW, GOOD(spark).filter("false"))
    assert rows(step.history) == [] and rows(step.active_bans, "client_ip") == [("listed",)]


def test_manual_commands(spark):
    commands = spark.createDataFrame([
        (1, "new", "ban"), (2, "new", "ban"), (3, "new", "unban"), (4, "new", "ban"), (5, "allowed", "ban"), (6, "banned", "ban"),
        (7, "banned", "unban"), (8, "ghost", "unban"), (9, "off", "reset-offenses")], "seq int, target string, command string")
    table, allowed = bans(spark, ban("banned"), ban("idle")), whitelist(spark, "allowed")
    got = ledger.manual_actions(commands, table, allowed, NOW)
    assert rows(got, "action", "client_ip", "domain", "count", "duration") == sorted([
        ("BAN", "new", "manual", "0", "permanent"), ("BAN", "new", "manual", "0", "permanent"), ("UNBAN", "new", "-", "-", "-"),
        ("UNBAN", "banned", "-", "-", "-"), ("UNBAN", "ghost", "-", "-", "-")])
    assert rows(ledger.manual_ban_rows(commands, table, allowed, P, NOW), "client_ip", "reason", "is_permanent") == [
        ("idle", "rate-limit", False), ("new", "manual", True)]
    counters = offenses(spark, ("off", 1, 1), ("on", 1, 1))
    assert rows(ledger.reset_offenses(counters, commands), "client_ip") == [("on",)]
    everything = spark.createDataFrame([(1, "", "reset-offenses")], "seq int, target string, command string")
    assert rows(ledger.reset_offenses(counters, everything)) == []
    assert rows(ledger.whitelist_flush(whitelist(spark, "a"))) == []


def test_offense_age_edges(spark):
    table = offenses(spark, ("young", 1, NOW - 999), ("edge", 1, NOW - 1000), ("old", 1, NOW - 1001))
    assert rows(ban_tables.expired_offenses(table, 1000, NOW), "client_ip") == [("edge",), ("old",)]
    assert rows(ban_tables.offense_cleanup(table, 1000, NOW), "client_ip") == [("young",)]
    assert rows(ban_tables.offense_status(table, 1000, NOW)) == [(3, 2)]


def test_whitelist_matching(spark):
    clients = spark.createDataFrame([(c,) for c in ("10.1.2.3", "10.0.0.0/8", "11.0.0.1", "2001:db8::5")], "client string")
    listed = whitelist(spark, "10.0.0.0/8", "2001:db8::/32")
    assert rows(membership.whitelist_exclude(clients, listed)) == [("10.1.2.3",), ("11.0.0.1",), ("2001:db8::5",)]
    assert rows(membership.whitelist_exclude(clients, listed, match="cidr")) == [("11.0.0.1",)]


def test_upsert_replaces_whole_rows(spark):
    got = tables.upsert(bans(spark, ban("a", 5), ban("b", 6)), bans(spark, ban("a", 9)), ["client_ip"])
    assert rows(got, "client_ip", "ban_until_epoch") == [("a", 9), ("b", 6)]
    clients = spark.createDataFrame([("a",), ("z",)], "client string")
    assert rows(ban_tables.ban_exists(clients, got)) == [("a",)]


def brute_replay(hits, p):
    out = []
    state = {}
    for t, client, permanent in sorted(hits):
        level, last, until, banned = state.get(client, (0, 0, 0, False))
        if banned and (until is None or t < until):
            continue
        if banned:
            out.append((until, "UNBAN", client, 0))
        length, shown = p.ban_duration, 0
        if not permanent:
            level = 1 if level == 0 or t - last > p.progressive_reset_after else level + 1
            last, shown = t, level
            length = p.ban_duration * p.progressive_multiplier ** (level - 1)
            permanent = 0 < p.progressive_max_level <= level
        state[client] = (level, last, None if permanent else t + length, True)
        out.append((t, "BAN", client, shown))
    out += [(s[2], "UNBAN", c, 0) for c, s in state.items() if s[2] is not None]
    return sorted(out)


@pytest.mark.parametrize("top", [0, 4])
def test_replay_matches_a_plain_walk(spark, top):
    p = P.with_(progressive_max_level=top, progressive_reset_after=700)
    rng = random.Random(top)
    hits = [(rng.randrange(20_000), rng.choice(["hot", "hot", "a", "b", "c"]), rng.random() < 0.01) for _ in range(600)]
    hits = sorted({(t, c): (t, c, f) for t, c, f in hits}.values())
    df = found(spark, *[(t, c, "x.com", 9, "rate-limit", "monitor", f) for t, c, f in hits])
    base = int((T0 - T0.replace(year=1970)).total_seconds())
    got = [(e - base, a, c, lvl if a == "BAN" else 0) for e, a, c, lvl in rows(
        ledger.ledger_replay(df.repartition(7), p), "timestamp_epoch", "action", "client_ip", "offense_level")]
    assert sorted(got) == brute_replay(hits, p)


def test_replay_state_crosses_batches(spark):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "3")
    try:
        df = found(spark, *[(t, "hot") for t in range(0, 400, 10)])
        got = ledger.replay_bans(df, P.with_(progressive_max_level=0))
        assert [r[0] for r in got.orderBy("at_epoch").select(F.col("at_epoch") - F.min("at_epoch").over(
            __import__("pyspark").sql.Window.partitionBy("client"))).collect()] == [0, 100, 300]
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_replay_within_one_second(spark):
    df = spark.createDataFrame([
        (at(5, 900), "c", "late.com", 99, "dns", "rate-limit", "monitor", False, ""), (at(5, 100), "c", "*.x.com", 99, "dns", "subdomain-flood", "monitor", False, ""),
        (at(5, 100), "c", "rate.com", 4, "dns", "rate-limit", "monitor", False, "")], DETECTIONS)
    assert rows(ledger.replay_bans(df, P), "target", "n") == [("rate.com", 4)]


def test_replay_horizon_and_lag(spark):
    df = found(spark, (0, "c"), (100, "c"), (130, "c"))
    base = int((T0 - T0.replace(year=1970)).total_seconds())
    got = ledger.ledger_replay(df, P.with_(sweep_lag=10), horizon=base + 100)
    assert rows(got.select((F.col("timestamp_epoch") - base).alias("t"), "action")) == [(0, "BAN"), (100, "UNBAN"), (130, "BAN")]


def random_hits(spark, seed, n=400, span=6000):
    rng = random.Random(seed)
    made = []
    for t in sorted(rng.sample(range(span), n)):
        permanent = rng.random() < 0.01
        made.append((t, f"c{min(rng.randrange(9), 5)}", "x.com", rng.randrange(9), "rate-limit", rng.choice(["monitor"] * 4 + ["geoip"]), permanent))
    return found(spark, *made)


@pytest.mark.parametrize("lag,cuts", [(0, (2000,)), (7, (1500, 1501, 4000))])
def test_steps_with_the_state_passed_on_equal_the_whole(spark, lag, cuts):
    params = P.with_(sweep_lag=lag, progressive_max_level=5, progressive_reset_after=700)
    hits = random_hits(spark, 5)
    zero = hits.select(F.unix_seconds(F.lit(at(0)))).first()[0]
    whole = ledger.replay_step(hits, bans(spark), offenses(spark), params, zero + 9000)
    table, past, written, since = bans(spark), offenses(spark), [], -1
    for cut in (*cuts, 9000):
        part = hits.filter(F.unix_seconds("at").between(zero + since + 1, zero + cut))
        step = ledger.replay_step(part, table, past, params, zero + cut)
        written += rows(step.history)
        # as written tables would come back
        table = spark.createDataFrame(step.active_bans.collect(), step.active_bans.schema)
        past, since = spark.createDataFrame(step.offenses.collect(), step.offenses.schema), cut
    assert sorted(written) == rows(whole.history) and any(r[2] == "UNBAN" for r in written)
    assert rows(table) == rows(whole.active_bans) and rows(past) == rows(whole.offenses)
    fresh = ledger.ledger_replay(hits, params, zero + 9000).drop("offense_level")
    assert rows(fresh, *whole.history.columns) == rows(whole.history)


def test_dry_runs_ban_nobody(spark):
    dry, hits = P.with_(dry_run=True), random_hits(spark, 6, n=20)
    assert ledger.replay_bans(hits, dry).count() == 0
    got = ledger.ledger_replay(hits, dry)
    assert got.count() == 20 and {r.action for r in got.collect()} == {"DRY"}
    step = ledger.replay_step(hits, bans(spark, ban("z")), offenses(spark, ("z", 1, 5)), dry, NOW * 2)
    assert rows(step.active_bans, "client_ip") == [("z",)] and step.history.count() == 20 and step.offenses.count() == 1
    orders = spark.createDataFrame([(1, "a", "ban"), (2, "a", "ban"), (3, "b", "unban"), (4, "b", "ban"), (5, "b", "ban"), (6, "c", "ban")], "seq int, target string, command string")
    table = bans(spark, ban("b"), ban("c"))
    assert rows(ledger.manual_actions(orders, table, whitelist(spark, "z"), NOW, dry), "action", "client_ip") == [
        ("DRY", "a"), ("DRY", "a"), ("DRY", "b"), ("DRY", "b"), ("UNBAN", "b")]
    assert rows(ledger.manual_ban_rows(orders, table, whitelist(spark, "z"), dry, NOW), "client_ip") == [("c",)]


def counted(spark, hits):
    """The detections, and how many of them have been worked out so far, over all uses."""
    seen = spark.sparkContext.accumulator(0)

    def count(batches):
        for batch in batches:
            seen.add(len(batch))
            yield batch

    return hits.mapInPandas(count, hits.schema), seen


@pytest.mark.parametrize("name", ["ledger_replay_steps", "report_bundle"])
def test_queries_of_steps_detect_once(spark, monkeypatch, name):
    rng = random.Random(7)
    drawn = {(rng.randrange(29 * DAY), rng.choice("abcde")) for _ in range(120)}
    hits, seen = counted(spark, found(spark, *sorted(drawn)))
    monkeypatch.setattr(catalog, "_watched_hits", lambda t: hits)
    got = catalog.QUERIES[name](spark, "unused")
    shown = got.collect()
    assert seen.value == len(drawn)
    whole = ledger.ledger_replay(found(spark, *sorted(drawn)), catalog.WATCHED, catalog.LOG_END).drop("offense_level")
    if name == "ledger_replay_steps":
        assert rows(got, *whole.columns) == rows(whole)
        assert {r.timestamp_epoch > AS_OF_EPOCH - 5 * DAY for r in shown} == {True, False}
    else:
        within = whole.filter(F.col("timestamp_epoch").between(catalog.LOG_SINCE, catalog.LOG_UNTIL) & (F.col("action") == "BAN"))
        assert ("kpis", "total_bans", within.count()) in shown and not within.isEmpty()


def test_step_kept_in_a_folder_folds_once(spark, tmp_path):
    past, raised = bans(spark, ban("c1", permanent=True), ban("c2", 5), ban("idle", 5)), offenses(spark, ("c2", 1, 5), ("idle", 2, 5))
    plain = random_hits(spark, 8)
    hits, seen = counted(spark, plain)
    step = ledger.replay_step(hits, past, raised, P, NOW * 2, str(tmp_path / "opened"))
    made = seen.value
    want = ledger.replay_step(plain, past, raised, P, NOW * 2)
    for table in ("history", "active_bans", "offenses", "opened", "lifted"):
        assert rows(getattr(step, table).fillna("")) == rows(getattr(want, table).fillna("")), table
    assert seen.value == made <= 2 * plain.count()
