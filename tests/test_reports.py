from datetime import datetime, timedelta

import pytest
from pyspark.sql import types as T

from tests.helpers import at, events, rows
from tidewarden.operators import bans, live, outbox, report
from tidewarden.params import Params
from tidewarden.schemas import ACTIVE_BANS, BAN_HISTORY, OFFENSES, WHITELIST
from tidewarden.sources.logs import read_log

NOW = datetime(2024, 5, 10, 21)
HISTORY = T.StructType([T.StructField("id", T.LongType()), *BAN_HISTORY.fields])


def history(spark, *made):
    """Rows of (time, action, client, domain, duration, protocol, reason)."""
    full = [(i, report.epoch(t), f"{t:%Y-%m-%d %H:%M:%S}", action, ip, domain, "42", duration, proto, reason)
            for i, (t, action, ip, domain, duration, proto, reason) in enumerate(made)]
    return spark.createDataFrame(full, HISTORY)


def active(spark, *made):
    full = [(ip, "block.example", 110, "t", until, seconds, level, permanent, reason, "dns", source, country, mode)
            for ip, until, seconds, level, permanent, reason, source, country, mode in made]
    return spark.createDataFrame(full, ACTIVE_BANS)


@pytest.fixture(scope="module")
def sample(spark):
    noon = datetime(2024, 5, 9, 12)
    made = [(noon, "BAN", "1.2.3.4", "example.com", "3600s", "DNS", "rate-limit"),
            (noon + timedelta(hours=1), "BAN", "1.2.3.4", "example.com", "permanent", "DoH", "subdomain-flood"),
            (noon + timedelta(hours=2), "BAN", "5.6.7.8", "block.example", "permanent", "DoT", "external-blocklist"),
            (noon + timedelta(hours=4), "UNBAN", "1.2.3.4", "-", "-", "-", "manual")]
    bans_now = active(spark, ("5.6.7.8", 0, 0, 0, True, "external-blocklist", "external-blocklist", "", ""))
    return history(spark, *made), bans_now


def test_window_and_kpis(spark, sample):
    past, now = sample
    since, until, label = report.report_window("weekly", NOW)
    assert (since, until, label) == (report.epoch(datetime(2024, 5, 3)), report.epoch(datetime(2024, 5, 10)) - 1, "Wochenbericht: 03.05.2024 - 09.05.2024")
    assert report.report_window("daily", NOW)[2] == "Tagesbericht: 09.05.2024"
    assert report.report_window("biweekly", NOW)[2] == "Zweiwochenbericht: 26.04.2024 - 09.05.2024"
    assert report.report_window("odd", NOW)[2].startswith("Bericht: 03.05.2024")
    assert report.report_kpis(past, now, since, until).collect()[0].asDict() == {
        "total_bans": 3, "total_unbans": 1, "unique_ips": 2, "permanent_bans": 2, "rate_limit_bans": 1,
        "subdomain_flood_bans": 1, "external_blocklist_bans": 1, "active_bans": 1}


def test_range_is_closed(spark):
    t = datetime(2024, 5, 1)
    past = history(spark, *[(t + timedelta(seconds=i), "BAN", "c", "d", None, None, None) for i in range(4)])
    s = report.epoch(t)
    assert report.report_kpis(past, active(spark), s + 1, s + 2).collect()[0].total_bans == 2


def test_busiest_day_tie_goes_to_the_later_day(spark):
    past = history(spark, *[(datetime(2024, 5, d), "BAN", "c", "d", None, None, None) for d in (1, 1, 3, 3, 2)])
    assert rows(report.report_busiest_day(past, 0, 2**40)) == [("2024-05-03", 2)]
    assert report.busiest_since(Params(report_busiest_day_range=0), NOW, 5) == 5
    assert report.busiest_since(Params(), NOW, 5) == report.epoch(datetime(2024, 4, 10))


def test_lists(spark):
    t = datetime(2024, 5, 1)
    made = [(t, "BAN", f"10.0.0.{i % 25}", [None, "", "-", "d.com", "e.com"][i % 5], None, [None, "", "doh"][i % 3], [None, "", "geoip"][i % 3])
            for i in range(60)]
    past = history(spark, *made)
    top = report.with_bars(report.report_top_clients(past, 0, 2**40)).orderBy("rank").collect()
    assert len(top) == 20 and top[0].asDict() == {"name": "10.0.0.0", "n": 3, "rank": 1, "width": 100, "top3": True}
    assert top[10].asDict() == {"name": "10.0.0.10", "n": 2, "rank": 11, "width": 66, "top3": False} or top[10].n == 2
    assert rows(report.report_top_domains(past, 0, 2**40)) == [("d.com", 12), ("e.com", 12)]
    assert rows(report.report_protocols(past, 0, 2**40)) == [("doh", 20, "doh"), ("unbekannt", 40, "")]
    assert rows(report.report_reasons(past, 0, 2**40)) == [("geoip", 20), ("unknown", 40)]
    recent = report.report_recent_bans(past, 0, 2**40).collect()
    assert [r.id for r in recent] == list(range(59, 49, -1)) and {r.reason for r in recent} == {"rate-limit", "geoip"}
    assert [r.id for r in bans.history_recent(past, 3).collect()] == [59, 58, 57]


def test_overview_of_nothing_is_zeros(spark):
    got = report.report_period_overview(history(spark), NOW)
    assert rows(got) == [(i, label, 0, 0, 0, 0) for i, label in enumerate(["Heute", "Gestern", "Letzte 7 Tage", "Letzte 14 Tage", "Letzte 30 Tage"])]
    assert [p[0] for p in report.overview_periods(datetime(2024, 5, 10, 19))][0] == "Gestern"


def test_overview_counts_clients_once_per_period(spark, sample):
    got = report.report_period_overview(sample[0], NOW)
    assert rows(got)[:3] == [(0, "Heute", 0, 0, 0, 0), (1, "Gestern", 3, 1, 2, 2), (2, "Letzte 7 Tage", 3, 1, 2, 2)]


def test_abuse_reports_and_bundle(spark, sample, tmp_path):
    (tmp_path / "x.log").write_text("\n".join([
        "[2024-05-09 10:00:00] [INFO] AbuseIPDB: 5.6.7.8 erfolgreich gemeldet", "2024/05/09 11:00:00 [INFO] AbuseIPDB: 5.6.7.8 erfolgreich gemeldet",
        "[2024-05-01 10:00:00] [INFO] AbuseIPDB: 5.6.7.8 erfolgreich gemeldet", "[2024-05-09 10:00:00] [INFO] AbuseIPDB: HTTP 500", "AbuseIPDB: x erfolgreich gemeldet"]))
    tables = report.report_bundle(*sample, read_log(spark, str(tmp_path)), Params(), NOW)
    assert rows(tables["abuse_reports"]) == [(2,)]
    report.write_report(tables, str(tmp_path / "out"))
    assert spark.read.parquet(str(tmp_path / "out" / "kpis")).first().total_bans == 3
    assert set(tables) == {"kpis", "busiest_day", "top_clients", "top_domains", "protocols", "reasons", "sources", "recent_bans", "recent_events",
                           "period_overview", "abuse_reports"}


def test_lists_of_one_pass_equal_the_single_ones(spark):
    def found(df, *columns):  # names may be null
        return sorted((tuple(r) for r in (df.select(*columns) if columns else df).collect()), key=repr)

    day = timedelta(days=1)
    made = [(NOW - day * (i % 9), "UNBAN" if i % 11 == 0 else "BAN", None if i % 13 == 0 else f"9.9.9.{i % 37}", ["a.com", "", "-", None, f"d{i % 29}.net"][i % 5],
             "1h 0m", ["dns", "", None, "doh"][i % 4], ["rate-limit", None, "", "geoip"][i % 4]) for i in range(300)]
    past = history(spark, *made)
    until, since, day_since = report.epoch(NOW - day), report.epoch(NOW - day * 5), report.epoch(NOW - day * 8)
    lists = report.report_lists(past, since, until, day_since)
    for name, single in (("top_clients", report.report_top_clients), ("top_domains", report.report_top_domains)):
        want = found(report.with_bars(single(past, since, until)), "name", "n", "rank", "width", "top3")
        assert found(lists.filter(lists.list == name), "name", "n", "rank", "width", "top3") == want and len(want) == 20
    for name, single in (("protocols", report.report_protocols), ("reasons", report.report_reasons)):
        assert found(lists.filter(lists.list == name), "name", "n") == found(single(past, since, until), "name", "n")
    assert found(lists.filter("list = 'busiest_day'"), "name", "n") == found(report.report_busiest_day(past, day_since, until))
    assert found(report.report_lists(past, since, until).filter("list = 'busiest_day'"), "name") == found(report.report_busiest_day(past, since, until), "day")
    assert report.report_lists(past.limit(0), since, until).count() == 0


def test_live_tables(spark, tmp_path):
    p = Params(rate_limit_window=60, subdomain_flood_window=60, progressive_reset_after=100)
    log = events(spark, [(0, "a", "p.x.com", "doh"), (1, "a", "p.x.com", "dns"), (2, "a", "q.x.com", "dns"), (3, "b", "p.x.com", "odd"),
                         (4, "b", "p.x.com", "dot"), (5, "c", "x.com", "dns"), (-100, "z", "x.com", "dns")])
    assert [tuple(r) for r in live.live_top_pairs(log, p, at(10), 3).collect()] == [
        ("a", "p.x.com", 2, "DNS,DoH"), ("b", "p.x.com", 2, "DoT,odd"), ("a", "q.x.com", 1, "DNS")]
    assert [tuple(r) for r in live.live_top_subdomain_groups(log, p, at(10)).collect()] == [("a", "x.com", 2, "DNS,DoH"), ("b", "x.com", 1, "DoT,odd")]
    assert [r.domain for r in live.live_recent_queries(log, 2).collect()] == ["x.com", "p.x.com"]
    table = active(spark, ("a", 1700000000, 1, 0, False, "external-blocklist-x", "monitor", "", ""), ("b", 0, 0, 0, True, "geoip", "external-blocklist", "", ""))
    assert rows(live.live_active_bans(table, 1, newest="client_ip")) == [("b", "external-blocklist", "geoip", "permanent", 1)]
    counters = live.live_counters(log, table, spark.createDataFrame([("a", 1, 900, "", ""), ("b", 1, 901, "", "")], OFFENSES),
                                  spark.createDataFrame([("w", "s")], WHITELIST), p, 1000)
    assert counters.collect()[0].asDict() == {"log_rows": 7, "offenses": 2, "expired_offenses": 1, "whitelist_size": 1, "active_bans": 2,
                                              "blocklist_bans": 1, "geoip_bans": 1}
    (tmp_path / "x.log").write_text("\n".join(f"{i} [{lvl}]" for i, lvl in enumerate(["WARN", "INFO", "ERROR", "DEBUG", "WARN", "X"])))
    lines = read_log(spark, str(tmp_path))
    assert [r.line for r in live.recent_log_lines(lines, "warn", 2).collect()] == ["2 [ERROR]", "4 [WARN]"]
    assert [r.line for r in live.recent_log_lines(lines, "info", 2).collect()] == ["4 [WARN]", "5 [X]"]
    assert live.recent_log_lines(lines, "off").count() == 0


def test_outbox(spark):
    p = Params(rate_limit_window=60, subdomain_flood_window=120, progressive_max_level=3, abuse_enabled=True, geoip_notify=False, host_name="h")
    table = active(spark, ("1.1.1.1", 0, 0, 3, True, "rate-limit", "monitor", "", ""), ("2.2.2.2", 9, 3600, 1, False, "rate-limit", "monitor", "", ""),
                   ("3.3.3.3", 0, 0, 0, True, "geoip", "geoip", "CN", "allowlist"), ("4.4.4.4", 0, 0, 0, True, "external-blocklist", "external-blocklist", "", ""))
    past = history(spark, (NOW, "UNBAN", "4.4.4.4", "-", "-", "-", "external-blocklist-removed"), (NOW, "UNBAN", "5.5.5.5", "-", "-", "-", "manual-flush"),
                   (NOW, "UNBAN", "6.6.6.6", "-", "-", "-", "manual-flush"), (NOW, "BAN", "7.7.7.7", "-", "-", "-", "x"))
    got = {(r.client_ip, r.action): r for r in outbox.alert_outbox(table, past, p).collect()}
    assert set(got) == {("1.1.1.1", "ban"), ("2.2.2.2", "ban"), ("4.4.4.4", "unban"), ("", "manual-flush")}
    assert got["1.1.1.1", "ban"].message.split("\n") == [
        "🚫 DNS Guard Ban auf h", "⚠️ IP wurde an AbuseIPDB gemeldet", "---", "IP: 1.1.1.1", "Hostname: (unbekannt)",
        "Grund: 110x block.example in 60s via DNS, Rate-Limit", "Dauer: PERMANENT [Stufe 3/3]", "", "AbuseIPDB: https://www.abuseipdb.com/check/1.1.1.1"]
    assert "Dauer: 1h 0m [Stufe 1/3]" in got["2.2.2.2", "ban"].message
    assert "Freigegebene IPs: 2\nAktion: Manual-Flush" in got["", "manual-flush"].message
    assert '"action":"unban"' in got["4.4.4.4", "unban"].payload and "DNS Guard Freigabe" in got["4.4.4.4", "unban"].payload
    geo = outbox.ban_alerts(table, p.with_(geoip_notify=True, notify_type="slack")).filter("client_ip = '3.3.3.3'").first()
    assert "Land: CN\nModus: Allowlist\nDauer: PERMANENT" in geo.message and geo.payload.startswith('{"text":"')
    assert rows(outbox.abuse_candidates(table, p), "ip", "categories") == [("1.1.1.1", "4")]
    assert outbox.abuse_candidates(table, p.with_(abuse_enabled=False)).count() == 0
    assert outbox.alert_outbox(table, past, p.with_(notify_enabled=False)).count() == 0
    assert outbox.flush_alerts(past.filter("action = 'BAN'"), p).count() == 0
