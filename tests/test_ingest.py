import json

from tests.helpers import at, events, rows
from tidewarden.params import Params
from tidewarden.schemas import QUERY_ITEM
from tidewarden.sources import lists, logs, querylog, tables
from tidewarden.sources.geo import load_geo_ranges


def item(time="2024-01-01T00:00:00Z", client="1.1.1.1", proto="doh", ip="2.2.2.2", name="a.example.com", host="h.example.com"):
    return {"time": time, "client": client, "client_proto": proto, "client_info": {"ip": ip}, "question": {"name": name, "host": host}}


def normalized(spark, *items):
    return querylog.normalize_queries(spark.createDataFrame(list(items), QUERY_ITEM))


def test_envelope_reader(spark, tmp_path):
    (tmp_path / "log.json").write_text(json.dumps({"data": [item(), item(client="3.3.3.3")], "oldest": "x"}, indent=1))
    got = querylog.read_query_log(spark, str(tmp_path))
    assert rows(got, "client", "client_info.ip", "question.name") == [
        ("1.1.1.1", "2.2.2.2", "a.example.com"), ("3.3.3.3", "2.2.2.2", "a.example.com")]


def test_line_reader(spark, tmp_path):
    (tmp_path / "log.jsonl").write_text("\n".join(json.dumps(item(client=c)) for c in ("1.1.1.1", "9.9.9.9")))
    assert rows(querylog.normalize_queries(querylog.read_query_lines(spark, str(tmp_path))), "client") == [("1.1.1.1",), ("9.9.9.9",)]


def test_normalize_fields(spark):
    got = normalized(
        spark, item(), item(client=" \t", ip=" 4.4.4.4 "), item(name="", host="H.Example.COM."), item(name="two.dots.."),
        item(proto=""), item(client="", ip=" "), item(name="", host=""), item(name="."), item(name=" lead.com"))
    assert rows(got, "client", "domain", "protocol") == sorted([
        ("1.1.1.1", "a.example.com", "doh"), ("4.4.4.4", "a.example.com", "doh"), ("1.1.1.1", "h.example.com", "doh"),
        ("1.1.1.1", "two.dots.", "doh"), ("1.1.1.1", "a.example.com", "dns"), ("1.1.1.1", " lead.com", "doh")])


def test_normalize_times(spark):
    good = ["2024-01-01T00:00:00.123456789Z", "2024-01-01T00:00:00.123456789987Z", "2024-01-01T01:00:00+01:00", "2024-01-01T00:00:00,5Z"]
    bad = ["2024-01-01 00:00:00Z", "2024-01-01T00:00:00", "2024-01-01", "not-a-time", "2024-02-30T00:00:00Z", "2024-01-01T25:00:00Z", None]
    got = normalized(spark, *[item(time=t) for t in good + bad])
    assert rows(got, "at", "at_ns") == [(at(0), 0), (at(0, 123456), 789), (at(0, 123456), 789), (at(0, 500000), 0)]


def test_dedupe_keeps_nanoseconds_and_joins_offsets(spark):
    got = querylog.dedupe_queries(normalized(
        spark, item(), item(), item(time="2024-01-01T02:00:00+02:00"), item(time="2024-01-01T00:00:00.000000001Z"), item(proto="dot")))
    assert rows(got, "at", "at_ns", "protocol") == [(at(0), 0, "doh"), (at(0), 0, "dot"), (at(0), 1, "doh")]


def test_retention_is_strict(spark):
    p = Params(rate_limit_window=60, subdomain_flood_window=20)
    kept = querylog.retain_recent(events(spark, [(10, "c", "on-the-edge"), (11, "c", "inside")]), p, at(100))
    assert rows(kept, "domain") == [("inside",)]
    assert rows(querylog.distinct_clients(events(spark, [(1, "a", "x"), (2, "a", "y"), (3, "b", "x")]))) == [("a",), ("b",)]


def test_parse_list(spark):
    want = {
        "1.2.3.4 # comment": "1.2.3.4", "0.0.0.0 bad.example": "bad.example", "2001:db8::/32": "2001:db8::/32",
        "﻿5.6.7.8": "5.6.7.8", "h.example ; note": "h.example", "127.0.1.1 host x": "host", "::1 localhost": "localhost",
        "0.0.0.0": "0.0.0.0", "\t9.9.9.9\t": "9.9.9.9", "::": "::",
    }
    dropped = ["http://example.invalid/list", "﻿# x", "", "a b", "1.2.3.4:80", "#a", ";a", "a..b", "a/b", "0.0.0.0 http://x.y"]
    lines = spark.createDataFrame([("s", line) for line in [*want, *dropped]], "source_name string, line string")
    assert dict(rows(lists.parse_list(lines), "line", "entry")) == want


def test_list_files_resolve_and_fall_back(spark, tmp_path):
    (tmp_path / "a.txt").write_text("1.2.3.4\nhost.example\n")
    read = lists.read_list(spark, str(tmp_path))
    assert rows(lists.parse_list(read), "entry") == [("1.2.3.4",), ("host.example",)]
    entries = spark.createDataFrame([("s", e) for e in ("0.0.0.0", "10.0.0.0/8", "h", "gone", "h2")], "source_name string, entry string")
    answers = spark.createDataFrame([("h", "9.9.9.9"), ("h", "0.0.0.0"), ("h", "2001:db8::1"), ("h2", "::"), ("h2", "junk")], "host string, address string")
    assert rows(lists.list_desired_set(lists.resolve_list(entries, answers))) == [("0.0.0.0",), ("10.0.0.0/8",), ("2001:db8::1",), ("9.9.9.9",)]
    copies = spark.createDataFrame(
        [("a", 1, 200, "old"), ("a", 2, 200, "new"), ("b", 1, 200, "kept"), ("b", 2, 304, None), ("c", 1, 503, None)],
        "source_name string, fetched_at int, status int, line string")
    assert rows(lists.list_latest_good(copies), "source_name", "line") == [("a", "new"), ("b", "kept")]


def test_history_table_prunes_days(spark, tmp_path):
    path = str(tmp_path / "history")
    made = spark.createDataFrame([(100, "BAN", "c"), (90_000, "BAN", "d")], "timestamp_epoch long, action string, client_ip string")
    tables.history_append(made, path, "r", 0)
    tables.history_append(made.filter("client_ip = 'd'"), path, "r", 1)
    assert rows(tables.read_history(spark, path, 80_000, 100_000), "client_ip") == [("d",), ("d",)]
    plan = tables.read_history(spark, path, 80_000)._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(day" in plan


def test_snapshots_move_on_when_complete(spark, tmp_path):
    from tidewarden.schemas import WHITELIST

    path = str(tmp_path / "whitelist")
    assert tables.read_snapshot(spark, path, WHITELIST).count() == 0
    first = spark.createDataFrame([("1.1.1.1", "external"), ("2.2.2.2", "static"), ("3.3.3.3", None)], WHITELIST)
    assert tables.write_snapshot(first, path) == 1
    fresh = spark.createDataFrame([("2.2.2.2",), ("9.9.9.9",), ("9.9.9.9",)], "address string")
    swapped = tables.whitelist_replace(tables.read_snapshot(spark, path, WHITELIST), fresh, "external")
    assert tables.write_snapshot(swapped, path) == 2
    (tmp_path / "whitelist" / "version=3").mkdir()
    assert rows(tables.read_snapshot(spark, path, WHITELIST)) == [("2.2.2.2", "static"), ("9.9.9.9", "external")]
    assert tables.read_snapshot(spark, path, WHITELIST, before=2).count() == 3


def test_log_text(spark, tmp_path):
    (tmp_path / "s.log").write_text("2024/01/02 03:04:05 [WARN] one\n[2024-01-02 03:04:06] [INFO] two\nno time\n")
    got = logs.parse_log_lines(logs.read_log(spark, str(tmp_path)))
    assert [tuple(r) for r in got.orderBy("line_no").select("level", "message").collect()] == [("WARN", "one"), ("INFO", "two"), ("INFO", "no time")]
    assert [r[0] is None for r in got.orderBy("line_no").select("logged_at").collect()] == [False, False, True]


def test_geo_ranges_from_csv(spark, tmp_path):
    (tmp_path / "g.csv").write_text("network,country_iso,registered_iso\n203.0.0.0/8,DE,DE\n")
    assert rows(load_geo_ranges(spark, str(tmp_path))) == [("203.0.0.0/8", "DE", "DE")]


def test_names_resolve_without_case_and_any_2xx_is_good(spark):
    entries = spark.createDataFrame([("l", "Bad.Example.")], "source_name string, entry string")
    answers = spark.createDataFrame([("bad.example", "9.9.9.9")], "host string, address string")
    assert rows(lists.resolve_list(entries, answers), "entry", "address") == [("Bad.Example.", "9.9.9.9")]
    copies = spark.createDataFrame([("a", 1, 200, "old"), ("a", 2, 203, "new"), ("a", 3, 304, "")], "source_name string, fetched_at int, status int, line string")
    assert rows(lists.list_latest_good(copies), "line") == [("new",)]
