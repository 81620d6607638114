import json
import random
import re

from tests.helpers import at, events, rows
from tidewarden.operators import detect, ledger
from tidewarden.params import Params
from tidewarden.schemas import DETECTIONS, WHITELIST
from tidewarden.sources import tables
from tidewarden.sources.querylog import stream_query_lines
from tidewarden.streaming import detect as live_detect
from tidewarden.streaming import ledger as live_ledger

P = Params(rate_limit_max_requests=2, rate_limit_window=60, check_interval=20, subdomain_flood_max_unique=2, subdomain_flood_window=60,
           ban_duration=50, progressive_max_level=4, progressive_reset_after=300)


def log_files(folder, files=4, per_file=60, span=100):
    """JSON lines in time order, with rows repeated from one file to the next."""
    folder.mkdir()
    rng, previous, plain = random.Random(1), [], []
    for i in range(files):
        fresh = [(i * span + rng.randrange(span), rng.choice(["hot", "hot", "b"]), rng.choice(["p.x.com", "q.x.com", "r.x.com", "x.com"]), "doh") for _ in range(per_file)]
        plain += fresh
        lines = [json.dumps({"time": at(t).isoformat() + "Z", "client": c, "client_proto": p, "client_info": {"ip": ""}, "question": {"name": d, "host": ""}})
                 for t, c, d, p in previous[-10:] + fresh]
        (folder / f"{i}.json").write_text("\n".join(lines))
        previous = fresh
    # a far later query closes every window
    (folder / "z.json").write_text(json.dumps({"time": at(10_000).isoformat() + "Z", "client": "end", "client_proto": "", "client_info": {"ip": ""},
                                               "question": {"name": "end.com", "host": ""}}))
    return sorted(set(plain))


def run(stream, tmp_path, name, batch=None):
    writer = stream.writeStream.outputMode("append").option("checkpointLocation", str(tmp_path / f"cp-{name}")).trigger(availableNow=True)
    writer = writer.foreachBatch(batch) if batch else writer.format("parquet").option("path", str(tmp_path / name))
    query = writer.start()
    query.awaitTermination(240)
    assert query.exception() is None


def test_stream_ticks_equal_batch_ticks(spark, tmp_path):
    plain = log_files(tmp_path / "log")
    for name, streamed, batch in [("rate", live_detect.stream_rate_limit_ticks, detect.rate_limit_ticks),
                                  ("flood", live_detect.stream_subdomain_flood_ticks, detect.subdomain_flood_ticks)]:
        source = live_detect.stream_events(stream_query_lines(spark, str(tmp_path / "log"), files_per_trigger=1), P)
        run(streamed(source, P), tmp_path, name)
        want = rows(batch(events(spark, plain), P), *detect.DETECTION_COLUMNS)
        assert rows(spark.read.parquet(str(tmp_path / name)), *detect.DETECTION_COLUMNS) == want and want


def test_streamed_queries_are_not_copied_into_windows(spark, tmp_path):
    """A query per second in windows of 60 s every 20 s and every 25 s: windows take counts of panes of 20 s and 5 s."""
    (tmp_path / "log").mkdir()
    lines = [json.dumps({"time": at(t).isoformat() + "Z", "client": "c", "client_proto": "", "client_info": {"ip": ""}, "question": {"name": f"n{t % 7}.x.com", "host": ""}})
             for t in [*range(300), 10_000]]
    (tmp_path / "log" / "a.json").write_text("\n".join(lines))
    plain = events(spark, [(t, "c", f"n{t % 7}.x.com", "dns") for t in range(300)])
    for hop in (20, 25):
        params = P.with_(check_interval=hop, rate_limit_max_requests=3)
        for name, streamed, batch in [("rate", live_detect.stream_rate_limit_ticks, detect.rate_limit_ticks),
                                      ("flood", live_detect.stream_subdomain_flood_ticks, detect.subdomain_flood_ticks)]:
            found = streamed(live_detect.stream_events(stream_query_lines(spark, str(tmp_path / "log")), params), params)
            nodes = re.findall(r"(Aggregate|Expand) \[", found._jdf.queryExecution().analyzed().toString())
            assert nodes.index("Expand") < len(nodes) - 1 - nodes[::-1].index("Aggregate")  # the lowest aggregate is below any copying
            run(found, tmp_path, f"{name}{hop}")
            want = rows(batch(plain, params), *detect.DETECTION_COLUMNS)
            assert rows(spark.read.parquet(str(tmp_path / f"{name}{hop}")), *detect.DETECTION_COLUMNS) == want and want


def test_stream_ledger_equals_replay(spark, tmp_path):
    rng = random.Random(4)
    plain = sorted({(t, rng.choice(["hot", "hot", "a", "allowed"])) for t in rng.sample(range(3000), 120)})
    whitelist_path, found_path = str(tmp_path / "whitelist"), str(tmp_path / "found")
    tables.write_snapshot(spark.createDataFrame([("allowed", "static")], WHITELIST), whitelist_path)
    hits = [(at(t), c, "x.com", 9, "dns", "rate-limit", "monitor", False, "") for t, c in plain]
    sink = live_ledger.detections_sink(spark, found_path, whitelist_path, P)
    for i in range(4):
        part = spark.createDataFrame(hits[i * 30:(i + 1) * 30], DETECTIONS)
        for _ in range(2):  # a repeated batch changes nothing
            sink(part.unionByName(part), i)
    sink(spark.createDataFrame([(at(90_000), "end", "x.com", 9, "dns", "rate-limit", "monitor", False, "")], DETECTIONS), 4)

    written = spark.read.option("recursiveFileLookup", True).parquet(found_path)
    assert written.filter("client = 'allowed'").count() == 0
    source = spark.readStream.schema(written.schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(found_path).withWatermark("at", "10 seconds")
    bans_path, history_path = str(tmp_path / "bans"), str(tmp_path / "history")
    run(live_ledger.stream_ledger(source, P), tmp_path, "ledger", live_ledger.ledger_sink(spark, bans_path, history_path, P))

    shown = ["timestamp_epoch", "action", "client_ip", "domain", "count", "duration", "reason"]
    want = rows(ledger.ledger_replay(spark.createDataFrame([h for h in hits if h[1] != "allowed"], DETECTIONS), P), *shown)
    got = rows(tables.read_history(spark, history_path).filter("client_ip <> 'end'"), *shown)
    assert got == want and any(r[1] == "UNBAN" for r in got)
    left = rows(tables.read_bans(spark, bans_path), "client_ip", "is_permanent")
    permanent = {r[2] for r in want if r[5] == "permanent"}
    assert left == sorted([(c, True) for c in permanent] + [("end", False)])


def test_a_streamed_country_ban_is_lifted_when_the_country_is_allowed(spark, tmp_path):
    geo = P.with_(geoip_enabled=True, geoip_countries=("XX", "YY"))
    found_path, bans_path, history_path = (str(tmp_path / n) for n in ("found", "bans", "history"))
    hits = [(at(i), f"c{i}", f"GeoIP:{c}", 0, "-", "geoip", "geoip", True, c) for i, c in enumerate(["XX", "YY", "XX"])]
    spark.createDataFrame(hits, DETECTIONS).write.parquet(found_path)
    source = spark.readStream.schema(DETECTIONS).parquet(found_path).withWatermark("at", "10 seconds")
    sink = live_ledger.ledger_sink(spark, bans_path, history_path, geo)
    for checkpoint in ("one", "two"):  # a fresh checkpoint reads all again: history has both runs, no ban is lost
        run(live_ledger.stream_ledger(source, geo), tmp_path, checkpoint, sink)
    assert tables.read_history(spark, history_path).count() == 6
    table = tables.read_bans(spark, bans_path)
    assert rows(table, "client_ip", "geoip_country", "is_permanent") == [("c0", "XX", True), ("c1", "YY", True), ("c2", "XX", True)]
    step = ledger.lift_geo_bans(table, geo.with_(geoip_countries=("YY",)), 2_000_000_000)
    tables.record_step(step, spark, bans_path, "geo", 0, 2_000_000_000)
    assert rows(tables.read_bans(spark, bans_path), "client_ip") == [("c1",)]


def test_a_dry_stream_bans_nobody(spark, tmp_path):
    dry = P.with_(dry_run=True)
    found_path, bans_path, history_path = (str(tmp_path / n) for n in ("found", "bans", "history"))
    hits = [(at(i), "c", "x.com", 9, "dns", "rate-limit", "monitor", False, "") for i in range(3)]
    spark.createDataFrame(hits, DETECTIONS).write.parquet(found_path)
    source = spark.readStream.schema(DETECTIONS).parquet(found_path).withWatermark("at", "10 seconds")
    run(live_ledger.stream_ledger(source, dry), tmp_path, "dry", live_ledger.ledger_sink(spark, bans_path, history_path, dry))
    assert rows(tables.read_history(spark, history_path), "action", "duration", "reason") == [("DRY", "dry-run", "dry-run (rate-limit)")] * 3
    assert tables.read_bans(spark, bans_path).count() == 0
