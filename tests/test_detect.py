import random

import pytest
from pyspark.sql import functions as F

from tests.helpers import T0, at, events, rows
from tidewarden.operators import detect
from tidewarden.operators.slices import SECOND, in_cells, slice_seconds, slice_start
from tidewarden.params import Params

P = Params(rate_limit_max_requests=3, rate_limit_window=60, check_interval=10,
           subdomain_flood_max_unique=2, subdomain_flood_window=60)


def seconds(moment):
    return (moment - T0).total_seconds()


def test_rate_limit_needs_more_than_the_maximum(spark):
    log = [(i, "a", "x.com") for i in range(3)] + [(i, "b", "x.com", p) for i, p in enumerate(["dns", "doh", "dot", "doq"])]
    got = detect.rate_limit_snapshot(events(spark, log), P, at(30))
    assert rows(got, "client", "target", "n", "protocol", "reason", "permanent") == [("b", "x.com", 4, "doq", "rate-limit", False)]


def test_snapshot_window_is_closed(spark):
    log = [(0, "a", "x.com"), (60, "a", "x.com"), (30, "a", "x.com"), (31, "a", "x.com"), (61, "a", "x.com")]
    assert rows(detect.rate_limit_snapshot(events(spark, log), P, at(60)), "n") == [(4,)]
    assert rows(detect.rate_limit_snapshot(events(spark, log[:4]), P, at(61)), "n") == []


def test_subdomain_snapshot_skips_the_base_itself(spark):
    names = ["x.com", "a.x.com", "b.x.com", "a.x.com"]
    got = detect.subdomain_flood_snapshot(events(spark, [(i, "c", n) for i, n in enumerate(names)]), P, at(30))
    assert rows(got) == []
    names += ["d.e.x.com", "a.b.y.co.uk", "c.y.co.uk", "d.y.co.uk", "localhost", "espn.go.com"]
    got = detect.subdomain_flood_snapshot(events(spark, [(i, "c", n) for i, n in enumerate(names)]), P, at(30))
    assert rows(got, "target", "n", "protocol") == [("*.x.com", 3, "dns"), ("*.y.co.uk", 3, "dns")]


def test_watchlist_makes_a_violation_permanent_and_nothing_else(spark):
    watched = P.with_(watchlist_enabled=True, watchlist=("x.com",))
    log = [(i, "a", "w.x.com") for i in range(4)] + [(1, "b", "w.x.com")]
    got = detect.detections_at(events(spark, log), watched, at(30))
    assert rows(got, "client", "reason", "permanent", "source") == [("a", "dns-flood-watchlist", True, "monitor")]


def test_first_detection_order(spark):
    log = [(i, "a", "p.x.com") for i in range(4)] + [(i, "a", "q.y.com") for i in range(5)] + [
        (i, "b", f"{i}.z.com") for i in range(9)] + [(i, "c", d) for d in ("n.com", "m.com") for i in range(4)]
    got = detect.first_detection_per_client(detect.detections_at(events(spark, log), P, at(30)))
    assert rows(got, "client", "target", "n") == [("a", "q.y.com", 5), ("b", "*.z.com", 9), ("c", "m.com", 4)]


def brute_rate(log, p):
    out = []
    for t, c, d, proto in log:
        n = sum(1 for u, e, f, _ in log if e == c and f == d and t - p.rate_limit_window <= u <= t)
        if n > p.rate_limit_max_requests:
            out.append((t, c, d, n, proto))
    return sorted(out)


def base_of(domain):
    return ".".join(domain.split(".")[-2:])


def brute_flood(log, p):
    out = []
    for t, c, d, _ in log:
        if d == base_of(d):
            continue
        names = {f for u, e, f, _ in log if e == c and base_of(f) == base_of(d) and f != base_of(f)
                 and t - p.subdomain_flood_window <= u <= t}
        if len(names) > p.subdomain_flood_max_unique:
            out.append((t, c, "*." + base_of(d), len(names)))
    return sorted(out)


def random_log(seed, size, span, fraction=False):
    """A third of all rows belongs to one client, and half of those to one name."""
    rng = random.Random(seed)
    log = []
    for _ in range(size):
        hot = rng.random() < 1 / 3
        client = "hot" if hot else f"c{rng.randrange(4)}"
        name = "big.x.com" if hot and rng.random() < 0.5 else rng.choice(["x.com", "a.x.com", "b.x.com", "c.x.com", "d.y.org", "e.y.org", "f.y.org"])
        t = rng.randrange(span) if not fraction else rng.randrange(span * 4) / 4
        log.append((t, client, name, rng.choice(["dns", "doh"])))
    return log


@pytest.mark.parametrize("window,longest", [(60, 3600), (60, 7), (60, 20), (17, 3600), (90, 30)])
def test_trailing_detectors_match_brute_force(spark, window, longest):
    p = P.with_(rate_limit_window=window, subdomain_flood_window=window, max_slice_seconds=longest)
    log = random_log(window * 1000 + longest, 250, 400)
    df = events(spark, log)
    got = [(seconds(r[0]), *r[1:]) for r in rows(detect.rate_limit_trailing(df, p), "at", "client", "target", "n", "protocol")]
    assert sorted(got) == brute_rate(log, p)
    got = [(seconds(r[0]), *r[1:]) for r in rows(detect.subdomain_flood_trailing(df, p), "at", "client", "target", "n")]
    assert sorted(got) == brute_flood(log, p)


@pytest.mark.parametrize("window,longest,most", [(60, 3600, 0), (60, 7, 3), (17, 3600, 40), (90, 30, 10)])
def test_dense_slices_match_brute_force(spark, window, longest, most):
    p = P.with_(rate_limit_window=window, subdomain_flood_window=window, max_slice_seconds=longest, max_slice_rows=most)
    log = random_log(window + most, 250, 400)
    df = events(spark, log)
    got = [(seconds(r[0]), *r[1:]) for r in rows(detect.rate_limit_trailing(df, p), "at", "client", "target", "n", "protocol")]
    assert sorted(got) == brute_rate(log, p)
    got = [(seconds(r[0]), *r[1:]) for r in rows(detect.subdomain_flood_trailing(df, p), "at", "client", "target", "n")]
    assert sorted(got) == brute_flood(log, p)


def test_a_hot_key_is_ordered_in_cells(spark):
    """90 % of the rows are one key in one slice; no group that is ordered holds more than 1 % of them."""
    p = P.with_(max_slice_rows=100)
    times = F.when(F.col("id") % 10 < 9, F.col("id") * 2_000).otherwise(F.col("id") * 7_000_000)
    log = spark.range(20_000).select(
        F.timestamp_micros(F.lit(int(T0.timestamp()) * SECOND) + times).alias("at"), F.lit(0).alias("at_ns"), F.lit("a").alias("client"),
        F.when(F.col("id") % 10 < 9, F.lit("x.y.com")).otherwise(F.concat("id", F.lit(".z.com"))).alias("domain"), F.lit("dns").alias("protocol"))
    own = slice_start(F.unix_micros("at"), 60 * SECOND)
    marked = log.select("client", "domain", own.alias("slice"), (F.unix_micros("at") * 2).alias("ord"), F.lit(True).alias("dense"))
    sizes = in_cells(marked, 60 * SECOND).groupBy("client", "domain", "slice", "cell").count()
    assert marked.groupBy("client", "domain", "slice").count().agg(F.max("count")).first()[0] == 18_000
    assert sizes.agg(F.max("count")).first()[0] <= 180
    for job in (detect.rate_limit_trailing, detect.subdomain_flood_trailing):
        plan = job(log, p)._jdf.queryExecution().optimizedPlan().toString()
        assert all("cell" in line.split("], [")[1] for line in plan.splitlines() if "Window [sum(delta" in line)
    # every query but the first three is over the limit
    got = detect.rate_limit_trailing(log, p).agg(F.count("*"), F.max("n"), F.min("n")).first()
    assert tuple(got) == (18_000 - 3, 18_000, 4)


def test_trailing_window_edges_to_the_microsecond(spark):
    p = P.with_(rate_limit_max_requests=1, subdomain_flood_max_unique=1)
    log = events(spark, [(at(0), "a", "p.x.com"), (at(60), "a", "p.x.com"), (at(120, 1), "a", "p.x.com"),
                         (at(0), "b", "p.x.com"), (at(60), "b", "q.x.com"), (at(120, 1), "b", "r.x.com")])
    assert rows(detect.rate_limit_trailing(log, p), "at", "client", "n") == [(at(60), "a", 2)]
    assert rows(detect.subdomain_flood_trailing(log, p), "at", "client", "n") == [(at(60), "b", 2)]


@pytest.mark.parametrize("window,hop", [(60, 10), (50, 20), (30, 30), (10, 25)])
def test_ticks_match_brute_force(spark, window, hop):
    p = P.with_(rate_limit_window=window, subdomain_flood_window=window, check_interval=hop, rate_limit_max_requests=2)
    log = random_log(window + hop, 250, 300)
    want_rate, want_flood = [], []
    # windows start at multiples of the hop since the epoch
    shift = int((T0 - T0.replace(year=1970)).total_seconds()) % hop
    for start in range(-shift - 20 * hop, 300 + hop, hop):
        inside = [r for r in log if start <= r[0] < start + window]
        for key in {(c, d) for _, c, d, _ in inside}:
            n = sum(1 for r in inside if (r[1], r[2]) == key)
            if n > p.rate_limit_max_requests:
                want_rate.append((start + window, *key, n))
        for key in {(c, base_of(d)) for _, c, d, _ in inside if d != base_of(d)}:
            n = len({r[2] for r in inside if (r[1], base_of(r[2])) == key and r[2] != base_of(r[2])})
            if n > p.subdomain_flood_max_unique:
                want_flood.append((start + window, key[0], "*." + key[1], n))
    df = events(spark, log)
    got = [(seconds(r[0]), *r[1:]) for r in rows(detect.rate_limit_ticks(df, p), "at", "client", "target", "n")]
    assert sorted(got) == sorted(want_rate)
    got = [(seconds(r[0]), *r[1:]) for r in rows(detect.subdomain_flood_ticks(df, p), "at", "client", "target", "n")]
    assert sorted(got) == sorted(want_flood)


def test_tick_protocol_is_the_latest(spark):
    log = [(0, "a", "x.com", "zzz"), (1, "a", "x.com", "dns"), (2, "a", "x.com", "dns"), (3, "a", "x.com", "doh")]
    got = detect.rate_limit_ticks(events(spark, log), P.with_(check_interval=60))
    assert rows(got, "n", "protocol") == [(4, "doh")]


def test_layout_of_the_input_does_not_matter(spark):
    log = random_log(5, 300, 300)
    shuffled = list(log)
    random.Random(9).shuffle(shuffled)
    for job in (detect.rate_limit_trailing, detect.subdomain_flood_trailing, detect.rate_limit_ticks, detect.subdomain_flood_ticks):
        assert rows(job(events(spark, log), P)) == rows(job(events(spark, shuffled).repartition(13), P))


def test_no_task_orders_a_whole_key(spark):
    """Windows over rows are split by slice; windows over keys only see slice totals."""
    for job in (detect.rate_limit_trailing, detect.subdomain_flood_trailing):
        plan = job(events(spark, [(0, "a", "b.x.com")]), P)._jdf.queryExecution().optimizedPlan().toString()
        row_windows = [line for line in plan.splitlines() if "Window [sum(delta" in line]
        assert len(row_windows) == 1 and "slice" in row_windows[0].split("], [")[1]
        assert "Cartesian" not in plan


def test_slice_widths():
    assert [slice_seconds(60, 3600), slice_seconds(7 * 86400, 3600), slice_seconds(60, 7), slice_seconds(61, 60)] == [60, 3600, 6, 1]
