import ipaddress
import random

from pyspark.sql import functions as F

from tests.helpers import at, events, rows
from tidewarden.operators import geo
from tidewarden.operators.networks import matching_networks
from tidewarden.params import Params
from tidewarden.schemas import ACTIVE_BANS, GEO_CACHE, GEO_RANGES, WHITELIST
from tidewarden.sources import querylog

NOW = 1_700_000_000


def ranges(spark, *made):
    return spark.createDataFrame(list(made), GEO_RANGES)


def clients(spark, *ips):
    return spark.createDataFrame([(ip,) for ip in ips], "client string")


def test_longest_prefix_and_registered_country(spark):
    table = ranges(spark, ("203.0.0.0/8", "de", "XX"), ("203.1.0.0/16", "", "fr"), ("203.1.2.0/24", "US", "US"), ("203.1.2.9/32", "", None),
                   ("2001:db8::/32", "JP", "JP"), ("2001:db8:1::/48", "KR", "KR"), ("bad", "ZZ", "ZZ"))
    asked = clients(spark, "203.9.9.9", "203.1.9.9", "203.1.2.3", "203.1.2.9", "8.8.8.8", "2001:db8::1", "2001:db8:1::1", "::ffff:203.1.2.3",
                    "203.1.2.0/24", "fe80::1%eth0", "junk", "203.9.9.9")
    assert rows(geo.geo_lookup(asked, table)) == sorted([
        ("203.9.9.9", "DE"), ("203.1.9.9", "FR"), ("203.1.2.3", "US"), ("203.1.2.9", ""), ("8.8.8.8", ""), ("2001:db8::1", "JP"),
        ("2001:db8:1::1", "KR"), ("::ffff:203.1.2.3", "US"), ("203.1.2.0/24", ""), ("fe80::1%eth0", ""), ("junk", "")])


def test_matching_networks_agrees_with_the_standard_library(spark):
    rng = random.Random(3)
    nets = sorted({str(ipaddress.ip_network((rng.getrandbits(32) & (0xFFFFFFFF << (32 - n) if n else 0), n)))
                   for n in [rng.choice([0, 1, 4, 8, 12, 13, 20, 32]) for _ in range(60)]})
    addresses = sorted({str(ipaddress.ip_address(rng.getrandbits(32))) for _ in range(120)})
    got = rows(matching_networks(clients(spark, *addresses), spark.createDataFrame([(n,) for n in nets], "network string")), "client", "network")
    want = sorted((a, n) for a in addresses for n in nets if ipaddress.ip_address(a) in ipaddress.ip_network(n))
    assert got == want


def test_clients_of_one_wide_network_are_spread(spark):
    """50,000 clients below one IPv6 /32, as an operator's subscribers are, meet it in many tasks."""
    asked = spark.range(50_000).select(F.concat(F.lit("2001:db8:"), F.hex("id"), F.lit("::1")).alias("client"))
    nets = spark.createDataFrame([("2001:db8::/32",), ("2001:db8:7::/48",)], "network string")
    settings = {"spark.sql.adaptive.enabled": "false", "spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.shuffle.partitions": "8"}
    before = {k: spark.conf.get(k) for k in settings}
    try:
        for k, v in settings.items():
            spark.conf.set(k, v)
        found = matching_networks(asked, nets).groupBy("network", F.spark_partition_id().alias("task")).count().collect()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    wide = [r["count"] for r in found if r["network"] == "2001:db8::/32"]
    assert sum(wide) == 50_000 and len(wide) >= 6 and max(wide) < 20_000
    assert [r["count"] for r in found if r["network"] == "2001:db8:7::/48"] == [1]


def test_matching_uses_equality_only(spark):
    plan = geo.geo_lookup(clients(spark, "1.1.1.1"), ranges(spark, ("1.0.0.0/8", "DE", "DE")))._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_addresses_are_parsed_once_per_client(spark):
    """No address test below the aggregation that makes clients distinct."""
    p = Params(geoip_enabled=True, geoip_countries=("CN",))
    log = events(spark, [(0, "8.8.8.8", "x.com")])
    plan = geo.geo_public_clients(querylog.distinct_clients(log), p)._jdf.queryExecution().optimizedPlan().toString()
    assert "lambda" in plan.split("Aggregate")[0] and "lambda" not in plan.split("Aggregate")[1]


def test_policy(spark):
    block, allow = Params(geoip_countries=(" cn ", "RU")), Params(geoip_countries=("CN", "RU"), geoip_mode="allowlist")
    df = spark.createDataFrame([("cn",), ("DE",), ("",), (None,)], "c string")

    def verdicts(p):
        return [r[0] for r in df.select(geo.should_block(df.c, p)).collect()]

    assert verdicts(block) == [True, False, False, False]
    assert verdicts(allow) == [False, True, False, False]
    assert verdicts(Params(geoip_mode="allowlist")) == [False] * 4


def test_detection_and_private_clients(spark):
    p = Params(geoip_enabled=True, geoip_countries=("CN",))
    table = ranges(spark, ("0.0.0.0/0", "CN", "CN"))
    log = events(spark, [(i, c, "x.com") for i, c in enumerate(["8.8.8.8", "8.8.8.8", "10.0.0.1", "9.9.9.9", "7.7.7.7"])])
    listed = spark.createDataFrame([("9.9.9.9", "static")], WHITELIST)
    banned = spark.createDataFrame([("7.7.7.7", *[None] * 12)], ACTIVE_BANS)
    got = geo.geo_detect(log, table, listed, banned, p, at(9))
    assert rows(got, "client", "target", "n", "protocol", "reason", "source", "permanent") == [
        ("8.8.8.8", "GeoIP:CN", 0, "-", "geoip", "geoip", True)]
    everyone = geo.geo_detect(log, table, listed, banned, p.with_(geoip_skip_private=False), at(9))
    assert rows(everyone, "client") == [("10.0.0.1",), ("8.8.8.8",)]


def test_cache(spark):
    p = Params(geoip_cache_ttl=100)
    cache = spark.createDataFrame([
        ("1.1.1.1", "AA", NOW - 100, 7), ("2.2.2.2", "AA", NOW - 101, 7), ("3.3.3.3", "AA", NOW, 6), ("4.4.4.4", "AA", NOW, 0)], GEO_CACHE)
    assert rows(geo.geo_cache_valid(cache, p, NOW, 7), "ip") == [("1.1.1.1",), ("4.4.4.4",)]
    table = ranges(spark, ("2.0.0.0/7", "BB", "BB"), ("1.0.0.0/8", "BB", "BB"))
    asked = clients(spark, "1.1.1.1", "2.2.2.2", "3.3.3.3", "5.5.5.5")
    assert rows(geo.geo_cached_lookup(asked, cache, table, p, NOW, 7)) == [
        ("1.1.1.1", "AA", True), ("2.2.2.2", "BB", False), ("3.3.3.3", "BB", False), ("5.5.5.5", "", False)]
    assert rows(geo.geo_cache_refresh(asked, cache, table, p, NOW, 7)) == [
        ("1.1.1.1", "AA", NOW - 100, 7), ("2.2.2.2", "BB", NOW, 7), ("3.3.3.3", "BB", NOW, 7), ("4.4.4.4", "AA", NOW, 0)]
