"""Longest-prefix matching of addresses against networks, as equi-joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from tidewarden.functions.addresses import parse_address

# A network with this few leading bits (by address width) can cover most clients, so its matches are spread.
_WIDE_PREFIX = {32: 12, 128: 32}
_SPREAD = 32


def _wide() -> Column:
    return F.col("prefix_len") <= F.when(F.col("width") == 32, _WIDE_PREFIX[32]).otherwise(_WIDE_PREFIX[128])


def _unmapped(bits: Column) -> Column:
    """Treat ``::ffff:a.b.c.d`` as the IPv4 address inside."""
    mapped = (F.length(bits) == 128) & bits.startswith("0" * 80 + "1" * 16)
    return F.when(mapped, F.substring(bits, 97, 32)).otherwise(bits)


def matching_networks(clients: DataFrame, networks: DataFrame) -> DataFrame:
    """``client`` with every network row that covers it, and its ``prefix_len``.

    A client is looked up once per prefix length that occurs for its family. Those
    (family, length) pairs number 162 at most, which is why they may be broadcast; the
    networks themselves are joined on their leading bits, without a range condition and
    without pairing rows inside a bucket.
    """
    parsed = networks.withColumn("_a", parse_address("network")).filter("_a IS NOT NULL").select(
        *networks.columns, F.col("_a.prefix_len").alias("prefix_len"),
        F.length("_a.bits").alias("width"),
        F.expr("substring(_a.bits, 1, _a.prefix_len)").alias("lead"))
    salts = F.when(_wide(), F.sequence(F.lit(0), F.lit(_SPREAD - 1))).otherwise(
        F.array(F.lit(0)))
    spread = parsed.withColumn("salt", F.explode(salts))

    address = clients.withColumn("_a", parse_address("client")).filter(
        "_a.kind = 'address' AND NOT contains(client, '%')").select("client", _unmapped(F.col("_a.bits")).alias("bits"))
    lengths = F.broadcast(parsed.select("width", "prefix_len").distinct())
    probes = address.withColumn("width", F.length("bits")).join(lengths, "width").select(
        "client", "width", "prefix_len",
        F.expr("substring(bits, 1, prefix_len)").alias("lead"),
        F.when(_wide(), F.pmod(F.xxhash64("client"), F.lit(_SPREAD))).otherwise(
            F.lit(0)).cast("int").alias("salt"))
    return probes.join(spread, ["width", "prefix_len", "lead", "salt"]).drop("width", "lead", "salt")
