"""Mixing sources to target weights by Sainte-Laguë apportionment.

Equal-token blocks go to sources by the highest quotients ``weight / (2 k + 1)``; each source's
blocks go to its shards the same way, by shard size. Within a shard documents lie on a line in a
seeded order; the quota takes whole passes over the line and, for the rest, a run of blocks that
starts at a seeded block and wraps around.

Size is the number of runs of ``[^\\x20\\x09-\\x0D]``; null and empty texts have size 0 and are
taken 0 times. Null sources form one source of their own, ranked last. Repeated rows are documents
of their own. Extra columns are ignored. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from tidewarden.llm.common import own_columns, ranked, staged

WORD = r"[^\x20\x09-\x0D]+"


def token_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def capped_targets(sources: DataFrame, cap: float = 3.0) -> DataFrame:
    """Adds ``target``: the total size shared by ``weight``, at most ``cap`` times the own ``source_size``.

    The level per weight only rises while sources drop out at their cap, so a few aggregations
    of the source table find it; the driver sees two sums per step.
    """
    sources = sources.withColumn("__cap", cap * F.col("source_size"))
    total = sources.agg(F.sum("source_size")).first()[0] or 0
    level = 0.0
    while True:
        full = F.col("__cap") <= level * F.col("weight")
        row = sources.agg(F.sum(F.when(full, F.col("__cap"))), F.sum(F.when(~full, F.col("weight")))).first()
        if not row[1]:
            break
        higher = (total - (row[0] or 0.0)) / row[1]
        if higher <= level * (1 + 1e-12):
            break
        level = higher
    return sources.withColumn("target", F.least("__cap", level * F.col("weight"))).drop("__cap")


def highest_quotients(claims: DataFrame, seats: str, weight: str, group: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Adds ``quota``: the claimant's part of its group's ``seats`` (Sainte-Laguë, ties by ``order``).

    With W the group's weight, N its seats and K its claimants, every quotient from W / (2N - K) up
    surely wins and every one below W / (2N + K) surely loses, so that only about K quotients per
    group have to be ranked.
    """
    within = Window.partitionBy(*group)
    n, w = F.col(seats).cast("double"), F.col(weight).cast("double")
    claims = claims.where(w > 0).select(
        "*", F.sum(w).over(within).alias("__w"), F.count(F.lit(1)).over(within).cast("double").alias("__k"))
    safe = F.when(2 * n > F.col("__k"), F.floor((w * (2 * n - F.col("__k")) / F.col("__w") * (1 - 1e-9) + 1) / 2)).otherwise(F.lit(0))
    most = F.floor((w * (2 * n + F.col("__k")) / F.col("__w") * (1 + 1e-9) + 1) / 2) + 1
    claims = claims.select("*", safe.cast("long").alias("__safe"), most.cast("long").alias("__most"))
    claims = claims.withColumn("__left", F.col(seats) - F.sum("__safe").over(within))
    open_seats = claims.select(*group, *order, weight, "__left", F.explode(F.sequence("__safe", F.col("__most"))).alias("__seat"))
    best = Window.partitionBy(*group).orderBy((w / (2 * F.col("__seat") + 1)).desc(), *order)
    won = (open_seats.withColumn("__place", F.row_number().over(best)).where("__place <= __left")
           .groupBy(*group, *order).agg(F.count(F.lit(1)).alias("__won")))
    return (claims.join(won, [*group, *order], "left")
            .withColumn("quota", F.col("__safe") + F.coalesce("__won", F.lit(0)))
            .drop("__w", "__k", "__safe", "__most", "__left", "__won"))


def mix(docs: DataFrame, weights: Sequence[float] = (5, 2, 1), cap: int = 3, block: int = 8, shard_size: int = 500_000,
        seed: int = 7, doc_id: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """Per document: doc_id, source, size, source_size, target, taken (words, repeats counted).

    A source has one shard per ``shard_size`` words, so that a task's part does not grow with the source.
    """
    sized = staged(own_columns(docs, doc_id=doc_id, text=text, source=source).select(
        "doc_id", "source", token_count(F.col("text")).alias("size"),
        F.coalesce(F.concat(F.lit("="), "source"), F.lit("-")).alias("skey")))
    sources = sized.groupBy("skey", "source").agg(F.sum("size").alias("source_size"))
    place = ranked(sources, "source", "place")
    last = place.agg(F.count(F.lit(1)).alias("n"))
    cycle = F.array(*[F.lit(float(w)) for w in weights])
    sources = (sources.join(place, "source", "left")
               .withColumn("place", F.coalesce("place", last.scalar()))
               .select("skey", "source_size", F.get(cycle, (F.col("place") % len(weights)).cast("int")).alias("weight")))
    targets = staged(capped_targets(staged(sources), cap))
    shards = F.ceil((F.col("source_size") + 1) / shard_size)
    dealt = sized.join(targets.select("skey", "source_size", "target"), "skey").withColumn(
        "shard", F.pmod(F.xxhash64("doc_id", F.lit(seed)), shards))
    lines = staged(dealt.groupBy("skey", "shard").agg(F.sum("size").alias("line")))
    blocks = targets.agg(F.round(F.sum("target") / block).cast("long")).scalar()
    quotas = highest_quotients(targets.withColumn("seats", F.coalesce(blocks, F.lit(0))).withColumn("all", F.lit(0)),
                               "seats", "target", ["all"], ["skey"])
    shares = staged(highest_quotients(lines.join(quotas.select("skey", F.col("quota").alias("seats")), "skey"),
                                      "seats", "line", ["skey"], ["shard"]).select("skey", "shard", "line", "quota"))
    along = Window.partitionBy("skey", "shard").orderBy(F.xxhash64("doc_id", F.lit(seed + 1)), "doc_id", "size")
    laid = (dealt.withColumn("end", F.sum("size").over(along.rowsBetween(Window.unboundedPreceding, 0)))
            .join(shares, ["skey", "shard"], "left"))
    line = F.greatest(F.coalesce("line", F.lit(0)), F.lit(1))
    wanted = F.least(F.coalesce(F.col("quota"), F.lit(0)) * block, cap * F.coalesce("line", F.lit(0)))
    laid = laid.select("*", F.floor(wanted / line).cast("long").alias("passes"), (wanted % line).alias("rest"),
                       (F.pmod(F.xxhash64("skey", "shard", F.lit(seed + 2)), F.ceil(line / block)) * block).alias("first"))
    start = F.col("end") - F.col("size")

    def overlap(low: Column, high: Column) -> Column:
        return F.greatest(F.least("end", high) - F.greatest(start, low), F.lit(0))

    stop = F.col("first") + F.col("rest")
    run = overlap(F.col("first"), F.least(stop, line)) + overlap(F.lit(0), stop - line)
    return laid.select("doc_id", "source", "size", "source_size", "target",
                       (F.col("passes") * F.col("size") + run).cast("long").alias("taken"))
