"""Cutting time lines into slices.

A window over one key would put everything a busy client ever did into one task. The
detectors order rows only within a slice of one key and bring the state at the slice
start along as a number, so the largest task holds one key for one slice, and of slices
with many rows one key for one cell.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

SECOND = 1_000_000
#: parts of a slice that holds too many rows of one key for one task
CELLS = 4096


def slice_seconds(window: int, longest: int) -> int:
    """The largest divisor of ``window`` that is no longer than ``longest``."""
    parts = -(-window // min(longest, window))
    while window % parts:
        parts += 1
    return window // parts


def slice_start(at_us: Column, width_us: int) -> Column:
    return at_us - F.pmod(at_us, F.lit(width_us))


def in_cells(rows: DataFrame, width_us: int) -> DataFrame:
    """Adds ``cell``: the place of a row within a ``dense`` slice, -1 in all others."""
    size = max(2, -(-2 * width_us // CELLS))
    return rows.withColumn("cell", F.when(F.col("dense"), F.expr(f"(ord - 2 * slice) div {size}L")).otherwise(F.lit(-1)))


def running_count(rows: DataFrame, keys: list[str], width_us: int) -> DataFrame:
    """Adds ``n``: ``before`` plus the sum of ``delta`` up to a row, within key and slice.

    Rows need ``keys, slice, before, dense, ord, delta``; ``ord`` is twice the time, plus one for what
    leaves. Rows with equal ``ord`` see each other. The growing frame costs one addition per row, where a
    sliding frame would walk the whole window again for every row.

    A slice marked ``dense`` is cut into ``CELLS`` cells. Their sums, which combine before the shuffle, give
    the state at the start of every cell, so that a busy key is not ordered by one task even within a slice.
    """
    place = [*keys, "slice", "cell"]
    placed = in_cells(rows, width_us)
    earlier = Window.partitionBy(*keys, "slice").orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)
    ahead = placed.filter("dense").groupBy(*place).agg(F.sum("delta").alias("net")).select(
        *place, F.coalesce(F.sum("net").over(earlier), F.lit(0)).alias("ahead"))
    upto = Window.partitionBy(*place).orderBy("ord")
    return placed.join(ahead, place, "left").withColumn(
        "n", F.col("before") + F.coalesce("ahead", F.lit(0)) + F.sum("delta").over(upto)).drop("cell", "ahead", "dense")
