"""Uniform shuffle into shards of exact size by a hypergeometric communication matrix.

Rows are numbered as they lie in a written table and cut into blocks; shards are cut into pieces whose sizes
are known beforehand. How many rows go from a block to a piece is drawn exactly: the matrix of these numbers
has the block sizes as row sums and the piece sizes as column sums and is as likely as under a uniform
shuffle (multivariate hypergeometric). No task holds the matrix: blocks are halved again and again, each
halving draws how many rows of every piece come from its left half, and a task walks down to its own block
with seeded draws, so that all tasks see the same matrix. A block permutes its rows and cuts them by its row
of the matrix, the rows are exchanged by piece, and each piece permutes what it has got.

The law is ``rows``: shard sizes differ by one row at most, the first shards are the larger ones. Equal texts
are rows like any others and are not kept together. Null and empty texts, repeated rows and ties are dealt out
like all rows; an empty table gives no rows. Input columns come back inside one struct, so none of their names
can clash. Reruns agree when the rows lie in the same order in the same number of input tasks; another
layout gives another shuffle, as uniform as the first. Lost executors change nothing: what a task does follows from
the written table and the seed.
"""

from __future__ import annotations

import sys

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from tidewarden.llm.common import own_columns, staged

cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: rows of a block: a task permutes this many numbers at a time
BLOCK = 131_072
#: rows of a piece: a task sorts this many rows at a time
PIECE = 65_536
#: numpy draws populations below this size only
LIMIT = 1_000_000_000
#: bits of a row number within one input task
ROW_BITS = 33


def cut_sizes(total: int, parts: int) -> np.ndarray:
    """``total`` in ``parts`` numbers at most one apart, the larger first."""
    return total // parts + (np.arange(parts) < total % parts).astype(np.int64)


def piece_sizes(total: int, shards: int, piece: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(size, shard, first slot) of every piece."""
    sizes, owner, first = [], [], []
    for shard, size in enumerate(cut_sizes(total, shards).tolist()):
        part = cut_sizes(size, max(1, -(-size // piece)))
        sizes.append(part)
        owner.append(np.full(len(part), shard))
        first.append(np.cumsum(part) - part)
    return np.concatenate(sizes), np.concatenate(owner), np.concatenate(first)


def _large_draw(rng: np.random.Generator, good: int, bad: int, sample: int) -> int:
    """Hypergeometric draw by inversion, along the probabilities within 12 deviations of the mode."""
    total = good + bad
    low, high = max(0, sample - bad), min(sample, good)
    mode = min(max((sample + 1) * (good + 1) // (total + 2), low), high)
    spread = int(12 * np.sqrt(sample * (good / total) * (bad / total) * ((total - sample) / max(1, total - 1)))) + 20
    at = np.arange(max(low, mode - spread), min(high, mode + spread) + 1)
    # logarithm of p(x + 1) / p(x)
    x = at[:-1].astype(float)
    steps = np.log((good - x) / (x + 1)) + np.log((sample - x) / (bad - sample + x + 1))
    logs = np.concatenate([[0.0], np.cumsum(steps)])
    weights = np.cumsum(np.exp(logs - logs.max()))
    return int(at[min(np.searchsorted(weights, rng.random() * weights[-1], side="right"), len(at) - 1)])


def hypergeometric(rng: np.random.Generator, good: np.ndarray, bad: np.ndarray, sample: np.ndarray) -> np.ndarray:
    """Draws for any population; the few of ``LIMIT`` and more one by one."""
    large = good + bad >= LIMIT
    out = rng.hypergeometric(np.where(large, 0, good), np.where(large, 0, bad), np.where(large, 0, sample))
    for i in np.flatnonzero(large):
        out[i] = _large_draw(rng, int(good[i]), int(bad[i]), int(sample[i]))
    return out


def drawn(rng: np.random.Generator, columns: np.ndarray, take: int) -> np.ndarray:
    """How many of ``take`` rows fall into each column: multivariate hypergeometric, by halving the columns."""
    sums = [columns]
    while len(sums[-1]) > 1:
        s = sums[-1] if len(sums[-1]) % 2 == 0 else np.append(sums[-1], 0)
        sums.append(s[::2] + s[1::2])
    takes = np.array([take], dtype=np.int64)
    for s in sums[-2::-1]:
        even = s if len(s) % 2 == 0 else np.append(s, 0)
        left = hypergeometric(rng, even[::2], even[1::2], takes)
        takes = np.stack([left, takes - left], 1).ravel()[:len(s)]
    return takes


def matrix_row(block: int, blocks: np.ndarray, pieces: np.ndarray, seed: int) -> np.ndarray:
    """Row ``block`` of the communication matrix for blocks and pieces of these sizes."""
    low, high, here = 0, len(blocks), pieces
    until = np.concatenate([[0], np.cumsum(blocks)])
    while high - low > 1:
        middle = (low + high) // 2
        left = drawn(np.random.default_rng([seed, low, high]), here, int(until[middle] - until[low]))
        low, high, here = (low, middle, left) if block < middle else (middle, high, here - left)
    return here


def shuffled(rows: DataFrame, shards: int = 24, seed: int = 11, block: int = BLOCK, piece: int = PIECE) -> DataFrame:
    """(shard, slot, row): every row once, in uniformly random order; ``row`` holds the columns of ``rows``.

    The rows are written once in the shared folder, exchanged once, and the driver sees one count per
    input task.
    """
    held = rows.select(F.struct(*[F.col(f"`{c}`") for c in rows.columns]).alias("row"))
    written = staged(held.withColumn("place", F.monotonically_increasing_id()))
    counts = written.groupBy(F.shiftright("place", ROW_BITS).alias("task")).agg(F.count(F.lit(1)).alias("n")).orderBy("task").collect()
    tasks = np.array([r.task for r in counts], dtype=np.int64)
    sizes = np.array([r.n for r in counts], dtype=np.int64)
    before, total = np.cumsum(sizes) - sizes, int(sizes.sum())
    blocks = np.append(np.full(total // block, block, dtype=np.int64), total % block)
    kind = T.StructType([T.StructField("piece", T.LongType()), T.StructField("number", T.LongType()), *written.select("row").schema.fields])

    def dealt(batches):
        pieces, _, _ = piece_sizes(total, shards, piece)
        known, order, ends = -1, None, None
        for batch in batches:
            place = batch.column("place").to_numpy()
            number = before[np.searchsorted(tasks, place >> ROW_BITS)] + (place & ((1 << ROW_BITS) - 1))
            to = np.empty(len(number), dtype=np.int64)
            for b in np.unique(number // block).tolist():
                if b != known:
                    known, order = b, np.random.default_rng([seed, b]).permutation(int(blocks[b]))
                    ends = np.cumsum(matrix_row(b, blocks, pieces, seed))
                here = number // block == b
                to[here] = np.searchsorted(ends, order[number[here] % block], side="right")
            yield pa.RecordBatch.from_arrays([pa.array(to), pa.array(number), batch.column("row")], ["piece", "number", "row"])

    sent = written.mapInArrow(dealt, kind)
    again = Window.partitionBy("piece").orderBy(F.xxhash64("number", F.lit(seed)), "number")
    placed = sent.withColumn("nth", (F.row_number().over(again) - 1).cast("long"))
    shard, first = _piece_place(F.col("piece"), total, shards, piece)
    return placed.select(shard.cast("int").alias("shard"), (first + F.col("nth")).cast("long").alias("slot"), "row")


def _piece_place(number: Column, total: int, shards: int, piece: int) -> tuple[Column, Column]:
    """Shard and first slot of a piece, from its number: shards come in at most two sizes."""
    small, larger = divmod(total, shards)
    many = max(1, -(-(small + 1) // piece))  # pieces of the larger shards, which come first
    few = max(1, -(-small // piece))
    late = number >= many * larger
    shard = F.when(late, larger + F.floor((number - many * larger) / few)).otherwise(F.floor(number / many))
    nth = F.when(late, (number - many * larger) % few).otherwise(number % many)

    def first(size: int, parts: int) -> Column:
        return nth * (size // parts) + F.least(nth, F.lit(size % parts))

    return shard, F.when(late, first(small, few)).otherwise(first(small + 1, many))


def write_shards(placed: DataFrame, path: str) -> None:
    """Files of the rows below ``shard=N`` folders, in slot order within each file."""
    flat = placed.select("shard", "slot", "row")
    flat.repartition("shard", F.floor(F.col("slot") / PIECE)).sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)


def shard_rows(docs: DataFrame, shards: int = 24, seed: int = 11, doc_id: str = "doc_id", text: str = "text", **sizes: int) -> DataFrame:
    """(doc_id, size, text_crc32, law, shard, slot, grown_shard) of documents dealt out by :func:`shuffled`.

    Size is the number of UTF-8 bytes of the text plus 8; a null text counts as empty.
    """
    body = F.coalesce(F.col("text"), F.lit(""))
    narrow = own_columns(docs, doc_id=doc_id, text=text).select(
        "doc_id", (F.octet_length(body) + 8).cast("long").alias("size"), F.crc32(body.cast("binary")).alias("text_crc32"))
    placed = shuffled(narrow, shards, seed, **sizes)
    return placed.select("row.doc_id", "row.size", "row.text_crc32", F.lit("rows").alias("law"), "shard", "slot",
                         F.lit(None).cast("int").alias("grown_shard"))
