"""Helpers of the training-data operators: reading, staging, words, shingles, global order."""

from __future__ import annotations

import tempfile
import uuid
from functools import cache

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

#: between words: everything but letters, marks and digits
GAP = r"[^\p{L}\p{M}\p{N}]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: most blocks of a Bloom filter that is broadcast, five numbers each: below 100 MB
FILTER_BLOCKS = 1_000_000
#: keys that a block of four words is meant for: at 16 one foreign row in 400 passes, at 64 one in 6
BLOCK_KEYS = 16


@cache
def _own_dir() -> str:
    return tempfile.mkdtemp(prefix="llm-stage-")


def shared_dir(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``; a temporary one only in a local session that has none, as in tests."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    return _own_dir()


def staged(df: DataFrame) -> DataFrame:
    """Write the rows to the shared folder and read them back: cuts the plan, survives lost executors."""
    path = f"{shared_dir(df.sparkSession)}/llm-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _block(key: Column, blocks: int) -> Column:
    return F.pmod(key, F.lit(blocks))


def _bits(key: Column) -> list[Column]:
    """One bit for each word of a block."""
    spread = F.xxhash64(key, F.lit(1))
    return [F.call_function("shiftleft", F.lit(1).cast("long"), F.shiftright(spread, 6 * i).bitwiseAND(F.lit(63)).cast("int")) for i in range(4)]


def _sifted(docs: DataFrame, wanted: DataFrame, doc_id: str, text: str) -> DataFrame:
    """The rows with ``__hash`` (of the text) and ``__maybe``: false only if ``wanted`` has no row for them.

    A blocked Bloom filter is joined to the scan by block: no text is exchanged, whatever the number of wanted rows.
    """
    blocks = min(FILTER_BLOCKS, wanted.count() // BLOCK_KEYS + 1)
    key = F.xxhash64("__id", "__text")
    table = wanted.select(key.alias("__key")).groupBy(_block(F.col("__key"), blocks).alias("__block")).agg(
        *[F.bit_or(b).alias(f"__w{i}") for i, b in enumerate(_bits(F.col("__key")))])
    hashed = docs.withColumn("__hash", F.xxhash64(F.col(f"`{text}`"))).withColumn("__key", F.xxhash64(F.col(f"`{doc_id}`"), "__hash"))
    rows = hashed.join(F.broadcast(table), _block(F.col("__key"), blocks) == F.col("__block"), "left")
    held = [F.col(f"__w{i}").bitwiseAND(b) != 0 for i, b in enumerate(_bits(F.col("__key")))]
    maybe = F.col(f"`{text}`").isNotNull() & F.coalesce(held[0] & held[1] & held[2] & held[3], F.lit(False))
    return rows.select(*[F.col(f"`{c}`") for c in docs.columns], "__hash", maybe.alias("__maybe"))


def _same(doc_id: str) -> Column:
    return F.col(f"`{doc_id}`").eqNullSafe(F.col("__id")) & (F.col("__hash") == F.col("__text"))


def find(docs: DataFrame, wanted: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows that ``wanted`` names by ``__id`` and ``__text``, the hash of the text, with its columns.

    ``wanted`` is a written table with one row for each id and hash; ids may be null, texts may not. Only rows
    that pass a Bloom filter meet it, so that of all texts the wanted ones are exchanged, or none where ``wanted`` is small.
    """
    return _sifted(docs, wanted, doc_id, text).where("__maybe").join(wanted, _same(doc_id)).drop("__hash", "__maybe")


def mark(docs: DataFrame, wanted: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """All rows with the columns of ``wanted``, null where it names no such row; otherwise as in ``find``."""
    rows = _sifted(docs, wanted, doc_id, text)
    met = rows.where("__maybe").join(wanted, _same(doc_id), "left").drop("__hash", "__maybe")
    others = rows.where("not __maybe")
    none = [F.lit(None).cast(f.dataType).alias(f.name) for f in wanted.schema]
    return met.unionByName(others.select(*[F.col(f"`{c}`") for c in docs.columns], *none))


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` computed once."""
    return F.transform(F.array(value), body)[0]


def words(text: Column) -> Column:
    """Lower-case runs of letters, marks and digits; null and empty texts have none."""
    return F.array_remove(F.split(F.lower(F.coalesce(text, F.lit(""))), GAP), "")


def word_hashes(text: Column) -> Column:
    return F.transform(words(text), lambda w: F.xxhash64(w))


def grams(values: Column, n: int, combine) -> Column:
    """``combine`` of every ``n`` neighbours of an array; an empty array when there are fewer."""
    return let(values, lambda v: F.when(
        F.size(v) >= n,
        F.transform(F.sequence(F.lit(0), F.size(v) - n), lambda i: combine(*[F.get(v, i + j) for j in range(n)])),
    ).otherwise(F.array().cast("array<bigint>")))


def shingles(text: Column, n: int = 5) -> Column:
    """64-bit hashes of all runs of ``n`` words, with repeats."""
    return grams(word_hashes(text), n, lambda *w: F.xxhash64(*w))


def fold(doc_id: Column, folds: int) -> Column:
    """Remainder of crc32 of the id as text."""
    return F.crc32(doc_id.cast("string").cast("binary")) % folds


def ranked(df: DataFrame, key: str, rank: str = "rank") -> DataFrame:
    """Distinct non-null keys with their dense global rank from 0, without a single-task sort.

    Keys are dealt by range, ranked within a range, and shifted by the sizes of the ranges before
    (one row per partition, hence a bounded broadcast).
    """
    keys = df.select(key).where(F.col(key).isNotNull()).distinct()
    # written, so that sampled range bounds are the same for ranks and sizes
    parts = staged(keys.repartitionByRange(key).select(key, F.spark_partition_id().alias("__part")))
    before = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    shift = parts.groupBy("__part").count().select("__part", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("__before"))
    order = Window.partitionBy("__part").orderBy(key)
    return (parts.select(key, "__part", (F.row_number().over(order) - 1).alias("__at"))
            .join(F.broadcast(shift), "__part")
            .select(key, (F.col("__before") + F.col("__at")).alias(rank)))


def own_columns(df: DataFrame, **columns: str) -> DataFrame:
    """Only the named input columns, under names of our own, so that extra columns cannot clash."""
    # no alias where the name stays: plans that start from the same columns can share an exchange
    return df.select(*[F.col(f"`{old}`") if old == new else F.col(f"`{old}`").alias(new) for new, old in columns.items()])
