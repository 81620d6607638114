"""URL filters by a Bloom filter cascade.

Level 0 encodes the listed keys. Level 1 encodes the keys of the corpus that level 0 lets through
by mistake, level 2 the listed keys that level 1 lets through, and so on until nobody is left. Over
the complete key universe of the corpus the level that first rejects a key tells for certain
whether it is listed, so that pages are judged by bit tests alone.

Rules are (host, path) pairs with a verdict. The keys of a url are its host suffixes, for the label
counts that occur in the rules, times its path prefixes, for the path lengths that occur there. Their
number depends on the rules, never on the length of the url. The longest listed key wins; of equally
long ones the one with the longer host.

Null urls and urls without ``://`` have an empty host and path, no rule, and the default verdict.
Repeated pages are judged each. Extra columns are ignored. An empty table gives no rows; without
rules every page gets the default.
"""

from __future__ import annotations

import math
import string
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, functions as F

from tidewarden.llm.common import own_columns, staged

Rule = tuple[str, str, str]
#: largest level that is sent along with the plan, in bits (1 MB); larger lists are matched by join
MAX_BITS = 8 * 2 ** 20


def host_and_path(url: Column) -> tuple[Column, Column]:
    rest = F.when(F.instr(url, "://") > 0, F.regexp_replace(url, r"^(?s).*?://", ""))
    host = F.coalesce(F.regexp_extract(rest, r"^[^/?#]*", 0), F.lit(""))
    path = F.coalesce(F.regexp_extract(rest, r"^[^/?#]*(/[^?#]*)", 1), F.lit(""))
    return F.translate(host, string.ascii_uppercase, string.ascii_lowercase), path


def keys_of(host: Column, path: Column, label_counts: Iterable[int], path_lengths: Iterable[int]) -> Column:
    """Candidate keys ``host suffix + path prefix``, each with its host part."""
    labels = F.split(host, r"\.")
    out = []
    for n in sorted(set(label_counts)):
        enough = F.size(labels) >= n
        suffix = F.when(enough, F.array_join(F.slice(labels, F.greatest(F.size(labels) - n + 1, F.lit(1)), n), "."))
        for m in sorted(set(path_lengths)):
            out.append(F.when(enough & (F.length(path) >= m), F.struct(
                F.concat(suffix, F.substring(path, 1, m)).alias("key"), F.length(suffix).alias("host_length"))))
    return F.array_compact(F.array(*out)) if out else F.expr("cast(array() as array<struct<key:string,host_length:int>>)")


class Level:
    """One Bloom filter: its bits as a one-row table, and the test of a key."""

    def __init__(self, keys: DataFrame, n_keys: int, number: int, bits_per_key: float = 6.0, hashes: int = 3):
        self.number, self.hashes = number, hashes
        self.words = max(1, math.ceil(n_keys * bits_per_key / 64))
        spark = keys.sparkSession
        bits = keys.select(F.explode(F.array(*self._positions(F.col("key")))).alias("bit"))
        marks = bits.select(F.shiftright("bit", 6).alias("word"), F.expr("shiftleft(1L, cast(bit & 63 as int))").alias("mask"))
        blank = spark.range(self.words).select(F.col("id").alias("word"), F.lit(0).cast("long").alias("mask"))
        words = marks.unionByName(blank).groupBy("word").agg(F.bit_or("mask").alias("mask"))
        in_order = F.sort_array(F.collect_list(F.struct("word", "mask")))
        self.bits = staged(words.agg(F.transform(in_order, lambda w: w["mask"]).alias("bits")))

    def _positions(self, key: Column) -> list[Column]:
        return [F.pmod(F.xxhash64(key, F.lit(self.number), F.lit(j)), F.lit(64 * self.words)) for j in range(self.hashes)]

    def passes(self, key: Column, bits: Column) -> Column:
        test = F.lit(True)
        for bit in self._positions(key):
            word = F.get(bits, F.shiftright(bit, 6).cast("int"))
            test = test & (F.shiftrightunsigned(word, 0).bitwiseAND(_single(bit)) != 0)
        return test


def _single(bit: Column) -> Column:
    return F.call_function("shiftleft", F.lit(1).cast("long"), bit.bitwiseAND(F.lit(63)).cast("int"))


class Cascade:
    """Exact membership of ``listed`` over ``universe`` (both with a column ``key``)."""

    def __init__(self, listed: DataFrame, universe: DataFrame, bits_per_key: float = 6.0):
        self.levels: list[Level] = []
        keys = staged(listed.select("key").where("key is not null").distinct())
        others = staged(universe.select("key").where("key is not null").distinct().join(keys, "key", "left_anti"))
        n_keys = keys.count()
        self.listed = keys
        # the first level lets through about as many other keys as are listed, however large the corpus
        hashes = max(3, math.ceil(math.log2(max(1, others.count()) / max(1, n_keys)))) if n_keys else 3
        bits = max(bits_per_key, 1.5 * hashes)
        self.by_join = n_keys * bits > MAX_BITS
        while n_keys and not self.by_join:
            level = Level(keys, n_keys, len(self.levels), bits, hashes)
            self.levels.append(level)
            wrong = staged(others.select("key", level.bits.scalar().alias("__bits"))
                           .where(level.passes(F.col("key"), F.col("__bits"))).select("key"))
            keys, others, n_keys = wrong, keys, wrong.count()
            bits, hashes = bits_per_key, 3
            self.by_join = n_keys * bits > MAX_BITS

    def with_bits(self, df: DataFrame) -> DataFrame:
        return df.select("*", *[level.bits.scalar().alias(f"__bits{level.number}") for level in self.levels])

    def contains(self, key: Column) -> Column:
        """For rows of ``with_bits``: the first level that rejects a key decides."""
        answer = F.lit(len(self.levels) % 2 == 1)
        for level in reversed(self.levels):
            answer = F.when(level.passes(key, F.col(f"__bits{level.number}")), answer).otherwise(F.lit(level.number % 2 == 1))
        return answer


def filter_urls(pages: DataFrame, rules: Iterable[Rule], default: str = "allow",
                page_id: str = "page_id", url: str = "url") -> DataFrame:
    """Per page: page_id, host, path, rule (null if none), verdict."""
    rules = [(h, p, v) for h, p, v in rules]
    host, path = host_and_path(F.col("url"))
    parsed = own_columns(pages, page_id=page_id, url=url).select("page_id", host.alias("host"), path.alias("path"))
    parsed = parsed.select("*", keys_of(F.col("host"), F.col("path"), [h.count(".") + 1 for h, _, _ in rules],
                                        [len(p) for _, p, _ in rules]).alias("keys"))
    spark = pages.sparkSession
    listed = spark.createDataFrame([(h + p, v) for h, p, v in rules], "key string, verdict string")
    universe = parsed.select(F.explode("keys.key").alias("key"))
    cascade = Cascade(listed, universe)
    if cascade.by_join:
        rows = staged(parsed.withColumn("__row", F.monotonically_increasing_id()))
        known = (rows.select("__row", F.explode("keys").alias("k")).join(cascade.listed, F.col("k.key") == F.col("key"), "left_semi")
                 .groupBy("__row").agg(F.collect_set("k").alias("keys")))
        hits = rows.drop("keys").join(known, "__row", "left")
    else:
        hits = cascade.with_bits(parsed).withColumn("keys", F.filter("keys", lambda k: cascade.contains(k["key"])))
    best = F.array_max(F.transform("keys", lambda k: F.struct(
        F.length(k["key"]).alias("length"), k["host_length"].alias("host_length"), k["key"].alias("key"))))
    judged = hits.select("page_id", "host", "path", best["key"].alias("rule"))
    verdict = F.lit(None).cast("string")
    for h, p, v in rules:
        verdict = F.when(F.col("rule") == h + p, v).otherwise(verdict)
    return judged.withColumn("verdict", F.coalesce(verdict, F.lit(default)))
