"""The hypergeometric shuffle: exact sizes, exact law, and whole results."""

import itertools
import zlib
from collections import Counter
from math import comb

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewarden.llm import sharding
from tidewarden.llm.queries import op11_sharding

SF_DIR = "/root/testdata/sf0.001"


def test_matrix_has_the_right_sums():
    blocks, pieces = np.array([7, 7, 7, 3]), np.array([5, 1, 0, 6, 4, 8])
    for seed in range(50):
        rows = np.array([sharding.matrix_row(b, blocks, pieces, seed) for b in range(len(blocks))])
        assert (rows >= 0).all() and (rows.sum(1) == blocks).all() and (rows.sum(0) == pieces).all()


def test_matrix_law_is_hypergeometric():
    pieces, take, n = np.array([3, 4, 5]), 6, 20_000
    seen = Counter(tuple(sharding.matrix_row(0, np.array([take, 6]), pieces, seed).tolist()) for seed in range(n))
    for counts in itertools.product(*[range(p + 1) for p in pieces]):
        if sum(counts) == take:
            p = np.prod([comb(int(size), c) for size, c in zip(pieces, counts)]) / comb(int(pieces.sum()), take)
            assert abs(seen[counts] - n * p) < 5 * np.sqrt(n * p) + 5


def test_large_populations_follow_the_same_law(monkeypatch):
    rng = np.random.default_rng(3)
    draws = [sharding._large_draw(rng, 6, 9, 7) for _ in range(20_000)]
    for x, n in Counter(draws).items():
        p = comb(6, x) * comb(9, 7 - x) / comb(15, 7)
        assert abs(n - 20_000 * p) < 5 * np.sqrt(20_000 * p)
    wide = [sharding._large_draw(rng, 6 * 10**9, 4 * 10**9, 10**8) for _ in range(300)]
    assert abs(np.mean(wide) - 6e7) < 5 * np.sqrt(2.4e7 / 300) and 0.7 < np.std(wide) / np.sqrt(2.4e7 * 0.99) < 1.3
    blocks, pieces = np.array([5, 5, 5]), np.array([4, 4, 7])
    monkeypatch.setattr(sharding, "LIMIT", 1)
    rows = np.array([sharding.matrix_row(b, blocks, pieces, 1) for b in range(3)])
    assert (rows.sum(1) == blocks).all() and (rows.sum(0) == pieces).all()


def test_piece_places(spark):
    for total, shards, piece in ((0, 3, 4), (2, 5, 4), (101, 4, 7), (96, 4, 8), (1000, 24, 3)):
        size, shard, first = sharding.piece_sizes(total, shards, piece)
        assert size.sum() == total and size.max(initial=0) <= piece
        got = spark.range(len(size)).select(*[c.cast("long") for c in sharding._piece_place(F.col("id"), total, shards, piece)]).collect()
        assert [tuple(r) for r in got] == list(zip(shard.tolist(), first.tolist()))


def _orders(spark, n, seeds, **sizes):
    rows = spark.createDataFrame([(i,) for i in range(n)], "i int").repartition(2)
    for seed in seeds:
        yield tuple((r.shard, r.row.i) for r in sharding.shuffled(rows, 2, seed, **sizes).orderBy("shard", "slot").collect())


def test_no_order_is_preferred(spark):
    """Sixteen seeds over four rows in blocks of two and pieces of one: about 12 of 24 orders are expected."""
    seen = Counter()
    for order in _orders(spark, 4, range(16), block=2, piece=1):
        seen[tuple(i for _, i in order)] += 1
        assert [s for s, _ in order] == [0, 0, 1, 1]
    assert len(seen) >= 7 and max(seen.values()) <= 5


@pytest.mark.parametrize("sizes", [{}, {"block": 5, "piece": 3}])
def test_defined_cases(spark, docs_of, sizes):
    rows = [(i, "x" * i) for i in range(50)] + [(7, "same")] * 30 + [(None, None), (None, ""), (3, "é" * 2000)]
    docs = docs_of(rows).withColumnRenamed("key", "slot")
    got = sharding.shard_rows(docs, 4, 5, **sizes).collect()
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in got) == Counter(
        (i, len((t or "").encode()) + 8, zlib.crc32((t or "").encode())) for i, t in rows)
    counts = Counter(r.shard for r in got)
    assert sorted(counts) == [0, 1, 2, 3] and max(counts.values()) - min(counts.values()) <= 1
    for s, n in counts.items():
        assert sorted(r.slot for r in got if r.shard == s) == list(range(n))
    assert {r.law for r in got} == {"rows"} and {r.grown_shard for r in got} == {None}
    assert sharding.shard_rows(docs.limit(0), 4, 5, **sizes).count() == 0


def test_reruns_agree_and_files_hold_all(spark, docs_of, tmp_path):
    docs = docs_of([(i, f"text {i}") for i in range(300)]).repartition(3, "doc_id")
    once, twice = (sorted(tuple(r) for r in sharding.shard_rows(docs, 6, block=32, piece=16).collect()) for _ in range(2))
    assert once == twice
    sharding.write_shards(sharding.shuffled(docs, 6, block=32, piece=16), str(tmp_path / "out"))
    back = spark.read.parquet(str(tmp_path / "out"))
    assert back.count() == 300 and back.select("row.doc_id").distinct().count() == 300
    assert {r["count"] for r in back.groupBy("shard").count().collect()} == {50}


def test_query_returns_the_whole_table(spark):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    got = op11_sharding(spark, SF_DIR)
    assert got.columns == ["doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard"]
    assert got.exceptAll(got.distinct()).count() == 0 and got.select("doc_id").exceptAll(docs.select("doc_id")).count() == 0
    assert got.count() == docs.count()
