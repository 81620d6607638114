"""Classes of large buckets, and url filters with a list too large for a cascade, against brute force."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewarden.llm import neardup, urlfilter
from tidewarden.llm.classes import bucket_classes
from tidewarden.llm.queries import URL_RULES


@pytest.mark.parametrize("dealt_anew", [False, True])
def test_large_buckets_lose_no_link(spark, dealt_anew):
    draw = random.Random(3)
    at = {i: draw.random() * 60 for i in range(40)}
    label = {i: i for i in at}
    for _ in at:
        for i in at:
            for j in at:
                if abs(at[i] - at[j]) <= 1:
                    label[i] = label[j] = min(label[i], label[j])
    rows = spark.createDataFrame([(1, i) for i in at] + [(2, i) for i in at if i % 2], "key long, id long")
    place = spark.createDataFrame(list(at.items()), "id long, x double")

    def verify(pairs):
        left, right = place.toDF("a", "xa"), place.toDF("b", "xb")
        return pairs.join(left, "a").join(right, "b").where(F.abs(F.col("xa") - F.col("xb")) <= 1).select("a", "b")

    got = {i: i for i in at}
    def later(ids):
        near = ids.join(place, "id").withColumn("cell", F.floor("x"))
        return near.select(F.explode(F.array("cell", F.col("cell") + 1)).alias("key"), "id", F.struct("x").alias("place"))

    options = {"later": later, "likely": lambda a, b: F.abs(a["x"] - b["x"]) <= 1} if dealt_anew else {}
    got.update({r.node: r.label for r in bucket_classes(rows, verify, **options).collect()})
    assert got == label


def test_similar_sets_meet_in_rare_keys():
    rnd = np.random.default_rng(5)
    for _ in range(400):
        a = rnd.choice(5000, int(rnd.integers(1, 200)), replace=False)
        more = rnd.choice(np.arange(5000, 6000), int(rnd.integers(0, max(1, len(a) // 5) + 1)), replace=False)
        b = np.r_[rnd.permutation(a)[: len(a) - int(rnd.integers(0, max(1, len(a) // 5) + 1))], more]
        both = np.intersect1d(a, b)
        similarity = len(both) / len(np.union1d(a, b))
        order = {x: i for i, x in enumerate(rnd.permutation(6000))}
        found = []
        for s in (a, b):
            # elements that nobody else holds come first and are not passed
            rarest = np.array(sorted(both, key=order.get), dtype=np.int64)
            found.append(dict(zip(*[x.tolist() for x in neardup.rare_keys(len(s), rarest, 0.8)])))
        fits = [min(len(a) - found[0][k], len(b) - found[1][k]) >= 0.8 / 1.8 * (len(a) + len(b)) - 1e-6 for k in found[0].keys() & found[1].keys()]
        assert any(fits) or similarity < 0.8


def test_long_lists_are_joined(spark, monkeypatch):
    pages = spark.createDataFrame([(1, "https://a.example.org/es/1"), (2, "http://x.com/de/"), (3, None), (4, "http://b.net/")], "page_id long, url string")
    usual = {tuple(r) for r in urlfilter.filter_urls(pages, URL_RULES).collect()}
    monkeypatch.setattr(urlfilter, "MAX_BITS", 0)
    assert {tuple(r) for r in urlfilter.filter_urls(pages, URL_RULES).collect()} == usual
    assert {(r[0], r[3], r[4]) for r in usual} == {(1, "example.org/es/", "block"), (2, "com/de/", "block"), (3, None, "allow"), (4, None, "allow")}
