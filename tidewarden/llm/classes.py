"""Classes of linked rows: buckets to verified links, links to connected components.

Buckets are never expanded into all pairs unless they are small. In a large bucket every member is compared
with one hub, the member that meets most others in its buckets. The members of large buckets that then still
hold several classes may be dealt anew by more selective keys; only pairs that lie in different classes and
share such a key are compared one by one, each pair once, so that no link that could join two classes is lost.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F

from tidewarden.llm.common import staged

#: buckets up to this size are expanded: at most half as many pairs per member
SMALL = 8


def components(links: DataFrame) -> DataFrame:
    """(node, label) for every node of ``links`` (a, b): label is the smallest node of its component.

    Smallest neighbour labels, then labels of labels, until nothing changes; each round is written.
    """
    both = staged(links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    labels = staged(both.groupBy("a").agg(F.min("b").alias("b")).select(F.col("a").alias("node"), F.least("a", "b").alias("label")))
    while True:
        near = both.join(labels.select(F.col("node").alias("b"), "label"), "b").groupBy("a").agg(F.min("label").alias("near"))
        lower = labels.join(near, F.col("node") == F.col("a")).select("node", "label", F.least("label", "near").alias("low"))
        lower = staged(lower)
        jump = lower.select(F.col("node").alias("low"), F.col("low").alias("root"))
        after = staged(lower.join(jump, "low").select("node", F.col("label").alias("old"), F.least("low", "root").alias("label")))
        labels = after.select("node", "label")
        if after.where("label <> old").isEmpty():
            return labels


def _pairs(left: DataFrame, right: DataFrame, on: str) -> DataFrame:
    """Distinct unordered pairs of ids that share ``on``."""
    joined = left.join(right.withColumnRenamed("id", "other"), on).where("id <> other")
    return joined.select(F.least("id", "other").alias("a"), F.greatest("id", "other").alias("b")).distinct()


def bucket_classes(rows: DataFrame, verify: Callable[[DataFrame], DataFrame], small: int = SMALL,
                   later: Callable[[DataFrame], DataFrame] | None = None,
                   likely: Callable[[Column, Column], Column] | None = None) -> DataFrame:
    """(node, label) from (key, id) rows; ``verify`` keeps those of (a, b) pairs that are links.

    ``later`` gives (key, id, place) rows for the ids of large buckets that hold several classes after the hubs;
    every link between such ids must share a key for which ``likely`` is true of their places. Ids without a
    link are left out.
    """
    sizes = rows.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    rows = staged(rows.join(sizes, "key").select("key", "id", "n"))
    few = rows.where(F.col("n") <= small).select("key", "id")
    many = rows.where(F.col("n") > small)
    meets = many.groupBy("id").agg(F.sum("n").alias("meets"), F.sort_array(F.collect_set("key")).alias("place"))
    many = staged(many.join(meets, "id").select("key", "id", "meets", "place"))
    central = many.groupBy("key").agg(F.max(F.struct("meets", "id")).alias("hub")).select("key", F.col("hub.id").alias("hub"))
    hubs = (many.join(central, "key").where("id <> hub")
            .select(F.least("id", "hub").alias("a"), F.greatest("id", "hub").alias("b")).distinct())
    tried = staged(_pairs(few, few, "key").unionByName(hubs).distinct())
    links = staged(verify(tried))
    labels = components(links)
    if many.isEmpty():
        return labels
    # large buckets that still hold several classes
    marked = many.join(labels, F.col("id") == F.col("node"), "left").select("key", "id", "place", F.coalesce("label", "id").alias("label"))
    marked = _mixed(staged(marked))
    if later:
        named = staged(marked.select("id", "label").distinct())
        marked = _mixed(staged(later(named.select("id")).join(named, "id").select("key", "id", "place", "label")))
    other = marked.select("key", F.col("id").alias("other"), F.col("label").alias("label2"), F.col("place").alias("place2"))
    if likely:
        fits = likely(F.col("place"), F.col("place2"))
    else:  # a pair that meets in several buckets is made in the first of them
        fits = F.col("key") == F.array_min(F.array_intersect("place", "place2"))
    pairs = marked.join(other, "key").where("id < other and label <> label2").where(fits).select(F.col("id").alias("a"), F.col("other").alias("b"))
    more = staged(verify(staged(pairs.distinct().join(tried, ["a", "b"], "left_anti"))))
    return components(links.unionByName(more))


def _mixed(marked: DataFrame) -> DataFrame:
    """Rows of the buckets that hold more than one class."""
    mixed = marked.groupBy("key").agg(F.min("label").alias("low"), F.max("label").alias("high")).where("low <> high").select("key")
    return staged(marked.join(mixed, "key", "left_semi"))
