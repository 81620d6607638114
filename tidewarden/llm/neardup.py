"""Near-duplicate documents by DartMinHash.

A document is a weighted set: its runs of five words, weighted by how often they occur. The weight axis
of an element is split into regions [0,1), [1,2), [2,4), ...; into every region a hashed Poisson process
throws darts, ordered by rank. A document sees the darts below its weights with a rank up to ``t / total
weight``, about ``t`` of them. Every dart falls on one of ``k`` coordinates, which keeps its earliest dart; a
coordinate that stays empty gets more darts. Two documents agree on a coordinate with the probability of
their weighted Jaccard similarity. Bands of coordinates are joined, and candidates are verified exactly.

Texts with the same words are one node before anything else is done. Classes are connected components of
links of at least ``threshold``. With 24 bands of 4 rows a pair at 0.8 is missed once in 300,000 times.
In a large bucket all are compared with one hub. Documents of large buckets that then still hold several
classes are dealt anew, exactly: runs of words are ordered by how many of these documents hold them, and a pair
that is similar enough must share one of the rarest few of both, as many as the two sizes leave room for.

Null texts and texts without words are alone in their class. Texts of one to four words have no runs and
are alike only when equal. Repeated rows fall into one class. ``class_id`` is the smallest doc_id of the
class (null only if all are). Nodes are 64-bit hashes of the words. Extra columns are ignored. An empty
table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from tidewarden.llm.classes import bucket_classes
from tidewarden.llm.common import find, grams, let, mark, own_columns, shingles, staged, words

BANDS, ROWS = 24, 4
#: ratio of neighbouring size classes among which rare runs are looked up
SIZE_STEP = 1.06


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit mixing step (multiply and shift, as in SplitMix)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _unit(x: np.ndarray) -> np.ndarray:
    return ((x >> np.uint64(11)).astype(float) + 0.5) / 2 ** 53


def regions(weights: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(element index, level, low end, width) of the regions that lie below each weight."""
    index, level = np.arange(len(weights)), 0
    out = [(index, np.zeros(len(index), dtype=np.uint64), np.zeros(len(index)), np.ones(len(index)))]
    while True:
        low = 2.0 ** level
        index = index[weights[index] > low]
        if not len(index):
            return tuple(np.concatenate(x) for x in zip(*out))
        out.append((index, np.full(len(index), level + 1, dtype=np.uint64), np.full(len(index), low), np.full(len(index), low)))
        level += 1


def signatures(doc: np.ndarray, element: np.ndarray, weight: np.ndarray, n_docs: int, k: int) -> np.ndarray:
    """(n_docs, k) earliest darts, from (doc, element, weight) entries; every doc needs an entry."""
    total = np.bincount(doc, weights=weight, minlength=n_docs)
    best_rank, best = np.full(n_docs * k, np.inf), np.zeros(n_docs * k, dtype=np.uint64)
    index, level, low, width = regions(weight)
    seed = mixed(element[index] ^ mixed(level + np.uint64(0x51ED27)))
    owner, high = doc[index], weight[index]
    limit = (k * np.log(k) + 2 * k) / total
    with np.errstate(over="ignore"):
        while True:
            alive, rank, j = np.arange(len(index)), np.zeros(len(index)), 0
            while len(alive):
                dart = mixed(seed[alive] + np.uint64((j * 0x9E3779B97F4A7C15 + 1) % 2 ** 64))
                rank = rank - np.log(_unit(dart)) / width[alive]
                near = rank <= limit[owner[alive]]
                alive, rank, dart = alive[near], rank[near], dart[near]
                hit = low[alive] + _unit(mixed(dart ^ np.uint64(0xD1B54A32D192ED03))) * width[alive] < high[alive]
                place = owner[alive[hit]] * k + (mixed(dart[hit] ^ np.uint64(0x8CB92BA72F3D8DD7)) % np.uint64(k)).astype(np.int64)
                # of darts on one coordinate the earliest, written last
                order = np.argsort(-rank[hit], kind="stable")
                place, r, d = place[order], rank[hit][order], dart[hit][order]
                first = r < best_rank[place]
                best_rank[place[first]] = r[first]
                best[place[first]] = d[first]
                j += 1
            empty = np.isinf(best_rank).reshape(n_docs, k).any(1)
            if not empty.any():
                return best.reshape(n_docs, k)
            # throw further for documents with an empty coordinate only
            keep = empty[owner]
            seed, owner, high, low, width, index = seed[keep], owner[keep], high[keep], low[keep], width[keep], index[keep]
            limit = np.where(empty, 2 * limit, limit)


def weighted(bags: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    parts = [np.unique(b, return_counts=True) for b in bags]
    doc = np.repeat(np.arange(len(bags)), [len(p[0]) for p in parts])
    return doc, np.concatenate([p[0] for p in parts]).view(np.uint64), np.concatenate([p[1] for p in parts]).astype(float)


def size_edges(most: int, step: float = SIZE_STEP) -> np.ndarray:
    """First size of every size class, until past ``most``."""
    edges = [1]
    while edges[-1] <= most:
        edges.append(max(edges[-1] + 1, int(edges[-1] * step)))
    return np.array(edges)


def rare_keys(size: int, shared: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """(keys, positions) of a set of ``size`` elements; ``shared`` are those that others hold too, rarest first.

    Two sets of n and m elements at ``threshold`` share ``threshold / (1 + threshold) * (n + m)``, so that in a
    common order they meet within all but that many (less one) of their first elements. Keys name both size classes.
    """
    low, high = max(1, int(np.ceil(threshold * size - 1e-6))), int(np.floor(size / threshold + 1e-6))
    edges = size_edges(high)
    own, first, last = (int(np.searchsorted(edges, x, "right")) - 1 for x in (size, low, high))
    alone, keys, places = size - len(shared), [], []
    for c in range(first, last + 1):
        needed = int(np.ceil(threshold / (1 + threshold) * (size + max(low, edges[c])) - 1e-6))
        n = min(size - needed + 1 - alone, len(shared))
        if n > 0:
            pair = np.uint64(min(own, c) * 100_003 + max(own, c))
            with np.errstate(over="ignore"):
                keys.append(mixed(shared[:n].view(np.uint64) + mixed(pair + np.zeros(1, dtype=np.uint64))).view(np.int64))
            places.append(np.arange(alone, alone + n))
    empty = np.zeros(0, dtype=np.int64)
    return (np.concatenate(keys), np.concatenate(places)) if keys else (empty, empty)


def _rare(threshold: float):
    def run(batches):
        for b in batches:
            parts, held = [], 0
            for node, size, shared in zip(b["node"], b["size"], b["shared"]):
                keys, places = rare_keys(size, np.asarray(shared, dtype=np.int64), threshold)
                parts.append(pd.DataFrame({"key": keys, "id": node, "at": places, "size": size}))
                held += len(keys)
                if held > 200_000:
                    yield pd.concat(parts)
                    parts, held = [], 0
            if parts:
                yield pd.concat(parts)
    return run


def node_of(text: Column) -> Column:
    """64-bit hash of the words, null if there are none."""
    return let(words(text), lambda w: F.when(F.size(w) > 0, F.xxhash64(w)))


def _bags(column: pa.ListArray) -> list[np.ndarray]:
    ends = np.cumsum(column.value_lengths().to_numpy(zero_copy_only=False))
    return np.split(column.flatten().to_numpy(zero_copy_only=False), ends[:-1]) if len(column) else []


def _sketched(k: int):
    """Signatures of ``k`` darts, cut to 32 bits; null for texts without shingles."""
    def run(batches):
        for b in batches:
            bags = _bags(b.column("h"))
            out: list = [None] * len(bags)
            todo = [i for i, x in enumerate(bags) if len(x)]
            while todo:  # as many documents at a time as have a million shingles
                stop, size = 0, 0
                while stop < len(todo) and stop < 500 and (stop == 0 or size + len(bags[todo[stop]]) < 1_000_000):
                    size += len(bags[todo[stop]])
                    stop += 1
                darts = signatures(*weighted([bags[i] for i in todo[:stop]]), stop, k)
                for i, d in zip(todo[:stop], (darts >> np.uint64(32)).astype(np.uint32).view(np.int32)):
                    out[i] = d
                todo = todo[stop:]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("node"), b.column("text_key"), pa.array(out, pa.list_(pa.int32()))], ["doc_id", "node", "text_key", "darts"])
    return run


def _tagged(batches):
    """Every shingle hashed with its running number in the text: sets with the weighted similarity."""
    for b in batches:
        out = []
        for x in b["h"]:
            x = np.sort(np.asarray(x, dtype=np.int64))
            new = np.r_[True, x[1:] != x[:-1]]
            number = np.arange(len(x)) - np.maximum.accumulate(np.where(new, np.arange(len(x)), 0))
            with np.errstate(over="ignore"):
                out.append(np.where(number > 0, mixed(x.view(np.uint64) + mixed(number.astype(np.uint64))), x.view(np.uint64)).view(np.int64))
        yield pd.DataFrame({"node": b["node"], "bag": out})


def classes(docs: DataFrame, threshold: float = 0.8, n: int = 5, bands: int = BANDS, rows: int = ROWS,
            doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, node, text_key, class_id, kept_node): kept_node is the node of the row with the class's id.

    ``text_key`` is a hash of the text. Texts that have to be compared are sifted out on the scan (``common.find``).
    """
    body = own_columns(docs, doc_id=doc_id, text=text)
    kind = body.schema["doc_id"].dataType.simpleString()
    # the words of a text are made once
    split = body.select("doc_id", F.xxhash64("text").alias("text_key"), words(F.col("text")).alias("w"))
    bags = split.select("doc_id", "text_key", F.when(F.size("w") > 0, F.xxhash64("w")).alias("node"),
                        grams(F.transform("w", lambda x: F.xxhash64(x)), n, lambda *x: F.xxhash64(*x)).alias("h"))
    every = staged(bags.mapInArrow(_sketched(bands * rows), f"doc_id {kind}, node long, text_key long, darts array<int>"))
    band = [F.xxhash64(F.lit(b), *[F.get("darts", F.lit(b * rows + i)) for i in range(rows)]) for b in range(bands)]
    keys = every.where("darts is not null").select(F.explode(F.array(*band)).alias("key"), F.col("node").alias("id")).distinct()

    named = every.where("node is not null").groupBy("node").agg(
        F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "text_key")).alias("r")).select("node", "r.doc_id", "r.text_key")

    def bags_of(wanted: DataFrame) -> DataFrame:
        """(node, bag); one row stands for each node, so that copies are not carried along."""
        chosen = staged(wanted.join(named, "node").select("node", F.col("doc_id").alias("__id"), F.col("text_key").alias("__text")))
        found = find(body, chosen).select("node", shingles(F.col("text"), n).alias("h"))
        return staged(found.mapInPandas(_tagged, "node long, bag array<long>").dropDuplicates(["node"]))

    def verify(pairs: DataFrame) -> DataFrame:
        tagged = bags_of(pairs.select(F.col("a").alias("node")).unionByName(pairs.select(F.col("b").alias("node"))).distinct())
        left = tagged.select(F.col("node").alias("a"), F.col("bag").alias("bag_a"))
        right = tagged.select(F.col("node").alias("b"), F.col("bag").alias("bag_b"))
        shared = F.size(F.array_intersect("bag_a", "bag_b"))
        both = pairs.join(left, "a").join(right, "b").select("a", "b", shared.alias("s"), (F.size("bag_a") + F.size("bag_b")).alias("n"))
        return both.where(F.col("s") >= threshold * (F.col("n") - F.col("s")) - 1e-9).select("a", "b")

    def rarest(ids: DataFrame) -> DataFrame:
        held = bags_of(ids.select(F.col("id").alias("node"))).select("node", F.size("bag").alias("size"), F.explode("bag").alias("x"))
        seen = held.groupBy("x").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
        in_order = F.transform(F.sort_array(F.collect_list(F.struct("n", "x"))), lambda s: s["x"])
        by_node = held.join(seen, "x").groupBy("node", "size").agg(in_order.alias("shared"))
        return by_node.mapInPandas(_rare(threshold), "key long, id long, at long, size long").select("key", "id", F.struct("at", "size").alias("place"))

    def likely(a: Column, b: Column) -> Column:
        # if this is the first run that both hold, no more than what follows it can be shared
        return F.least(a["size"] - a["at"], b["size"] - b["at"]) >= threshold / (1 + threshold) * (a["size"] + b["size"]) - 1e-6

    labels = bucket_classes(keys, verify, later=rarest, likely=likely)
    grouped = named.join(labels, "node", "left").select("node", "doc_id", F.coalesce("label", "node").alias("label"))
    least = grouped.groupBy("label").agg(F.min_by(F.struct("node", "doc_id"), F.struct(F.col("doc_id").isNull(), "doc_id", "node")).alias("r"))
    table = staged(grouped.join(least, "label").select("node", F.col("r.doc_id").alias("class_id"), F.col("r.node").alias("kept_node")))
    with_words = every.where("node is not null").join(table, "node").select("doc_id", "node", "text_key", "class_id", "kept_node")
    alone = every.where("node is null").select("doc_id", "node", "text_key", F.col("doc_id").alias("class_id"), F.lit(None).cast("long").alias("kept_node"))
    return with_words.unionByName(alone)


def deduplicate(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """One document of each class, the one with the smallest id; all columns stay.

    Of rows alike in id and words one stays; texts without words all stay.
    """
    found = classes(docs, doc_id=doc_id, text=text, **options).where("node is not null")
    rows = staged(found.groupBy("doc_id", "node", "text_key").agg(
        F.count(F.lit(1)).alias("n"), F.bool_and(F.expr("node = kept_node AND doc_id <=> class_id")).alias("kept")))
    first = rows.groupBy("doc_id", "node").agg(F.min("text_key").alias("first")).withColumnsRenamed({"doc_id": "__d", "node": "__n"})
    judged = rows.join(first, F.col("doc_id").eqNullSafe(F.col("__d")) & (F.col("node") == F.col("__n")))
    stays = F.col("kept") & (F.col("text_key") == F.col("first"))
    # what goes, and what stays once of several rows alike; all other rows pass by
    special = staged(judged.where(~stays | (F.col("n") > 1)).select(
        F.col("doc_id").alias("__id"), F.col("text_key").alias("__text"), stays.alias("__once")))
    marked = mark(docs, special, doc_id, text)
    columns = [F.col(f"`{c}`") for c in docs.columns]
    stay = marked.where("__once is null").select(*columns)
    if special.where("__once").isEmpty():
        return stay
    once = marked.where("__once").dropDuplicates(["__id", "__text"]).select(*columns)
    return stay.unionByName(once)
