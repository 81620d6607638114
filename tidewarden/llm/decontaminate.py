"""Benchmark decontamination by size-partitioned MinHash containment search.

Items are partitioned by size (powers of two of their distinct word shingles). An item's signature
is its ``m`` smallest shingle hashes, ``m`` set by its size so that a document with at least
``threshold`` of the shingles must hold one of them: at most ``q - ceil(threshold q)`` shingles may
be missing, and ``m`` is one more. On the side of the documents a size class needs only the hashes
up to its largest signature value, and only documents with enough shingles. Nothing that reaches
the threshold is lost however long the document. Candidates are then verified on the shingles
themselves.

Items of fewer than ``n`` words have no shingle and are never found; null texts likewise. Rows that
repeat a doc_id or item_id give one result row, with the highest containment. Null ids are ids like
any other. Extra columns are ignored. Empty tables give no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from tidewarden.llm.common import let, own_columns, shingles, staged, words


def signatures(items: DataFrame, threshold: float, n: int) -> DataFrame:
    """(size_class, least, hash, item_id, item_row): one row per signature value."""
    hashed = items.select("item_id", "item_row", F.array_distinct(shingles(F.col("text"), n)).alias("h"))
    sized = hashed.where(F.size("h") > 0).select(
        "item_id", "item_row", F.sort_array("h").alias("h"), F.size("h").alias("q"),
        F.floor(F.log2(F.size("h"))).cast("int").alias("size_class"))
    need = F.ceil(F.col("q") * threshold - 1e-9).cast("int")
    return sized.select("size_class", "item_id", "item_row", need.alias("need"),
                        F.explode(F.slice("h", 1, F.col("q") - need + 1)).alias("hash"))


def verified(items: DataFrame, docs: DataFrame, threshold: float = 0.8, n: int = 5, item_id: str = "item_id",
              doc_id: str = "doc_id", item_text: str = "text", text: str = "text") -> DataFrame:
    """(doc_id, text_key, item_id, n_item, n_shared, containment) for containment of at least ``threshold``."""
    items = staged(own_columns(items, item_id=item_id, text=item_text)
                   .select("item_id", F.monotonically_increasing_id().alias("item_row"), "text"))
    sigs = staged(signatures(items, threshold, n))
    classes = sigs.groupBy("size_class").agg(F.max("hash").alias("cut"), F.min("need").alias("least"))
    sigs = staged(sigs.join(F.broadcast(classes), "size_class"))  # at most 31 size classes
    bound = classes.agg(F.max("cut").alias("cut"), F.min("least").alias("least"))

    body = own_columns(docs, doc_id=doc_id, text=text)
    key = F.xxhash64("text").alias("text_key")
    probes = body.select("doc_id", key, shingles(F.col("text"), n).alias("h"), bound.select("cut").scalar().alias("cut"))
    probes = probes.select("doc_id", "text_key", F.size("h").alias("n_doc"),
                           F.explode(F.filter("h", lambda x: x <= F.col("cut"))).alias("hash"))
    found = staged(probes.join(sigs.select("hash", "item_row", "least"), "hash")
                   .where("n_doc >= least").select("doc_id", "text_key", "item_row").distinct())
    # exact: the item's shingles as text, looked up in the document's words
    text_of = body.select(F.col("doc_id").alias("__id"), key.alias("__key"), "text")
    with_text = (found.join(text_of, F.col("doc_id").eqNullSafe(F.col("__id")) & (F.col("text_key") == F.col("__key")))
                 .select("doc_id", "text_key", "item_row", F.array_join(words(F.col("text")), " ").alias("plain")))
    item_words = items.select("item_row", "item_id", words(F.col("text")).alias("w")).where(F.size("w") >= n)
    runs = let(F.col("w"), lambda w: F.transform(F.sequence(F.lit(1), F.size(w) - (n - 1)), lambda i: F.array_join(F.slice(w, i, n), " ")))
    item_runs = item_words.select("item_row", "item_id", F.array_distinct(runs).alias("runs"))
    shared = let(F.concat(F.lit(" "), "plain", F.lit(" ")), lambda p: F.size(F.filter(
        "runs", lambda r: F.contains(p, F.concat(F.lit(" "), r, F.lit(" "))))))
    exact = with_text.join(item_runs, "item_row").select("doc_id", "text_key", "item_id", F.size("runs").alias("n_item"), shared.alias("n_shared"))
    return exact.withColumn("containment", F.col("n_shared") / F.col("n_item")).where(F.col("containment") >= threshold - 1e-9)


def contained(items: DataFrame, docs: DataFrame, **options) -> DataFrame:
    """(doc_id, item_id, n_item, n_shared, containment) for containment of at least ``threshold``."""
    return (verified(items, docs, **options).groupBy("doc_id", "item_id")
            .agg(F.max(F.struct("containment", "n_shared", "n_item")).alias("b"))
            .select("doc_id", "item_id", F.col("b.n_item").cast("long").alias("n_item"),
                    F.col("b.n_shared").cast("long").alias("n_shared"), F.col("b.containment").alias("containment")))


def clean(docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """Documents that contain no item; all columns stay. A document is its id and its text."""
    hit = verified(items, docs, doc_id=doc_id, text=text, **options).select(F.col("doc_id").alias("__hit"), F.col("text_key").alias("__text")).distinct()
    return docs.join(hit, F.col(f"`{doc_id}`").eqNullSafe(F.col("__hit")) & (F.xxhash64(f"`{text}`") == F.col("__text")), "left_anti")
