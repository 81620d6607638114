"""Spelling variants grouped by asymmetric q-chunks.

Two words are near when they differ by one inserted, deleted or replaced code point. The shorter word is cut
into two disjoint chunks; one edit leaves one of them whole. The other word gives its grams of that length at
the places where the chunk can stand: where it stood, or one further on when a code point came in before it.
Halves of common words are shared by thousands of words, so the same step is taken once more inside the half
that the edit may have hit: a key holds the whole chunk and the whole chunk of the rest, which leaves a
quarter of the word open. Words that meet in a key are verified by edit distance. Pairs are joined from the
shorter word to the longer one, or from the smaller to the larger of equal length, so that each is made once.

A word's form is its most frequent near word if that is frequent enough; roots follow forms to their end
by doubling. Words are compared by code point. Words shorter than ``min_length`` or rarer than ``min_count``
take no part. Null texts have no words, a null doc_id reads as empty. Repeated rows count again. Extra columns
are ignored; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from tidewarden.llm.common import own_columns, staged

RUN = "[A-Za-zÀ-ÿ]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def word_counts(docs: DataFrame, min_length: int = 6, min_count: int = 5, slips: int = 199,
                doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(word, n). Where ``slips`` divides crc32 of ``doc_id:run``, code point ``crc32 % length`` of the run is lost."""
    body = own_columns(docs, doc_id=doc_id, text=text)
    label = F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(":"))
    runs = body.select(label.alias("label"), F.explode(F.regexp_extract_all(F.translate("text", UPPER, LOWER), F.lit(RUN), F.lit(0))).alias("run"))
    h = F.crc32(F.concat("label", "run").cast("binary"))
    hashed = runs.where(F.length("run") >= min_length).select("run", h.alias("h"))
    at = (F.col("h") % F.length("run")).cast("int")
    cut = F.concat(F.substring("run", F.lit(1), at), F.substring("run", at + 2, F.length("run")))
    words = hashed.select(F.when(F.col("h") % slips == 0, cut).otherwise(F.col("run")).alias("word"))
    return (words.where(F.length("word") >= min_length).groupBy("word").agg(F.count(F.lit(1)).alias("n"))
            .where(F.col("n") >= min_count))


def _quarters(length: Column) -> list[tuple[Column, Column]]:
    """(start, end) of the chunks of the two chunks of a word."""
    half = F.floor(length / 2).cast("int")
    first, third = F.floor(half / 2).cast("int"), (half + F.floor((length - half) / 2)).cast("int")
    return [(F.lit(0), first), (first, half), (half, third), (third, length)]


def chunk_keys(word: Column, longer: int) -> Column:
    """Keys of ``word`` as one that is ``longer`` code points longer than the word that was cut."""
    length = (F.length(word) - longer).cast("int")
    # what stands before the open quarter has not moved, what stands behind it has moved by ``longer``
    return F.array(*[F.xxhash64(length, F.lit(i), F.substring(word, F.lit(1), start), F.substring(word, end + longer + 1, length))
                     for i, (start, end) in enumerate(_quarters(length))])


def near_pairs(words: DataFrame) -> DataFrame:
    """(a, n_a, b, n_b), each pair of near words once; ``words`` holds distinct words and their n."""
    cut = words.select(F.col("word").alias("a"), F.col("n").alias("n_a"), F.explode(chunk_keys(F.col("word"), 0)).alias("key"))
    grams = words.select(F.col("word").alias("b"), F.col("n").alias("n_b"),
                         F.explode(F.concat(chunk_keys(F.col("word"), 0), chunk_keys(F.col("word"), 1))).alias("key"))
    met = cut.join(grams, "key").where((F.length("a") < F.length("b")) | ((F.length("a") == F.length("b")) & (F.col("a") < F.col("b"))))
    return met.where(F.levenshtein("a", "b", 1) == 1).select("a", "n_a", "b", "n_b").distinct()


def followed(forms: DataFrame) -> DataFrame:
    """(word, root) from (word, form): forms lead to more frequent words, so they end."""
    roots = staged(forms.select("word", F.col("form").alias("root")))
    while True:
        step = roots.select(F.col("word").alias("root"), F.col("root").alias("next"))
        after = staged(roots.join(step, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")))
        roots = after.select("word", "root")
        if after.where("moved").isEmpty():
            return roots


def variants(words: DataFrame, ratio: int = 5) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of a table of distinct words and their n."""
    words = staged(words.select("word", "n"))
    pairs = staged(near_pairs(words))
    both = pairs.select(F.col("a").alias("word"), F.col("b").alias("other"), F.col("n_b").alias("other_n")).unionByName(
        pairs.select(F.col("b").alias("word"), F.col("a").alias("other"), F.col("n_a").alias("other_n")))
    best = both.groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), F.min(F.struct((-F.col("other_n")).alias("less"), "other")).alias("best"))
    enough = -F.col("best.less") >= ratio * F.col("n")
    judged = staged(words.join(best, "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
        F.when(enough, F.col("best.other")).alias("form"), F.when(enough, -F.col("best.less")).cast("long").alias("form_n")))
    roots = followed(judged.where("form is not null"))
    return judged.join(roots, "word", "left").select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
