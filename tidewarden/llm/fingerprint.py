"""Document fingerprints by winnowing.

Grams are runs of ``k`` words under a Karp-Rabin hash. Of every ``window`` neighbouring grams the
smallest is kept, of equal ones the rightmost, with its position. Two texts that share a run of
``k + window - 1`` words share a fingerprint entry; shared runs below ``k`` words leave none.

A pick is one long: the 31-bit hash above the complement of the 31-bit word position, so that the
minimum of a window prefers the rightmost of equal hashes. Texts with fewer than ``k`` words are one
gram; texts with fewer than ``window`` grams are one window. Null texts are empty; texts without
words have no picks, and two of them are alike (likeness 1). Whole texts are processed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from tidewarden.llm.common import let, own_columns, ranked, staged, words

#: modulus and base of the rolling hash; products stay below 2^62
PRIME, BASE = 2 ** 31 - 1, 1_000_003
LOW = 2 ** 31 - 1


def _paired(a: Column, b: Column, skip: int, n: Column, combine) -> Column:
    """``combine(a[i], b[i + skip])`` for the first ``n`` places."""
    return F.zip_with(F.slice(a, F.lit(1), n), F.slice(b, F.lit(1 + skip), n), combine)


def _rolled(codes: Column, k: int) -> Column:
    """Karp-Rabin hashes of all runs of ``k`` codes, from those of runs of half the length."""
    def power(n: int) -> int:
        return pow(BASE, n, PRIME)

    def grow(done: Column, have: int) -> Column:
        if have == k:
            return done
        step = have if 2 * have <= k else 1
        tail = done if step == have else codes
        longer = _paired(done, tail, have, F.size(codes) - (have + step - 1), lambda x, y: (x * power(step) + y) % PRIME)
        return let(longer, lambda h: grow(h, have + step))

    return grow(codes, 1)


def _smallest(values: Column, window: int) -> Column:
    """Minimum of every ``window`` neighbours, from minima of spans of powers of two."""
    def grow(done: Column, have: int) -> Column:
        if have == window:
            return done
        step = min(have, window - have)
        wider = _paired(done, done, step, F.size(values) - (have + step - 1), lambda x, y: F.least(x, y))
        return let(wider, lambda m: grow(m, have + step))

    return grow(values, 1)


def gram_hashes(text: Column, k: int = 5) -> Column:
    """Rolling hashes of all runs of ``k`` words; of all words together if there are fewer."""
    codes = F.transform(words(text), lambda w: F.pmod(F.xxhash64(w), F.lit(PRIME)))
    whole = lambda c: F.aggregate(c, F.lit(0).cast("long"), lambda a, v: (a * BASE + v) % PRIME)
    return let(codes, lambda c: F.when(F.size(c) >= k, _rolled(c, k)).when(F.size(c) > 0, F.array(whole(c)))
               .otherwise(F.expr("cast(array() as array<bigint>)")))


def winnow(text: Column, k: int = 5, window: int = 8) -> Column:
    """Distinct picks of a text in order of position, as longs (see ``pick_hash``, ``pick_position``)."""
    marked = F.transform(gram_hashes(text, k), lambda h, i: h * (LOW + 1) + (F.lit(LOW) - i))
    return let(marked, lambda m: F.when(F.size(m) > window, F.array_distinct(_smallest(m, window)))
               .when(F.size(m) > 0, F.array(F.array_min(m))).otherwise(m))


def pick_hash(pick: Column) -> Column:
    return F.shiftright(pick, 31)


def pick_position(pick: Column) -> Column:
    return (F.lit(LOW) - pick.bitwiseAND(F.lit(LOW))).cast("int")


def hashes(picks: Column) -> Column:
    return F.array_distinct(F.transform(picks, lambda p: pick_hash(p).cast("int")))


def likeness(a: Column, b: Column) -> Column:
    """Jaccard of two distinct hash arrays, 1 if both are empty."""
    both = F.size(F.array_intersect(a, b))
    return let(both, lambda n: F.when(F.size(a) + F.size(b) == 0, F.lit(1.0)).otherwise(
        n / (F.size(a) + F.size(b) - n)))


def digest(picks: Column) -> Column:
    """Short text of a fingerprint, hashes and positions."""
    return F.lower(F.concat(F.lpad(F.hex(F.xxhash64(picks)), 16, "0"), F.lpad(F.hex(F.xxhash64(F.lit(1), picks)), 16, "0")))


def fingerprints(docs: DataFrame, k: int = 5, window: int = 8, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """All input columns and ``picks``: array of (hash, position)."""
    picks = F.transform(winnow(F.col(f"`{text}`"), k, window), lambda p: F.struct(
        pick_hash(p).alias("hash"), pick_position(p).alias("position")))
    return docs.withColumn("picks", picks)


def edited_fingerprints(docs: DataFrame, k: int = 5, window: int = 8, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next.

    The next document is the one with the next larger doc_id, after the last the first; of rows
    that repeat an id one stands for it, chosen by the hash of its text. Rows with a null id stand in no order: nothing
    is appended to them, and their next text is empty. A single document is its own next.
    Picks are made once per text; only heads and hash arrays travel to the document before.
    """
    body = own_columns(docs, doc_id=doc_id, text=text).withColumn("text", F.coalesce("text", F.lit("")))
    body = body.withColumn("text_key", F.xxhash64("text"))
    own = staged(body.select("doc_id", "text_key", F.length("text").cast("long").alias("n_chars"), winnow(F.col("text"), k, window).alias("picks"))
                 .select("doc_id", "text_key", "n_chars", digest(F.col("picks")).alias("fingerprint"), hashes(F.col("picks")).alias("own")))
    order = staged(ranked(own, "doc_id"))
    count = order.agg(F.count(F.lit(1)).alias("n"))
    before = order.select(F.col("doc_id").alias("prev_id"), F.pmod(F.col("rank") + 1, F.greatest(count.scalar(), F.lit(1))).alias("rank"))
    quarters = own.groupBy("doc_id").agg(F.floor(F.max("n_chars") / 4).cast("int").alias("quarter")).withColumnRenamed("doc_id", "prev_id")
    links = staged(order.join(before, "rank").join(quarters, "prev_id").select("doc_id", "prev_id", "quarter"))

    # one exchange of the texts serves both sides of the join
    keyed = body.where("doc_id is not null").repartition("doc_id")
    first = Window.partitionBy("doc_id").orderBy("text_key")
    ahead = (keyed.join(links, "doc_id").withColumn("__n", F.row_number().over(first)).where("__n = 1")
             .select("prev_id", F.col("doc_id").alias("next_id"), F.col("text_key").alias("next_key"),
                     F.substring("text", F.lit(1), F.col("quarter")).alias("head")))
    # of rows alike in id and text one is edited, its result serves all
    once = keyed.withColumn("__n", F.row_number().over(Window.partitionBy("doc_id", "text_key").orderBy("text_key"))).where("__n = 1")
    placed = once.join(ahead, F.col("doc_id") == F.col("prev_id"), "left").select("doc_id", "text_key", "text", "next_id", "next_key", "head")
    loose = body.where("doc_id is null").dropDuplicates(["text_key"]).select(
        "doc_id", "text_key", "text", F.lit(None).cast("long").alias("next_id"), F.lit(None).cast("long").alias("next_key"), F.lit("").alias("head"))
    quarter = F.floor(F.length("text") / 4).cast("int")
    edited = F.concat(F.substring("text", F.lit(1), F.length("text") - quarter), F.substring(F.coalesce("head", F.lit("")), F.lit(1), quarter))
    edits = placed.unionByName(loose).withColumn("edited", edited)
    edits = edits.select("doc_id", "text_key", "next_id", "next_key", F.sha2("edited", 256).alias("edited_sha256"),
                         winnow(F.col("edited"), k, window).alias("picks"))
    edits = staged(edits.select("doc_id", "text_key", "next_id", "next_key", "edited_sha256",
                                digest(F.col("picks")).alias("edited_fingerprint"), hashes(F.col("picks")).alias("other")))

    following = own.dropDuplicates(["doc_id", "text_key"]).select(
        F.col("doc_id").alias("next_id"), F.col("text_key").alias("next_key"), F.col("own").alias("next_own"))
    e = edits.join(following, ["next_id", "next_key"], "left").withColumnRenamed("doc_id", "e_id").withColumnRenamed("text_key", "e_key")
    rows = own.join(e, F.col("doc_id").eqNullSafe(F.col("e_id")) & (F.col("text_key") == F.col("e_key")))
    return rows.select("doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint",
                       likeness(F.col("own"), F.col("other")).alias("near_edited"),
                       likeness(F.col("own"), F.coalesce("next_own", F.expr("cast(array() as array<int>)"))).alias("near_next"))
