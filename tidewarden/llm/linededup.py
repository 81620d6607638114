"""Line deduplication by a segment-partition edit join.

Equal lines are one line first. A line of length L is split into ``max_edits + 1`` segments; within
``max_edits`` edits one of them must survive. A line looks up, for every length from its own down by
``max_edits``, the substrings that can match a segment given its place and the difference in length.
Candidates are verified by banded bit-parallel edit distance. Classes are connected components of linked
lines; the first line of a class by (doc_id, text hash, line number) stays, the others are repeats.

In buckets that many different lines share all are compared with one hub. Lines of those that then still hold
several classes are dealt anew when one edit is allowed: they are split into ``FINE`` segments, all but one of which
must survive, so that a key covers all of the line but one segment.

Lines end at a newline; those below ``min_chars`` characters are left alone. Null texts have no lines. Rows
that repeat both doc_id and text are the same document. Extra columns stay. An empty table gives no rows. Lines are
told apart by 64-bit hashes and their length.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from tidewarden.llm.classes import bucket_classes
from tidewarden.llm.common import find, let, mark, own_columns, staged

FINE = 16


def cut(length: Column, parts: int, i: int) -> tuple[Column, Column]:
    """Start and size of segment ``i`` of an even partition, the longer segments last."""
    base, longer = F.floor(length / parts).cast("int"), (length % parts).cast("int")
    extra = F.greatest(longer - (parts - i), F.lit(0))
    return base * i + extra, base + F.when(longer >= parts - i, 1).otherwise(0)


def segment_keys(line: Column, length: Column, max_edits: int) -> Column:
    """Keys of a line's own segments and of the substrings it looks up."""
    parts, keys = max_edits + 1, []
    for shorter in range(max_edits + 1):
        indexed = length - shorter
        for i in range(parts):
            start, size = cut(indexed, parts, i)
            # the segment may have moved by the edits left of it, and by what the edits right of it leave
            low, high = max(-i, shorter - (max_edits - i)), min(i, shorter + max_edits - i)
            for move in sorted({*range(low, high + 1), *([0] if shorter == 0 else [])}):
                at = start + move
                fits = (indexed >= 0) & (at >= 0) & (at + size <= length)
                keys.append(F.when(fits, F.xxhash64(F.lit(i), indexed, F.substring(line, at + 1, size))))
    return F.array_distinct(F.array_compact(F.array(*keys)))


def fine_keys(line: Column, length: Column, parts: int = FINE) -> Column:
    """Keys for one edit: the line without one of its segments, as indexed and as one character longer."""
    keys = []
    for shorter in (0, 1):
        indexed = length - shorter
        for i in range(parts):
            start, size = cut(indexed, parts, i)
            rest = start + size + shorter
            keys.append(F.when(indexed >= 0, F.xxhash64(F.lit(-1 - i), indexed, F.substring(line, F.lit(1), start), F.substring(line, rest + 1, length - rest))))
    return F.array_distinct(F.array_compact(F.array(*keys)))


def within(a: list[str], b: list[str], max_edits: int) -> np.ndarray:
    """Whether each a[i] is within ``max_edits`` edits of b[i], all pairs at once.

    Bit d of a state stands for diagonal ``d - max_edits``; one state per number of errors.
    """
    n, t = len(a), max_edits
    la, lb = np.array([len(x) for x in a]), np.array([len(x) for x in b])
    result = np.zeros(n, dtype=bool)
    todo = np.flatnonzero(np.abs(la - lb) <= t)
    for part in np.array_split(todo[np.argsort(la[todo], kind="stable")], max(1, len(todo) // 1024)):
        if not len(part):
            continue
        na, nb, m = la[part], lb[part], len(part)
        wide = int(max(na.max(), nb.max())) + 2 * t + 2
        ca, cb = np.zeros((wide, m), dtype=np.uint32), np.full((wide + t, m), 0xFFFFFFFF, dtype=np.uint32)
        for j, p in enumerate(part):
            ca[:na[j], j] = np.frombuffer(a[p].encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
            cb[t:t + nb[j], j] = np.frombuffer(b[p].encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
        one, full = np.uint64(1), np.uint64(2 ** (2 * t + 1) - 1)
        state = [np.full(m, sum(1 << (t + e) for e in range(d + 1)), dtype=np.uint64) for d in range(t + 1)]
        open_, final = np.ones(m, dtype=bool), [s.copy() for s in state]
        for i in range(int(na.max()) + 1):
            done = open_ & (na == i)
            for d in range(t + 1):
                final[d][done] = state[d][done]
            open_ &= ~done
            if not (open_ & (state[t] != 0)).any():
                break
            match = np.zeros(m, dtype=np.uint64)
            for k in range(2 * t + 1):
                match |= (ca[i] == cb[i + k]).astype(np.uint64) << np.uint64(k)
            before, after = None, None
            for d in range(t + 1):
                old = state[d]
                new = old & match
                if d:
                    new = new | before | (before >> one) | ((after << one) & full)
                before, after = old, new
                state[d] = new
        goal = (nb - na + t).astype(np.uint64)
        ended = ~open_
        result[part] = ended & (((final[t] >> goal) & one) == 1)
    return result


def lines_of(docs: DataFrame, min_chars: int, doc_id: str, text: str) -> DataFrame:
    body = own_columns(docs, doc_id=doc_id, text=text)
    lines = body.select("doc_id", F.xxhash64("text").alias("text_key"), F.posexplode(F.split("text", "\n")).alias("line_no", "line"))
    return lines.withColumn("length", F.length("line")).where(F.col("length") >= min_chars).withColumn("h", F.xxhash64("line", "length"))


def placed_classes(docs: DataFrame, max_edits: int = 1, min_chars: int = 10, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, text_key, line_no, class_doc, class_line, copies, keep), as in ``line_classes``."""
    lines = lines_of(docs, min_chars, doc_id, text)
    keys = segment_keys(F.col("line"), F.col("length"), max_edits)
    # numbers only are shuffled: the keys of equal lines are equal
    width = _key_count(max_edits)
    place = F.struct("doc_id", "text_key", "line_no")
    numbered = staged(lines.select("doc_id", "text_key", "line_no", "h"))
    keyed = lines.select("h", place.alias("at"), keys.alias("keys"))
    distinct = staged(keyed.select("h", "at", *[F.get("keys", F.lit(i)).alias(f"k{i}") for i in range(width)])
                      .groupBy("h").agg(F.count(F.lit(1)).alias("copies"), F.min("at").alias("at"),
                                        *[F.min(f"k{i}").alias(f"k{i}") for i in range(width)]))
    every = distinct.select("h", F.explode(F.array_compact(F.array(*[f"k{i}" for i in range(width)]))).alias("key"))
    shared = every.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    rows = staged(every.join(shared, "key").select("key", F.col("h").alias("id")))
    # the texts of lines that share a key with another one, each from the place where it comes first
    wanted = rows.select(F.col("id").alias("h")).distinct().join(distinct.select("h", "at"), "h")
    by_doc = staged(wanted.groupBy(F.col("at.doc_id").alias("__id"), F.col("at.text_key").alias("__text")).agg(F.collect_list(F.struct("at.line_no", "h")).alias("wanted")))
    body = own_columns(docs, doc_id=doc_id, text=text)
    cut_out = let(F.split("text", "\n"), lambda parts: F.transform("wanted", lambda x: F.struct(
        x["h"].alias("h"), F.get(parts, x["line_no"]).alias("line"))))
    found = find(body, by_doc).select(F.explode(cut_out).alias("x")).select("x.h", "x.line")
    texts = staged(found.where(F.xxhash64("line", F.length("line")) == F.col("h")).dropDuplicates(["h"]))

    def finer(ids: DataFrame) -> DataFrame:
        keyed = ids.join(texts, F.col("id") == F.col("h")).select("id", F.sort_array(fine_keys(F.col("line"), F.length("line"))).alias("place"))
        return keyed.select(F.explode("place").alias("key"), "id", "place")

    def check(batches):
        for b in batches:
            ok = within(list(b["line_a"]), list(b["line_b"]), max_edits)
            yield b.loc[ok, ["a", "b"]]

    def verify(pairs: DataFrame) -> DataFrame:
        left = texts.select(F.col("h").alias("a"), F.col("line").alias("line_a"))
        right = texts.select(F.col("h").alias("b"), F.col("line").alias("line_b"))
        both = pairs.join(left, "a").join(right, "b")
        near = F.abs(F.length("line_a") - F.length("line_b")) <= max_edits
        return both.where(near).select("a", "b", "line_a", "line_b").mapInPandas(check, "a long, b long")

    labels = bucket_classes(rows, verify, later=finer if max_edits == 1 else None)
    known = distinct.select("h", "at", "copies").join(labels, F.col("h") == F.col("node"), "left")
    known = known.select("h", "at", "copies", "label")
    alone = known.where("label is null").select("h", "copies", F.col("at").alias("first"))
    together = known.where("label is not null")
    least = together.groupBy("label").agg(F.min("at").alias("first"))
    joined = together.join(least, "label").select("h", "copies", "first")
    table = staged(alone.unionByName(joined))
    return numbered.select("doc_id", "text_key", "line_no", "h").join(table, "h").select(
        "doc_id", "text_key", F.col("line_no").cast("long").alias("line_no"), F.col("first.doc_id").alias("class_doc"),
        F.col("first.line_no").cast("long").alias("class_line"), "copies", F.col("first").eqNullSafe(place).alias("keep"))


def line_classes(docs: DataFrame, **options) -> DataFrame:
    """(doc_id, line_no, class_doc, class_line, copies, keep), a row for every line of ``min_chars`` and more.

    ``class_doc`` and ``class_line`` are the place of the first line of the class, ``copies`` the number of
    lines equal to this one.
    """
    return placed_classes(docs, **options).drop("text_key")


def _key_count(max_edits: int) -> int:
    total = 0
    for shorter in range(max_edits + 1):
        for i in range(max_edits + 1):
            low, high = max(-i, shorter - (max_edits - i)), min(i, shorter + max_edits - i)
            total += len({*range(low, high + 1), *([0] if shorter == 0 else [])})
    return total


def drop_repeats(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """Texts without their repeated lines; documents that lose all their lines go; all columns stay.

    Texts that had no line to lose stay as they are.
    """
    repeats = placed_classes(docs, doc_id=doc_id, text=text, **options).where("not keep")
    gone = repeats.groupBy(F.col("doc_id").alias("__id"), F.col("text_key").alias("__text")).agg(F.collect_set(F.col("line_no").cast("int")).alias("__gone"))
    body = F.col(f"`{text}`")
    parts = F.split(body, "\n")
    left = F.array_sort(F.array_except(F.sequence(F.lit(0), F.size("__lines") - 1), "__gone"))
    joined = mark(docs, staged(gone), doc_id, text)
    rows = joined.withColumn("__lines", parts).withColumn("__left", F.when(F.col("__gone").isNotNull(), left))
    rebuilt = F.array_join(F.transform("__left", lambda i: F.get(F.col("__lines"), i)), "\n")
    rows = rows.withColumn(text, F.when(F.col("__left").isNotNull(), rebuilt).otherwise(body))
    emptied = F.col("__left").isNotNull() & (F.trim(F.col(f"`{text}`")) == "")
    return rows.where(~emptied).select(*[f"`{c}`" for c in docs.columns])
