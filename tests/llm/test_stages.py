"""Near-dedup as a stage: null and repeated ids, repeated rows; texts sifted out on the scan."""

import pytest
from pyspark.sql import functions as F

from tidewarden.llm import common, linededup, neardup


@pytest.fixture(params=["broadcast", "exchange", "full filter"])
def way(request, spark, monkeypatch):
    """The joins behind the filter as Spark picks them, all as exchanges, and those with a filter far too small."""
    if request.param != "broadcast":
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    if request.param == "full filter":
        monkeypatch.setattr(common, "FILTER_BLOCKS", 1)
    yield request.param
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_filter_loses_no_row(spark, docs_of, way):
    rows = [(None if i % 50 == 7 else i % 1500, None if i % 90 == 3 else "" if i % 90 == 4 else f"text {i % 1100}") for i in range(3000)]
    docs = docs_of(rows)
    named = {(d, t) for d, t in rows if t is not None and (len(t) % 3 == 0 and t[-1:] in "05" or t in ("text 1", "")) and d != 4}
    listed = spark.createDataFrame([(d, t, i) for i, (d, t) in enumerate(sorted(named, key=repr))], "d long, t string, no long")
    wanted = common.staged(listed.select(F.col("d").alias("__id"), F.xxhash64("t").alias("__text"), F.col("no").alias("__no")))
    found, marked = common.find(docs, wanted), common.mark(docs, wanted)
    assert found.columns == marked.columns == docs.columns + wanted.columns
    key = {r["__no"]: (r.d, r.t) for r in listed.withColumnRenamed("no", "__no").collect()}
    got = [(r.doc_id, r.text, key[r["__no"]]) for r in found.collect()]
    assert all((d, t) == k for d, t, k in got)
    assert sorted(((d, t) for d, t, _ in got), key=repr) == sorted((r for r in rows if r in named), key=repr)
    every = marked.collect()
    assert sorted(((r.doc_id, r.text) for r in every), key=repr) == sorted(rows, key=repr)
    assert all((r["__no"] is not None) == ((r.doc_id, r.text) in named) for r in every)
    nothing = common.staged(wanted.limit(0))
    assert common.find(docs, nothing).count() == 0 and common.mark(docs, nothing).where("__no is null").count() == len(rows)
    assert common.mark(docs.limit(0), wanted).count() == 0


def test_filter_holds_back_other_rows(spark):
    docs = spark.range(40_000).selectExpr("id as doc_id", "concat('text ', id) as text")
    wanted = common.staged(docs.where("doc_id < 2000").select(F.col("doc_id").alias("__id"), F.xxhash64("text").alias("__text")))
    passed = common._sifted(docs, wanted, "doc_id", "text").where("__maybe").count()
    assert 2000 <= passed < 2000 + 38_000 // 100


def test_deduplicate_keeps_one_row_of_each_class(docs_of, prose, way):
    a, b, c = prose(60, 1), prose(60, 2), prose(60, 3)
    rows = [(1, a), (2, a), (2, a), (3, a + " more"), (5, b), (5, b), (5, b + "!"), (None, c), (None, c), (9, c), (None, prose(60, 4)),
            (None, None), (None, None), (7, ""), (8, "!?")]
    docs = docs_of(rows)
    got = neardup.deduplicate(docs)
    assert got.columns == docs.columns
    kept = sorted(((r.doc_id, r.text) for r in got.collect()), key=repr)
    assert (1, a) in kept and (9, c) in kept and (None, prose(60, 4)) in kept
    assert sum(r[0] == 5 for r in kept) == 1 and len(kept) == 4 + 4
    assert neardup.deduplicate(docs.limit(0)).count() == 0
    lines = docs_of([(1, f"{a}\n{b}"), (2, f"{a}x\n{c}"), (None, b), (None, "short")])
    assert sorted(r.text for r in linededup.drop_repeats(lines).collect()) in ([c, "short", f"{a}\n{b}"], ["short", c, f"{a}\n{b}"], sorted(["short", f"{a}x\n{c}", a]), sorted([b, "short", c, a]), sorted([c, "short", b, a]))
