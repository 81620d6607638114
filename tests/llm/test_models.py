"""Near duplicates and line dedup against brute force; classifiers and pipeline on held-out rows."""

import random
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

import corpus_pipeline
from tidewarden.llm import classes, decontaminate, langid, linededup, neardup, quality, toxicity
from tidewarden.llm.common import fold


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def grouped(n, linked):
    """Class of 0..n-1 as its smallest member."""
    root = list(range(n))
    def find(i):
        while root[i] != i:
            i = root[i]
        return i
    for i in range(n):
        for j in range(i):
            if linked(i, j):
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return [find(i) for i in range(n)]


# ---- classes

def test_components_of_chains_and_stars(spark):
    links = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(1, 50)] + [(200, 201), (201, 200)]
    got = {r.node: r.label for r in classes.components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(41)}, **{100 + i: 100 for i in range(50)}, 200: 200, 201: 200}


def test_large_buckets_lose_no_link(spark):
    """Neighbours on a line share one bucket: no hub reaches them all."""
    rows = spark.createDataFrame([(1, i) for i in range(30)] + [(2, 0), (2, 60)], "key long, id long")
    got = classes.bucket_classes(rows, lambda p: p.where("b - a = 1"), small=4)
    assert {r.node: r.label for r in got.collect()} == {i: 0 for i in range(30)}


# ---- near duplicates

def similarity(a, b, n=5):
    bags = []
    for t in (a, b):
        w = t.lower().split()
        bags.append(Counter(tuple(w[i:i + n]) for i in range(len(w) - n + 1)))
    total = sum((bags[0] | bags[1]).values())
    return sum((bags[0] & bags[1]).values()) / total if total else 0.0


def test_near_duplicates(docs_of, prose):
    rnd, texts = random.Random(3), []
    for g in range(12):
        base = prose(rnd.choice([8, 30, 120, 400]), g).split()
        for _ in range(rnd.randint(1, 14)):
            w = list(base)
            for _ in range(rnd.choice([0, 0, 1, 1, 2, 6, 40])):
                w[rnd.randrange(len(w))] = prose(1, rnd.random())
            texts.append(" ".join(w))
    texts += ["one two", "one two", "same " * 200, "same " * 230, "same " * 400]
    rows = [(i, t) for i, t in enumerate(texts)] + [(900, None), (901, ""), (902, "..."), (3, texts[3]), (None, texts[0])]
    out = neardup.classes(docs_of(rows)).collect()
    assert len(out) == len(rows)
    want = grouped(len(texts), lambda i, j: texts[i] == texts[j] or similarity(texts[i], texts[j]) >= 0.8 - 1e-9)
    got = {r.doc_id: r.class_id for r in out}
    assert got.pop(None) == want[0]
    assert got == {**dict(enumerate(want)), 900: 900, 901: 901, 902: 902}
    kept = sorted(r.doc_id for r in neardup.deduplicate(docs_of(rows)).collect())
    assert kept == sorted({*want, 900, 901, 902})
    assert neardup.classes(docs_of(rows).limit(0)).count() == 0


def test_darts_estimate_weighted_jaccard():
    rnd = np.random.default_rng(5)
    elements = rnd.integers(-2 ** 63, 2 ** 63 - 1, 300)
    a, b = np.repeat(elements[:220], rnd.integers(1, 9, 220)), np.repeat(elements[80:], rnd.integers(1, 9, 220))
    ca, cb = Counter(a.tolist()), Counter(b.tolist())
    true = sum((ca & cb).values()) / sum((ca | cb).values())
    s = neardup.signatures(*neardup.weighted([a, b, a[::-1]]), 3, 2048)
    assert (s[0] == s[2]).all() and abs((s[0] == s[1]).mean() - true) < 0.04


# ---- lines

@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(st.text("abé\U0001f600", max_size=9), st.text("abé\U0001f600", max_size=9)), min_size=1, max_size=20), st.integers(0, 3))
def test_banded_distance(pairs, limit):
    got = linededup.within([a for a, _ in pairs], [b for _, b in pairs], limit)
    assert got.tolist() == [distance(a, b) <= limit for a, b in pairs]


@pytest.mark.parametrize("edits", [1, 2])
def test_line_classes(docs_of, edits):
    rnd, lines = random.Random(edits), []
    for _ in range(6):
        base = "".join(rnd.choice("abcdef ") for _ in range(rnd.choice([10, 11, 25, 60])))
        for _ in range(rnd.randint(1, 16)):
            w = list(base)
            for _ in range(rnd.choice([0, 1, 1, 2, 3])):
                at = rnd.randrange(len(w))
                w[at:at + 1] = rnd.choice([[], ["x"], [w[at], "y"], ["\U0001f600"]])
            lines.append("".join(w))
    rnd.shuffle(lines)
    docs, at = [], 0
    while at < len(lines):
        docs.append((len(docs), "\n".join(lines[at:at + 4]) + "\nshort"))
        at += 4
    docs += [(500, None), (501, ""), (502, "\n\n"), (0, docs[0][1]), (503, "z" * 100_000 + "\n" + "z" * 99_999)]
    out = linededup.line_classes(docs_of(docs), max_edits=edits).collect()
    places, texts = [], []
    for d, t in sorted({x for x in docs if x[1]}):
        for i, line in enumerate(t.split("\n")):
            if len(line) >= 10:
                places.append((d, i))
                texts.append(line)
    want = grouped(len(texts), lambda i, j: texts[i] == texts[j] or (abs(len(texts[i]) - len(texts[j])) <= edits and len(texts[i]) < 1000
                                                                    and distance(texts[i], texts[j]) <= edits) or texts[i][:1000] == texts[j][:1000] == "z" * 1000)
    got = {(r.doc_id, r.line_no): (r.class_doc, r.class_line) for r in out}
    assert got == {p: places[c] for p, c in zip(places, want)}
    assert all(r.keep == ((r.doc_id, r.line_no) == (r.class_doc, r.class_line)) for r in out)
    left = {r.doc_id: r.text for r in linededup.drop_repeats(docs_of(docs), max_edits=edits).collect()}
    assert left[500] is None and left[501] == "" and left[502] == "\n\n" and left[503] == "z" * 100_000
    assert linededup.line_classes(docs_of(docs).limit(0)).count() == 0


def test_null_and_repeated_ids_keep_their_own_lines(docs_of):
    rows = [(1, "one\ntwo\nthe same long line"), (None, "three\nfour\nthe same long line"), (None, "five\nsix\nan unlike thing 2"),
            (7, "a\nb\nthe same long line"), (7, "c\nd\nanother long text"), (None, "the same long line"), (None, "some unlike words here")]
    left = [line for r in linededup.drop_repeats(docs_of(rows)).collect() for line in r.text.split("\n")]
    assert sorted(left) == sorted({line for _, text in rows for line in text.split("\n")})


def test_null_ids_do_not_share_contamination(docs_of, prose):
    item, clean = prose(20, 1), [prose(40, 2), prose(40, 3)]
    rows = [(None, f"{prose(9, 4)} {item}"), (None, clean[0]), (5, clean[1]), (5, item)]
    items = docs_of([(1, item)]).select(F.col("doc_id").alias("item_id"), "text")
    assert sorted(r.text for r in decontaminate.clean(docs_of(rows), items).collect()) == sorted(clean)


# ---- classifiers

@pytest.fixture(scope="module")
def marked(spark):
    """Clean prose, prose with insults, shouted prose; rare and empty texts are not labelled."""
    rnd = random.Random(11)
    vocabulary = ["".join(rnd.choice("aeioubcdrst") for _ in range(rnd.randint(2, 8))) for _ in range(300)]
    rows, labels = [], []
    for i in range(600):
        w = [rnd.choice(vocabulary) for _ in range(rnd.randint(30, 200))]
        toxic, bad = i % 4 == 1, i % 4 == 2
        for _ in range(3 if toxic else 0):
            w[rnd.randrange(len(w))] = rnd.choice(["wretchedfool", "miserablecad", "vilescoundrel"])
        rows.append((i, " ".join(f"{x.upper()}!!" if bad else x for x in w), "de" if i % 2 else "en", "s"))
        labels.append((i, int(not bad), int(toxic)))
    rows += [(5000, None, "en", "s"), (5001, "", None, "s"), (5002, "... 12", "en", None), rows[1], (None, "no id here", "en", "s")]
    labels += [(None, 1, 1), (0, None, None), (9999, 1, 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").withColumn("score", F.lit(5))
    return docs, spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


@pytest.mark.parametrize("module,label,limit", [(toxicity, "toxic", 0.5), (quality, "quality", 0.7)])
def test_classifiers(marked, module, label, limit):
    docs, labels = marked
    model = module.train(docs, labels, lambda d: fold(d, 4) != 2)
    out = module.scores(docs, model).collect()
    assert len(out) == docs.count() and all(0 <= r.score <= 1 for r in out)
    truth = {r.doc_id: r[label] for r in labels.collect()}
    held = {r.doc_id for r in docs.where(fold(F.col("doc_id"), 4) == 2).collect()}
    tested = [(r.score >= limit, truth[r.doc_id] == 1) for r in out if r.doc_id in held and truth.get(r.doc_id) is not None]
    assert len(tested) > 100 and np.mean([a == b for a, b in tested]) > 0.93
    constant = module.train(docs, labels.limit(0), lambda d: fold(d, 4) != 2)
    assert {r.score for r in module.scores(docs, constant).collect()} == {0.0}
    assert module.scores(docs.limit(0), model).count() == 0


def test_short_and_many_toxic_words_are_learned(spark):
    words = ["cad", "oaf"] + [f"insult{i}" for i in range(450)]
    rows = [(i, " ".join(["plain", "text", *(words if i % 2 else [])]), i % 2) for i in range(60)]
    assert set(toxicity.distinctive_words(spark.createDataFrame(rows, "doc_id long, text string, y int"))) == set(words)


def test_languages(spark):
    rnd = random.Random(2)
    stems = {"en": ["the", "of", "thing", "world", "where"], "de": ["der", "und", "schön", "wäre", "nicht"], "fr": ["le", "été", "où", "jour", "quoi"]}
    rows = [(i, " ".join(rnd.choice(stems[lang]) + rnd.choice(["", "", "s", "a", "in"]) for _ in range(rnd.randint(3, 40))), lang)
            for i, lang in enumerate(rnd.choices(list(stems), k=500))]
    rows += [(900, None, "en"), (901, "12 34!", "de"), (902, "", None), (903, "schönste", None), (904, "x" * 50_000, None), rows[0]]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").withColumn("score", F.lit("x"))
    model = langid.train(docs, lambda d: fold(d, 4) != 2)
    out = {r.doc_id: r for r in langid.predictions(docs, model).collect()}
    assert {out[i].lang_pred for i in (900, 901, 902)} == {"und"} and out[903].lang_pred == "de" and out[904].lang_pred in stems
    held = {r.doc_id for r in docs.where(fold(F.col("doc_id"), 4) == 2).collect()}
    assert np.mean([out[i].lang_pred == lang for i, _, lang in rows[:500] if i in held]) > 0.97
    assert all(0 <= r.score <= 1 for r in out.values())
    assert {r.lang_pred for r in langid.predictions(docs, langid.train(docs.limit(0), lambda d: fold(d, 4) != 2)).collect()} == {"und"}


def test_large_languages_leave_small_ones_their_words(spark):
    letters = "abcdefghij"
    wide = " ".join("".join(letters[int(c)] for c in str(i)) for i in range(100_000, 181_000))
    rows = [(1, f"{wide} {wide}", "aa"), (2, "zyx wvu", "zz"), *((10 + i, "x" * 90, f"l{i}") for i in range(210))]
    model = langid.train(spark.createDataFrame(rows, "doc_id long, text string, lang string"), lambda d: d > 0)
    assert len(model.langs) == 212 and model.predict(["zyx"])[0] == ["zz"] and "x" * 90 in model.words


def test_backoff_uses_the_longest_known_pieces():
    model = langid.Model([("a", "windmill", 9), ("b", "sunlight", 9)])
    assert np.argmax(model.word_score("windmills")) == 0 and np.argmax(model.word_score("sunny")) == 1
    assert "windmills" not in model.words and (model.word_score("windmill") == model.words["windmill"]).all()


# ---- pipeline

def test_pipeline(spark, tmp_path, marked, prose):
    docs, labels = marked
    item = prose(40, 999)
    copy = docs.where("doc_id = 4").first().text
    extra = [(7000, item + "\n" + prose(90, 5), "en", "t"), (7001, copy + " tail", "en", "t"), (7002, prose(100, 6) + "\n" + prose(30, 8), "en", None),
             (7003, prose(100, 7) + "\n" + prose(30, 8), "en", "t")]
    every = docs.drop("score").unionByName(spark.createDataFrame(extra, "doc_id long, text string, lang string, source string"))
    every.withColumn("n_chars", F.length("text").cast("long")).write.parquet(f"{tmp_path}/documents.parquet")
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, item), (2, None)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    now, seen = spark.read.parquet(f"{tmp_path}/documents.parquet"), {}
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        before, now = now, stage(spark, now, str(tmp_path))
        now.write.parquet(f"{tmp_path}/stage{i}")
        now = spark.read.parquet(f"{tmp_path}/stage{i}")
        seen[name] = {r.doc_id for r in now.collect()}
        if name != "mixing":
            assert now.columns == before.columns
    shouted = {i for i in range(600) if i % 4 == 2}
    assert len(seen["quality"] & shouted) < 10 and len({i for i in range(600)} - shouted - seen["quality"]) < 10
    lines = {r.doc_id: r.text for r in spark.read.parquet(f"{tmp_path}/stage1").collect()}
    assert prose(30, 8) in lines[7002] and prose(30, 8) not in lines[7003]
    assert {4, 7001} & seen["near duplicates"] == {4} and 7000 in seen["near duplicates"] and 7000 not in seen["decontamination"]
    assert seen["mixing"] == seen["decontamination"]
    assert now.columns == ["doc_id", "size", "source_size", "target", "taken"]
