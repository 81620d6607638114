"""Phrase collocations against brute force, with shards and ranges small enough to cut everything."""

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from tidewarden.llm import collocations

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def expected(rows, least, longest, top):
    n, f = Counter(), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(LOWER)):
            words = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(words)
            for k in range(1, longest + 1):
                for i in range(len(words) - k + 1):
                    f[lang, tuple(words[i:i + k])] += 1
    candidates = {p: a for p, a in f.items() if a >= least and len(p[1]) > 1}
    covered = set()
    for (lang, words), a in candidates.items():
        for k in range(2, len(words)):
            for i in range(len(words) - k + 1):
                if (lang, words[i:i + k]) in candidates and a >= candidates[lang, words[i:i + k]]:
                    covered.add((lang, words[i:i + k]))
    by_lang = defaultdict(list)
    for (lang, words), a in candidates.items():
        if (lang, words) not in covered:
            cuts = [(f[lang, words[:k]], f[lang, words[k:]]) for k in range(1, len(words))]
            score, k = min((1000 * a * n[lang] // (x * y), k) for k, (x, y) in enumerate(cuts))
            by_lang[lang].append((-score, -a, " ".join(words).encode(), *cuts[k]))
    return {(lang, i + 1, p.decode(), -a, x, y, n[lang], -s) for lang, found in by_lang.items() for i, (s, a, p, x, y) in enumerate(sorted(found)[:top])}


@pytest.fixture
def spoken(spark):
    def make(rows):
        return spark.createDataFrame(rows, "lang string, text string").selectExpr("*", "1 as k", "'x' as phrase", "2 as f", "3 as `a.b`", "4 as n")
    return make


def prose(seed, n, words):
    rnd = random.Random(seed)
    return " ".join(rnd.choices(words, weights=range(len(words), 0, -1), k=n))


@pytest.mark.parametrize("options", [{}, {"shard_bytes": 300, "range_rows": 40, "answers": 3}])
def test_brute_force(spoken, options):
    words = ["the", "The", "of", "a", "cat", "dog", "Ärger", "é", "a\x01", "a\x00b", "x.", "end,", "so\nit", "\t", "", "z" * 50, "a b"]
    rows = [(random.Random(i).choice(["en", "de", None, "und", "", "e n"]), prose(i, 60, words)) for i in range(40)]
    rows += [("en", "new york city hall is big. " * 30), ("en", "a a a a a a a"), ("de", None), ("de", ""), (None, " \t,. "), ("xx", "one"), ("en", rows[0][1]), ("en", rows[0][1])]
    for least, longest, top in ((5, 5, 2000), (2, 3, 7)):
        got = collocations.collocations(spoken(rows), least, longest, top, **options).collect()
        assert {tuple(r) for r in got} == expected(rows, least, longest, top) and len(got) == len({tuple(r) for r in got})


def test_empty(spoken):
    assert collocations.collocations(spoken([])).collect() == []
    assert collocations.collocations(spoken([("en", None), ("en", "")])).collect() == []


def test_a_hot_pair_is_cut_by_the_bounds(spark, spoken):
    """One pair starts most sequences: its counts come together from many ranges, none of which is large."""
    rnd = random.Random(1)
    rows = [("en", " ".join(f"common pair {rnd.choice('abcdefgh')}{rnd.randrange(40)}" for _ in range(50))) for _ in range(60)]
    options = {"shard_bytes": 1000, "range_rows": 500}
    got = {tuple(r) for r in collocations.collocations(spoken(rows), 10, 4, **options).collect()}
    assert got == expected(rows, 10, 4, 2000)
    counts, bounds = collocations.phrase_counts(spoken(rows), 10, 4, **options)
    assert len(bounds) > 8 and sum(b[:3] == (b"en", b"common", b"pair") for b in bounds) > 2
    assert {r.f for r in counts.where("phrase = 'common pair'").collect()} == {3000}


def test_automaton_and_walk():
    rnd = np.random.default_rng(2)
    rows = rnd.integers(-1, 4, (300, 4)).astype(np.int32)
    for j in range(1, 4):
        rows[rows[:, j - 1] < 0, j] = -1
    rows = rows[rows[:, 0] >= 0]
    weights = rnd.integers(1, 9, len(rows))
    automaton = collocations.Automaton(*collocations.sorted_distinct(rows, weights, 4))
    depths, at = automaton.walk(rows, 4)
    for i, row in enumerate(rows.tolist()):
        path = [x for x in row if x >= 0]
        assert depths[i] == len(path) - 1
        assert automaton.weight[depths[i]][at[i]] == sum(w for r, w in zip(rows.tolist(), weights) if r[:len(path)] == path)
    missing = np.array([[3, 3, 3, -1], [4, -1, -1, -1]], dtype=np.int32)
    assert automaton.walk(missing[1:], 5)[1].tolist() == [-1]


def test_packing_of_large_vocabularies():
    rows = np.array([[5, 2_000_000, -1], [5, 3, 7], [5, 3, 7], [-1, -1, -1]], dtype=np.int32)
    got, weights = collocations.sorted_distinct(rows, np.array([1, 2, 3, 4]), 2 ** 31 - 2)
    assert got.tolist() == [[-1, -1, -1], [5, 3, 7], [5, 2_000_000, -1]] and weights.tolist() == [4, 5, 1]
