"""Spelling variants against brute force over all pairs."""

import random
import zlib
from collections import Counter
import re

import pytest

from tidewarden.llm import variants

LOWER = str.maketrans(variants.UPPER, variants.LOWER)


def one_edit(a, b):
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return any(b[:i] + b[i + 1:] == a for i in range(len(b)))


def expected(rows, min_length, min_count, slips, ratio):
    seen = Counter()
    for i, text in rows:
        for run in re.findall(variants.RUN, text or ""):
            run = run.translate(LOWER)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if h % slips == 0:
                run = run[:h % len(run)] + run[h % len(run) + 1:]
            seen[run] += 1
    n = {w: c for w, c in seen.items() if c >= min_count and len(w) >= min_length}
    near = {w: [x for x in n if one_edit(w, x)] for w in n}
    form = {}
    for w in n:
        best = min(near[w], key=lambda x: (-n[x], x), default=None)
        form[w] = best if best is not None and n[best] >= ratio * n[w] else None
    out = set()
    for w in n:
        root = w
        while form[root] is not None:
            root = form[root]
        out.add((w, form[w], root, n[w], len(near[w]), n.get(form[w])))
    return out


@pytest.mark.parametrize("letters,length", [("ab", 6), ("aàéÿ×b", 7), ("abcdefgh", 9)])
def test_brute_force(spark, docs_of, letters, length):
    rnd = random.Random(length)
    words = ["".join(rnd.choice(letters) for _ in range(rnd.randint(5, length + 3))) for _ in range(60)]
    for w in words[:40]:
        i = rnd.randrange(len(w))
        words += [w[:i] + w[i + 1:], w[:i] + rnd.choice(letters) + w[i:], w[:i] + rnd.choice(letters) + w[i + 1:]]
    rows = [(i, " ".join(w.upper() if rnd.random() < .2 and w.isascii() else w for w in rnd.choices(words, weights=range(1, len(words) + 1), k=60))) for i in range(60)]
    rows += [(None, None), (None, ""), (61, "12 - ,"), (None, " ".join(words)), (1, rows[1][1]), (1, rows[1][1]), (62, " ".join(words * 50))]
    for slips in (199, 3):
        got = {tuple(r) for r in variants.variants(variants.word_counts(docs_of(rows), min_count=2, slips=slips), ratio=2).collect()}
        assert got == expected(rows, 6, 2, slips, 2)


def test_chains_and_ties(spark):
    n = {"aaaaaa": 5, "aaaaab": 25, "aaaabb": 125, "aaabbb": 625, "cccccc": 1, "ccccccx": 5, "ccccccy": 5, "zzzzzzz": 7}
    got = {r.word: (r.form, r.root, r.n_near, r.form_n) for r in variants.variants(spark.createDataFrame(list(n.items()), "word string, n long")).collect()}
    assert got["aaaaaa"] == ("aaaaab", "aaabbb", 1, 25) and got["aaaabb"] == ("aaabbb", "aaabbb", 2, 625)
    assert got["cccccc"] == ("ccccccx", "ccccccx", 2, 5) and got["zzzzzzz"] == (None, "zzzzzzz", 0, None)


def test_empty_tables(spark, docs_of):
    assert variants.variants(variants.word_counts(docs_of([]))).collect() == []
    assert variants.variants(variants.word_counts(docs_of([(1, None)]))).collect() == []


def test_a_shared_half_makes_few_candidates(spark):
    """Thousands of words with the same first half do not meet each other."""
    rows = [(f"prefix{a}{b}{c}{d}{e}", 5) for a in "abcdef" for b in "ghijkl" for c in "mnopqr" for d in "stuvwx" for e in "yz"]
    words = spark.createDataFrame(rows, "word string, n long")
    got = variants.near_pairs(words)
    assert got.count() == len(rows) * (4 * 5 + 1) // 2
