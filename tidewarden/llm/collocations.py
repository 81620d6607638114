"""Phrase collocations from weighted acyclic automata.

Every word starts one sequence: its language, the word, and up to four words that follow it in its piece. A
shard of text sorts its sequences and builds an automaton from them incrementally: a sequence shares the states
of the one before it as far as both agree and opens new ones from there on; the weight of a state is the
number of sequences through it, so it is the count of its phrase, at any length. Shards are cut at the same
range bounds, and each range of prefixes is united on its own, weights of equal sequences summed. A range may
begin or end inside a prefix, however common that prefix is: the few states on the path of a bound are partial
and summed afterwards. Parts of a phrase are looked up by composition: the sorted questions to a range and the
range's automaton are walked together, level by level.

Count of the parts, score, and what is dropped are as in ``collocations``. A-Z is lower-cased, pieces end at
``.,;:!?`` and line ends, words at spaces and tabs. A null text has no words, a null language is ``und``. Repeated
rows count again. Extra columns are ignored, an empty table gives no rows. Texts are treated as bytes, so odd
encodings do no harm.
"""

from __future__ import annotations

import sys
from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle
from pyspark.sql import DataFrame, Window, functions as F

from tidewarden.llm.common import own_columns, staged

cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: bytes of text that are sorted as one shard
SHARD_BYTES = 8_000_000
#: sequences of a range: what one task unites
RANGE_ROWS = 1_500_000
#: questions that one copy of a range's automaton answers
ANSWERS = 200_000
#: for each range, bytes of text in the sample that bounds are chosen from
RANGE_SAMPLE = 60_000

#: piece ends become line ends, tabs become spaces
_PLAIN = bytes.maketrans(b".,;:!?\x0b\x0c\x0d\x09", b"\n\n\n\n\n\n\n\n\n ")

Key = tuple[bytes, ...]


def sorted_distinct(rows: np.ndarray, weights: np.ndarray, labels: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows in lexicographic order, equal ones once with their weights summed; -1 stands for no label."""
    if not len(rows):
        return rows, weights
    each = 63 // max(1, int(labels + 1).bit_length())
    packed = []
    for at in range(0, rows.shape[1], each):
        key = np.zeros(len(rows), dtype=np.int64)
        for j in range(at, min(at + each, rows.shape[1])):
            key = key * (labels + 1) + (rows[:, j] + 1)
        packed.append(key)
    order = np.lexsort(packed[::-1])
    new = np.zeros(len(rows), dtype=bool)
    new[0] = True
    for key in packed:
        key = key[order]
        new[1:] |= key[1:] != key[:-1]
    starts = np.flatnonzero(new)
    return rows[order[starts]], np.add.reduceat(weights[order], starts)


class Automaton:
    """States by depth. ``first``: the row that opened a state, ``parent``: its state one level up, ``weight``.

    ``keep(depth, first, weight)`` may leave states out, with all that hang on them.
    """

    def __init__(self, rows: np.ndarray, weights: np.ndarray, keep=None):
        self.rows, self.first, self.parent, self.weight = rows, [], [], []
        new = np.zeros(len(rows), dtype=bool)
        new[:1] = True
        above = np.zeros(len(rows), dtype=np.int32)
        for depth in range(rows.shape[1]):
            new[1:] |= rows[1:, depth] != rows[:-1, depth]
            first = np.flatnonzero(new)
            weight = np.add.reduceat(weights, first) if len(first) else weights[:0]
            opened = rows[first, depth] >= 0
            if keep:
                opened &= keep(depth, first, weight)
            first, weight = first[opened], weight[opened]
            self.first.append(first.astype(np.int32))
            self.parent.append(above[first])
            self.weight.append(weight)
            is_open = np.zeros(len(rows), dtype=bool)
            is_open[first] = True
            above = np.cumsum(is_open, dtype=np.int32) - 1

    def walk(self, questions: np.ndarray, labels: int) -> tuple[np.ndarray, np.ndarray]:
        """(depth, state) where each question ends; state -1 where the automaton does not know it."""
        state = np.zeros(len(questions), dtype=np.int64)
        at_depth = np.full(len(questions), -1)
        for depth in range(questions.shape[1]):
            asked = np.flatnonzero((questions[:, depth] >= 0) & (state >= 0))
            arcs = self.parent[depth].astype(np.int64) * labels + self.rows[self.first[depth], depth] if depth else self.rows[self.first[0], 0].astype(np.int64)
            wanted = (state[asked] * labels if depth else 0) + questions[asked, depth].astype(np.int64)
            place = np.searchsorted(arcs, wanted)
            known = np.zeros(len(asked), dtype=bool)
            inside = place < len(arcs)
            known[inside] = arcs[place[inside]] == wanted[inside]
            state[asked] = np.where(known, place, -1)
            at_depth[asked] = depth
        return at_depth, state


def _ranked(values: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """Distinct values in byte order, and the rank of each value."""
    coded = values.dictionary_encode()
    order = pc.sort_indices(coded.dictionary).to_numpy()
    rank = np.empty(len(order), dtype=np.int32)
    rank[order] = np.arange(len(order))
    return coded.dictionary.take(pa.array(order)), rank[coded.indices.to_numpy()]


def _packed(batch: dict) -> bytes:
    batch = pa.record_batch(batch)
    out = pa.BufferOutputStream()
    with pa.ipc.new_stream(out, batch.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as writer:
        writer.write_batch(batch)
    return out.getvalue().to_pybytes()


def _unpacked(blob) -> pa.Table:
    return pa.ipc.open_stream(pa.py_buffer(blob)).read_all()


def _segment(words: pa.Array, rows: np.ndarray, weights: np.ndarray) -> tuple[bytes, bytes]:
    """Words in use and the sequences in terms of them: frequent words have small numbers, high and low bytes lie apart."""
    often = np.zeros(len(words), dtype=np.int64)
    for j in range(rows.shape[1]):
        column = rows[:, j]
        often += np.bincount(column[column >= 0], minlength=len(words))
    used = np.flatnonzero(often)
    used = used[np.argsort(-often[used], kind="stable")]
    number = np.zeros(len(words) + 1, dtype=np.uint32)  # -1 reads the 0 at the end
    number[used] = np.arange(1, len(used) + 1)
    columns = {}
    for j in range(rows.shape[1]):
        local = number[rows[:, j]]
        for byte in range(max(1, (len(used).bit_length() + 7) // 8)):
            columns[f"{j} {byte}"] = pa.array((local >> np.uint32(8 * byte)).astype(np.uint8))
    columns["n"] = pa.array(weights.astype(np.uint8) if weights.max() < 256 else weights)
    return _packed({"word": words.take(pa.array(used))}), _packed(columns)


def _opened(words: bytes, rows: bytes) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    table, found = _unpacked(rows), _unpacked(words).column("word").combine_chunks()
    matrix = np.zeros((table.num_rows, 1 + max(int(c.split()[0]) for c in table.column_names if c != "n")), dtype=np.int32)
    for name in table.column_names[:-1]:
        j, byte = map(int, name.split())
        matrix[:, j] += table.column(name).to_numpy().astype(np.int32) << 8 * byte
    matrix -= 1
    return found, matrix, table.column("n").to_numpy().astype(np.int64)


def sequences(texts: list[tuple[bytes, bytes]], longest: int) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """(words, rows, weights) of (language, text) pairs: sorted distinct sequences."""
    plain = [text.lower().translate(_PLAIN) for _, text in texts]
    lines = np.array([p.count(b"\n") + 1 for p in plain])
    joined = b"\n".join(plain).replace(b"\n", b" \n ")
    tokens = pc.split_pattern(pa.array([joined], pa.large_binary()), b" ").flatten()
    tokens = tokens.filter(pc.greater(pc.binary_length(tokens), 0)).cast(pa.binary() if len(joined) < 2 ** 31 else pa.large_binary())
    langs = pa.array([lang for lang, _ in texts], tokens.type)
    words, rank = _ranked(pa.concat_arrays([tokens, langs]))
    ids, of_text = rank[:len(tokens)], rank[len(tokens):]
    stop = pc.equal(tokens, pa.scalar(b"\n", tokens.type)).to_numpy(zero_copy_only=False)
    rows = np.full((len(ids), longest + 1), -1, dtype=np.int32)
    rows[:, 0] = np.repeat(of_text, lines)[np.cumsum(stop)]
    alive = ~stop
    for j in range(longest):
        if j:
            alive[:len(ids) - j] &= ~stop[j:]
            alive[max(0, len(ids) - j):] = False
        here = np.flatnonzero(alive)
        rows[here, 1 + j] = ids[here + j]
    rows = rows[~stop]
    return words, *sorted_distinct(rows, np.ones(len(rows), dtype=np.int64), len(words))


def _sampled(longest: int, every: int):
    """Keys of every so-manieth sequence of a sample of texts."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = list(zip(batch.column("lang").to_pylist(), batch.column("text").to_pylist()))
            words, rows, _ = sequences(texts, longest)
            keys = [[words[i].as_py() for i in r if i >= 0] for r in rows[every // 2::every].tolist()]
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.list_(pa.binary()))], ["key"])
    return run


def range_bounds(body: DataFrame, longest: int, range_rows: int) -> list[Key]:
    """Keys that cut all sequences into ranges of about ``range_rows``; a bounded number of keys for each range.

    They come from a sample of the texts and only balance the work: any bounds give the same counts.
    """
    size = body.agg(F.sum(F.length("text"))).first()[0] or 0
    ranges = int(size // (6 * range_rows)) + 1  # a word and what parts it take about six bytes
    if ranges == 1:
        return []
    sample = body.where(F.rand(12) < RANGE_SAMPLE * ranges / size)
    found = sorted(tuple(bytes(w) for w in r.key) for r in sample.mapInArrow(_sampled(longest, RANGE_SAMPLE // 300), "key array<binary>").collect())
    return sorted({found[len(found) * i // ranges] for i in range(1, ranges)}) if found else []


def _cut(bounds: list[Key], longest: int, shard_bytes: int):
    """Each shard of text sorted and cut at the bounds: a row for every range it has sequences of."""
    def flush(texts):
        words, rows, weights = sequences(texts, longest)
        known: dict[int, bytes] = {}

        def key(r):
            return tuple(known.get(i) or known.setdefault(i, words[i].as_py()) for i in rows[r].tolist() if i >= 0)

        ends, low = [], 0
        for bound in bounds:
            low = bisect_left(range(len(rows)), bound, low, key=key)
            ends.append(low)
        for n, (a, b) in enumerate(zip([0, *ends], [*ends, len(rows)])):
            if a < b:
                w, r = _segment(words, rows[a:b], weights[a:b])
                yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64()), pa.array([w]), pa.array([r])], ["range", "words", "rows"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            for lang, text in zip(batch.column("lang"), batch.column("text")):
                text = text.as_py()
                held.append((lang.as_py(), text))
                size += len(text)
                if size >= shard_bytes:
                    yield from flush(held)
                    held, size = [], 0
        if held:
            yield from flush(held)
    return run


def _unite(bounds: list[Key], least: int):
    """(lang, phrase, k, f, partial) of one range: states of weight ``least`` and more, languages, and partial states."""
    def run(table: pa.Table) -> pa.Table:
        number = table.column("range")[0].as_py()
        parts = [_opened(w.as_py(), r.as_py()) for w, r in zip(table.column("words"), table.column("rows"))]
        words, rank = _ranked(pa.concat_arrays([p[0] for p in parts]))
        weights = np.concatenate([p[2] for p in parts])
        rows = np.empty((len(weights), parts[0][1].shape[1]), dtype=np.int32)
        row = at = 0
        for i, (w, matrix, _) in enumerate(parts):
            rows[row:row + len(matrix)] = np.where(matrix >= 0, rank[at + np.maximum(matrix, 0)], -1)
            row, at, parts[i] = row + len(matrix), at + len(w), None
        rows, weights = sorted_distinct(rows, weights, len(words))
        # what a bound's prefixes count goes on in another range
        edges = {edge[:d] for edge in bounds[max(0, number - 1):number + 1] for d in range(1, len(edge))}
        label = {w: i for i, w in enumerate(words.to_pylist())} if edges else {}
        shared = {tuple(label[w] for w in e) for e in edges if all(w in label for w in e)}

        def keep(depth, first, weight):
            kept = weight >= (least if depth else 0)
            for e in shared:
                if len(e) == depth + 1:
                    kept |= (rows[first, :depth + 1] == np.array(e)).all(1)
            return kept

        automaton, out = Automaton(rows, weights, keep), []
        for depth, (first, weight) in enumerate(zip(automaton.first, automaton.weight)):
            for row, n in zip(rows[first, :depth + 1].tolist(), weight.tolist()):
                out.append((words[row[0]].as_py(), b" ".join(words[i].as_py() for i in row[1:]), depth, n, tuple(row) in shared))
        return pa.table([pa.array([r[i] for r in out], t) for i, t in enumerate((pa.binary(), pa.binary(), pa.int32(), pa.int64(), pa.bool_()))],
                        names=["lang", "phrase", "k", "f", "partial"])
    return run


def phrase_counts(docs: DataFrame, least: int = 100, longest: int = 5, shard_bytes: int = SHARD_BYTES, range_rows: int = RANGE_ROWS,
                  lang: str = "lang", text: str = "text") -> tuple[DataFrame, list[Key]]:
    """((lang, phrase, k, f), bounds): phrases of up to ``longest`` words that occur ``least`` times and more; k 0 has all words."""
    body = own_columns(docs, lang=lang, text=text).where("text is not null")
    body = body.select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).cast("binary").alias("lang"), F.col("text").cast("binary").alias("text"))
    bounds = range_bounds(body, longest, range_rows)
    cut = body.mapInArrow(_cut(bounds, longest, shard_bytes), "range long, words binary, rows binary")
    found = staged(cut.groupBy("range").applyInArrow(_unite(bounds, least), "lang binary, phrase binary, k int, f long, partial boolean"))
    key = ["lang", "phrase", "k"]
    summed = found.where("partial").groupBy(*key).agg(F.sum("f").alias("f")).where((F.col("k") == 0) | (F.col("f") >= least))
    return staged(found.where("not partial").select(*key, "f").unionByName(summed)), bounds


def _key(lang: bytes, phrase: bytes) -> Key:
    return (lang, *phrase.split(b" "))


def _asked(bounds: list[Key]):
    """The parts of every phrase: which range to ask, and who asks."""
    def run(batches):
        for batch in batches:
            asked = set()
            for lang, phrase in zip(batch.column("lang").to_pylist(), batch.column("phrase").to_pylist()):
                words, asker = phrase.split(b" "), bisect_right(bounds, _key(lang, phrase))
                for cut in range(1, len(words)):
                    for part in (words[:cut], words[cut:]):
                        asked.add((bisect_right(bounds, (lang, *part)), lang, b" ".join(part), asker))
            home, lang, part, asker = zip(*asked) if asked else ((),) * 4
            yield pa.RecordBatch.from_arrays([pa.array(home, pa.int64()), pa.array(lang, pa.binary()), pa.array(part, pa.binary()), pa.array(asker, pa.int64())],
                                             ["home", "lang", "part", "asker"])
    return run


def _with_home(bounds: list[Key]):
    def run(batches):
        for b in batches:
            home = [bisect_right(bounds, _key(x, y)) for x, y in zip(b.column("lang").to_pylist(), b.column("phrase").to_pylist())]
            yield pa.RecordBatch.from_arrays([pa.array(home, pa.int64()), *b.columns], ["home", *b.schema.names])
    return run


def _compose(longest: int):
    """(asker, lang, part, f): questions to a range walked together with its automaton."""
    def matrix(langs, phrases, words):
        split = [_key(x, y) for x, y in zip(langs, phrases)]
        rows = np.full((len(split), longest + 1), -1, dtype=np.int32)
        for i, key in enumerate(split):
            for j, w in enumerate(key):
                rows[i, j] = words.setdefault(w, len(words))
        return rows

    def run(states: pa.Table, questions: pa.Table) -> pa.Table:
        words: dict[bytes, int] = {}
        rows = matrix(states.column("lang").to_pylist(), states.column("phrase").to_pylist(), words)
        asked = matrix(questions.column("lang").to_pylist(), questions.column("part").to_pylist(), words)
        order = np.lexsort(rows.T[::-1])
        rows, f = rows[order], states.column("f").to_numpy()[order]
        automaton = Automaton(rows, f)
        depths, at = automaton.walk(rows, len(words))
        final = [np.zeros(len(first), dtype=np.int64) for first in automaton.first]
        for depth in range(longest + 1):
            here = depths == depth
            final[depth][at[here]] = f[here]
        depths, at = automaton.walk(asked, len(words))
        known = np.flatnonzero(at >= 0)
        count = np.zeros(len(asked), dtype=np.int64)
        for depth in range(longest + 1):
            here = known[depths[known] == depth]
            count[here] = final[depth][at[here]]
        return pa.table([questions.column("asker"), questions.column("lang"), questions.column("part"), pa.array(count)],
                        names=["asker", "lang", "part", "f"])
    return run


def _score(totals: dict[bytes, int]):
    """Phrases with their lowest cut, and phrases that a longer one with the same count covers (score null)."""
    def run(states: pa.Table, answers: pa.Table) -> pa.Table:
        f = {(x, y): n for x, y, n in zip(answers.column("lang").to_pylist(), answers.column("part").to_pylist(), answers.column("f").to_pylist())}
        out, covered = [], set()
        for lang, phrase, a in zip(states.column("lang").to_pylist(), states.column("phrase").to_pylist(), states.column("f").to_pylist()):
            words, n, best = phrase.split(b" "), totals[lang], None
            for cut in range(1, len(words)):
                parts = b" ".join(words[:cut]), b" ".join(words[cut:])
                left, right = f[lang, parts[0]], f[lang, parts[1]]
                score = 1000 * a * n // (left * right)
                if best is None or score < best[3]:
                    best = (a, left, right, score)
                # one word less at either end; 100 * f(longer) >= 100 * f(shorter) can only hold with equality
                if cut == len(words) - 1 and left == a and cut > 1:
                    covered.add((lang, parts[0]))
                if cut == 1 and right == a and len(words) > 2:
                    covered.add((lang, parts[1]))
            out.append((lang, phrase, *best))
        out += [(*c, None, None, None, None) for c in covered]
        kinds = (pa.binary(), pa.binary(), *[pa.int64()] * 4)
        return pa.table([pa.array([r[i] for r in out], t) for i, t in enumerate(kinds)], names=["lang", "phrase", "a", "l", "r", "score"])
    return run


def collocations(docs: DataFrame, least: int = 100, longest: int = 5, top: int = 2000, answers: int = ANSWERS, **options) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): each language's ``top`` phrases of two and more words.

    a, l and r are the counts of the phrase and of its two parts at the cut with the lowest score, the first of
    equals; n is the number of words of the language; score is floor(1000 a n / (l r)), computed on integers of
    any size. A phrase is dropped if a longer one that contains it occurs as often. It is enough to look at phrases
    longer by one word: those in between occur at most as often as the shorter and at least as often as the longer.
    """
    counts, bounds = phrase_counts(docs, least, longest, **options)
    totals = {bytes(r.lang): r.f for r in counts.where("k = 0").collect()}  # a row for each language
    states = staged(counts.where("k > 0").mapInArrow(_with_home(bounds), "home long, lang binary, phrase binary, k int, f long"))
    phrases = states.where("k > 1")
    asked = staged(phrases.select("lang", "phrase").mapInArrow(_asked(bounds), "home long, lang binary, part binary, asker long").distinct())
    # a range that many ask has several copies of its automaton, and those who ask are dealt out to them
    copies = asked.groupBy("home").agg(F.floor(F.count(F.lit(1)) / answers).alias("last"))
    questions = asked.join(copies, "home").withColumn("copy", F.pmod(F.xxhash64("asker"), F.col("last") + 1))
    answering = states.join(copies, "home").withColumn("copy", F.explode(F.sequence(F.lit(0).cast("long"), "last")))
    answered = (answering.select("home", "copy", "lang", "phrase", "f").groupBy("home", "copy")
                .cogroup(questions.select("home", "copy", "lang", "part", "asker").groupBy("home", "copy"))
                .applyInArrow(_compose(longest), "asker long, lang binary, part binary, f long"))
    judged = staged(phrases.select("home", "lang", "phrase", "f").groupBy("home")
                    .cogroup(answered.groupBy("asker")).applyInArrow(_score(totals), "lang binary, phrase binary, a long, l long, r long, score long"))
    kept = judged.where("score is not null").join(judged.where("score is null").select("lang", "phrase"), ["lang", "phrase"], "left_anti")
    # sizes of languages: as many rows as there are languages
    spark = docs.sparkSession
    sizes = spark.createDataFrame([(k, v) for k, v in totals.items()], "lang binary, n long")
    best = Window.partitionBy("lang").orderBy(F.col("score").desc(), F.col("a").desc(), "phrase")
    ranked = kept.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= top)
    return ranked.join(F.broadcast(sizes), "lang").select(
        F.col("lang").cast("string").alias("lang"), F.col("rank").cast("long").alias("rank"), F.col("phrase").cast("string").alias("phrase"),
        "a", "l", "r", "n", "score")
