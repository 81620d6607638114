"""Language identification by words first, with backoff to character n-grams.

A word that was learned scores its log frequency in every language. A word that was not is scored by
its character n-grams of the longest length of which at least one was learned, from ``longest`` down to
one. The language with the highest mean over the words of the text wins; equal means go to the first by name.

Words are counted by Spark over at most ``per_lang`` documents of each language. The tables hold all of them,
however many languages there are, and all of their n-grams; they grow with the vocabulary of the sample. A word is a run of letters and marks, in lower case. Texts that are null or
have no letter are ``und`` with score 0. The score is the softmax of the means. Rows that repeat are
judged each; language, source and id never enter a prediction. Without learned languages all is ``und``.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame, Window, functions as F

from tidewarden.llm.common import own_columns, staged

LETTERS = regex.compile(r"[\p{L}\p{M}]+")
HAS_LETTER = regex.compile(r"\p{L}")


class Shares:
    """Log shares of keys in every language; only counts that are not zero are held."""

    def __init__(self, chunks: Iterable[pa.Table], n_langs: int):
        """From (key, place, n) rows, summed chunk by chunk."""
        rows = self.summed(pa.concat_tables([self.summed(c) for c in chunks])).sort_by([("key", "ascending"), ("place", "ascending")])
        self.place, n = rows["place"].to_numpy().astype(np.intp), rows["n"].to_numpy().astype(np.int64)
        runs = pc.run_end_encode(rows["key"].combine_chunks())
        self.ends = np.r_[0, runs.run_ends.to_numpy()].astype(np.int64)
        self.at = {key: i for i, key in enumerate(runs.values.to_pylist())}
        total = np.bincount(self.place, weights=n, minlength=n_langs) + len(self.at) * 0.5
        log_total = np.log(np.maximum(total, 0.5))
        self.unseen, self.logs = np.log(0.5) - log_total, np.log(n + 0.5) - log_total[self.place]

    @staticmethod
    def summed(rows: pa.Table) -> pa.Table:
        return rows.group_by(["key", "place"]).aggregate([("n", "sum")]).rename_columns(["key", "place", "n"])

    def __contains__(self, key: str) -> bool:
        return key in self.at

    def get(self, key: str) -> np.ndarray | None:
        found = self.at.get(key)
        if found is None:
            return None
        low, high = self.ends[found], self.ends[found + 1]
        value = self.unseen.copy()
        value[self.place[low:high]] = self.logs[low:high]
        return value

    __getitem__ = get


class Model:
    def __init__(self, counts: list[tuple[str, str, int]] | pa.Table, longest: int = 5):
        """From (language, word, count) rows."""
        if not isinstance(counts, pa.Table):
            counts = pa.table([pa.array([row[i] for row in counts], t) for i, t in enumerate((pa.string(), pa.string(), pa.int64()))], ["lang", "word", "count"])
        self.langs = sorted(pc.unique(counts["lang"]).to_pylist())
        self.longest = longest
        place = pc.index_in(counts["lang"], pa.array(self.langs, pa.string()))
        rows = pa.table([counts["word"], place, counts["count"]], ["key", "place", "n"])
        self.words = Shares([rows], len(self.langs))
        self.parts = [Shares(self.all_pieces(rows, k), len(self.langs)) for k in range(1, longest + 1)]

    def all_pieces(self, rows: pa.Table, k: int, step: int = 20_000) -> Iterator[pa.Table]:
        """The n-grams of the words, some words at a time."""
        for start in range(0, max(1, len(rows)), step):
            part = rows.slice(start, step)
            grams = [self.pieces(word, k) for word in part["key"].to_pylist()]
            source = np.repeat(np.arange(len(grams)), [len(g) for g in grams])
            yield pa.table([pa.array([g for found in grams for g in found], pa.string()), part["place"].to_numpy()[source],
                            part["n"].to_numpy()[source]], ["key", "place", "n"])

    @staticmethod
    def pieces(word: str, k: int) -> list[str]:
        marked = f"<{word}>" if k > 1 else word
        return [marked[i:i + k] for i in range(len(marked) - k + 1)]

    def word_score(self, word: str) -> np.ndarray:
        known = self.words.get(word)
        if known is not None:
            return known
        for k in range(self.longest, 0, -1):
            found = [v for v in map(self.parts[k - 1].get, self.pieces(word, k)) if v is not None]
            if found:
                return sum(found) / len(found)
        return np.zeros(len(self.langs))

    def predict(self, texts) -> tuple[list[str], list[float]]:
        memo: dict[str, np.ndarray] = {}
        langs, scores = [], []
        for text in texts:
            if not isinstance(text, str) or not self.langs or not HAS_LETTER.search(text):
                langs.append("und")
                scores.append(0.0)
                continue
            total, n = np.zeros(len(self.langs)), 0
            for word, times in Counter(LETTERS.findall(text.lower())).items():
                if len(memo) > 200_000:
                    memo.clear()
                value = memo.get(word)
                if value is None:
                    value = memo[word] = self.word_score(word)
                total += value * times
                n += times
            mean = total / max(n, 1)
            share = np.exp(mean - mean.max())
            best = int(np.argmax(mean))
            langs.append(self.langs[best])
            scores.append(float(share[best] / share.sum()))
        return langs, scores


def train(docs: DataFrame, learn, per_lang: int = 2000, doc_id: str = "doc_id", text: str = "text", lang: str = "lang") -> Model:
    body = own_columns(docs, doc_id=doc_id, text=text, lang=lang).where("text is not null and lang is not null and doc_id is not null")
    body = body.where(learn(F.col("doc_id")))
    # a threshold on the id hash leaves somewhat over per_lang documents of each language ...
    share = 1.5 * per_lang / F.col("count")
    cut = F.when(share < 1, (-2.0 ** 63 + share * 2.0 ** 64).cast("long")).otherwise(2 ** 63 - 1)
    cuts = staged(body.groupBy("lang").count().select("lang", cut.alias("cut")))
    # one row of two columns per language
    near = body.select("doc_id", "lang").join(F.broadcast(cuts), "lang").where(F.xxhash64("doc_id") <= F.col("cut")).select("doc_id", "lang").distinct()
    # ... of which the first are taken
    order = Window.partitionBy("lang").orderBy(F.xxhash64("doc_id"), "doc_id")
    ids = staged(near.withColumn("n", F.row_number().over(order)).where(F.col("n") <= per_lang).drop("n"))
    sample = body.join(F.broadcast(ids), ["doc_id", "lang"])  # at most per_lang ids of each language
    seen = sample.select("lang", F.explode(F.split(F.lower("text"), r"[^\p{L}\p{M}]+")).alias("word")).where("word <> ''")
    counts = seen.groupBy("lang", "word").count().toArrow()
    return Model(counts)


def predictions(docs: DataFrame, model: Model, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, lang_pred, score) of every row."""
    body = own_columns(docs, doc_id=doc_id, text=text)

    def run(batches):
        for b in batches:
            langs, scores = model.predict(b.column("text").to_pylist())
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(langs, pa.string()), pa.array(scores, pa.float64())], ["doc_id", "lang_pred", "score"])

    return body.mapInArrow(run, f"doc_id {body.schema['doc_id'].dataType.simpleString()}, lang_pred string, score double")
