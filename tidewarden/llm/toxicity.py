"""Toxicity by compression distance.

One zstandard dictionary is trained, on windows of ordinary text. The toxic content beside it is not trained
but a word list, a substitute: the words far more frequent in toxic documents, of any length and number. A
dictionary trained on windows of toxic documents mostly holds what both classes share and does not separate
them (figures in the README). Every window of a text is compressed with the ordinary dictionary, padded with
more ordinary text, and with the ordinary plus the toxic content; the bytes saved by the latter are the distance. A logistic fit on the window distances of a document
(largest, mean of the largest two and four, shares above thresholds, number of windows) calibrates the score.

The fit uses at most ``per_class`` labelled documents of each class. Null and empty texts have one empty
window and get a score like any text without a toxic window. Rows that repeat are scored each. Labels,
language, source and id never enter a score. Without labelled rows of both classes the score is the base rate.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, functions as F

from tidewarden.llm.common import own_columns
from tidewarden.llm.learning import fit_logistic, labelled_sample, predict_logistic

WINDOW_WORDS, LEVEL = 16, 6


def windows(text: str | None) -> list[bytes]:
    """Runs of whole words that cover the text, in lower case."""
    w = (text or "").lower().split()
    return [" ".join(w[i:i + WINDOW_WORDS]).encode("utf-8", "replace") for i in range(0, len(w), WINDOW_WORDS)] or [b""]


def train_dictionary(samples: list[bytes], size: int) -> bytes:
    """Content of a trained dictionary; of the samples themselves where they are too few to train on."""
    try:
        return zstandard.train_dictionary(size, samples).as_bytes()
    except (zstandard.ZstdError, ValueError):
        return b" ".join(samples)[-size:]


class Distance:
    """Bytes that the toxic content saves, window by window."""

    def __init__(self, ordinary: bytes, toxic: bytes):
        # equal lengths, so that offsets cost the same
        self.pair = (ordinary + ordinary[:len(toxic)].ljust(len(toxic), b" "), ordinary + toxic)
        self.coders = None

    def __getstate__(self):
        return {"pair": self.pair, "coders": None}

    def of(self, text: str | None) -> np.ndarray:
        if self.coders is None:
            setup = zstandard.ZstdCompressionParameters.from_level(LEVEL, source_size=64, dict_size=len(self.pair[1]), write_content_size=0)
            self.coders = [zstandard.ZstdCompressor(compression_params=setup, dict_data=zstandard.ZstdCompressionDict(
                content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)) for content in self.pair]
        plain, toxic = (c.compress for c in self.coders)
        return np.array([len(plain(w)) - len(toxic(w)) for w in windows(text)], dtype=float)


def features(distance: Distance, texts) -> np.ndarray:
    out = []
    for text in texts:
        d = np.sort(distance.of(text))[::-1]
        out.append([d[0], d[:2].mean(), d[:4].mean(), *[(d >= t).sum() for t in (3, 5, 7)], *[(d >= t).mean() for t in (3, 5)], np.log(len(d))])
    return np.array(out).reshape(-1, 9)


def distinctive_words(sample: DataFrame, least: float = 10.0) -> list[str]:
    """Words whose document frequency in toxic rows is ``least`` standard errors above that in ordinary ones."""
    n = {r.y: r["count"] for r in sample.groupBy("y").count().collect()}
    if len(n) < 2:
        return []
    seen = sample.select("y", F.explode(F.array_distinct(F.split(F.regexp_replace(F.lower("text"), r"[^\p{L}\p{M}\p{N}]+", " "), " "))).alias("word"))
    by_word = seen.where("word <> ''").groupBy("word").agg(F.sum("y").alias("t"), F.sum(1 - F.col("y")).alias("o"))
    share = (F.col("t") + F.col("o")) / (n[0] + n[1])
    z = (F.col("t") / n[1] - F.col("o") / n[0]) / F.sqrt(share * (1 - share) * (1 / n[0] + 1 / n[1]) + 1e-12)
    least = least * min(1.0, np.sqrt(n[0] * n[1] / (n[0] + n[1]) / 400))  # evidence that small samples can give
    rows = by_word.where(F.col("t") >= 3).select("word", "t", z.alias("z")).where(F.col("z") > max(least, 2.5)).orderBy(F.desc("z"), "word")
    return [r.word for r in rows.collect()]


class Model:
    def __init__(self, distance: Distance, weights: dict):
        self.distance, self.weights = distance, weights

    def score(self, texts) -> np.ndarray:
        return predict_logistic(self.weights, features(self.distance, texts))


def train(docs: DataFrame, labels: DataFrame, learn, label: str = "toxic", per_class: int = 3000, dictionary: int = 110_000,
          sample_windows: int = 20_000, **names: str) -> Model:
    sample = labelled_sample(docs, labels, label, learn, per_class, **names)
    # the rarest of the distinctive words first: nearer content is cheaper to refer to
    words = distinctive_words(sample)[::-1]

    def cut(batches):
        for b in batches:
            yield pd.DataFrame({"w": [w for t in b["text"] for w in windows(t)]})

    pieces = sample.where("y = 0").mapInPandas(cut, "w binary").orderBy(F.xxhash64("w"), "w").limit(sample_windows).collect()
    distance = Distance(train_dictionary([bytes(r.w) for r in pieces], dictionary), (" " + " ".join(words) + " ").encode())

    def measure(batches):
        for b in batches:
            yield pd.DataFrame({"y": b["y"], "x": list(features(distance, b["text"]))})

    rows = sample.mapInPandas(measure, "y int, x array<double>").collect()
    x, y = np.array([r.x for r in rows]).reshape(-1, 9), np.array([r.y for r in rows], dtype=float)
    return Model(distance, fit_logistic(x, y))


def scores(docs: DataFrame, model: Model, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, score) of every row."""
    body = own_columns(docs, doc_id=doc_id, text=text)

    def run(batches):
        for b in batches:
            scores = model.score(b.column("text").to_pylist())
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(scores, pa.float64())], ["doc_id", "score"])

    return body.mapInArrow(run, f"doc_id {body.schema['doc_id'].dataType.simpleString()}, score double")
