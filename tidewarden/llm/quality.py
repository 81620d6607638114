"""Quality by attention-based multiple-instance learning.

A document is a bag of passages of ``PASSAGE_WORDS`` words that cover it. Every passage is encoded by
character classes, word shapes and repetition, then by a learned layer. Gated attention weights the
passages (tanh times sigmoid, softmax over the bag), and the weighted representation gives the score.
All weights are learned from document labels alone, on at most ``per_class`` documents of each class.

Null and empty texts are a bag of one empty passage. Rows that repeat are scored each. Labels, language,
source and id never enter a score. Without labelled rows of both classes the score is the base rate.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame

from tidewarden.llm.common import own_columns
from tidewarden.llm.learning import labelled_sample

PASSAGE_WORDS, MAX_BAG_AT_ONCE = 50, 4096
CLASSES = 9


def class_table() -> np.ndarray:
    """Character class of every code point of the two lowest planes; those above are letters."""
    table = np.full(0x20000, 8, dtype=np.int64)
    for code in range(0x20000):
        c = chr(code)
        if c.isspace():
            table[code] = 0
        elif c.isupper():
            table[code] = 2
        elif c.isalpha():
            table[code] = 1
        elif c.isdigit():
            table[code] = 3
        elif c in ".,;:'":
            table[code] = 4
        elif c == "!" or c == "?":
            table[code] = 5
        elif c in "|\t<>{}[]()/\\=":
            table[code] = 6
        elif code < 128:
            table[code] = 7
    return table


_TABLE: list[np.ndarray] = []


def passages(text: str | None) -> np.ndarray:
    """One row of features per passage."""
    if not _TABLE:
        _TABLE.append(class_table())
    words = (text or "").split()
    rows, seen = [], set()
    for i in range(0, max(1, len(words)), PASSAGE_WORDS):
        part = words[i:i + PASSAGE_WORDS]
        joined = " ".join(part)
        codes = np.frombuffer(joined.encode("utf-32-le", "replace"), dtype=np.uint32)
        kinds = np.bincount(_TABLE[0][np.minimum(codes, 0x1FFFF)], minlength=CLASSES) / max(1, len(codes))
        n = len(part)
        runs = [hash((part[j], part[j + 1], part[j + 2])) for j in range(n - 2)]
        again = sum(r in seen for r in runs)
        seen.update(runs)
        lengths = np.fromiter(map(len, part), dtype=float, count=n) if n else np.zeros(1)
        odd = sum(not w[-1].isalnum() for w in part)
        rows.append([*kinds, again / max(1, n - 2), len(set(part)) / max(1, n), len(set(runs)) / max(1, len(runs)), odd / max(1, n),
                     sum(w.isupper() for w in part) / max(1, n), min(lengths.mean(), 30) / 10, min(lengths.std(), 30) / 10,
                     (lengths <= 3).sum() / max(1, n), n / PASSAGE_WORDS])
    return np.array(rows)


WIDTH = CLASSES + 9


def _sums(values: np.ndarray, starts: np.ndarray) -> np.ndarray:
    return np.add.reduceat(values, starts, axis=0)


class Model:
    """mean, scale and parameters: E, e (encoder), V, U, a (attention), c, d (output); or only a rate."""

    def __init__(self, parts: dict, rate: float = 0.0):
        self.p, self.rate = parts, rate

    def forward(self, x: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> dict:
        p = self.p
        z = (x - p["mean"]) / p["scale"]
        h = np.tanh(z @ p["E"] + p["e"])
        t, g = np.tanh(h @ p["V"]), 1 / (1 + np.exp(-h @ p["U"]))
        s = (t * g) @ p["a"]
        top = np.maximum.reduceat(s, starts)
        w = np.exp(s - np.repeat(top, sizes))
        w = w / np.repeat(_sums(w, starts), sizes)
        bag = _sums(h * w[:, None], starts)
        logit = np.clip(bag @ p["c"] + p["d"], -30, 30)
        return {"z": z, "h": h, "t": t, "g": g, "w": w, "bag": bag, "score": 1 / (1 + np.exp(-logit))}

    def score(self, texts) -> np.ndarray:
        texts = list(texts)
        if self.p is None:
            return np.full(len(texts), self.rate)
        out = np.empty(len(texts))
        for i in range(0, len(texts), 256):
            bags = [passages(t if isinstance(t, str) else None) for t in texts[i:i + 256]]
            sizes = np.array([len(b) for b in bags])
            out[i:i + 256] = self.forward(np.concatenate(bags), np.r_[0, np.cumsum(sizes)[:-1]], sizes)["score"]
        return out


def fit(bags: list[np.ndarray], y: np.ndarray, hidden: int = 16, gate: int = 8, epochs: int = 60, batch: int = 128,
        rate: float = 0.01, l2: float = 1e-4, seed: int = 3) -> Model:
    """Adam on the logistic loss of the documents."""
    if len(y) == 0 or y.min() == y.max():
        return Model(None, float(y.mean()) if len(y) else 0.0)
    every = np.concatenate(bags)
    rnd = np.random.default_rng(seed)
    p = {"mean": every.mean(0), "scale": every.std(0) + 1e-6, "E": rnd.normal(0, WIDTH ** -0.5, (WIDTH, hidden)), "e": np.zeros(hidden),
         "V": rnd.normal(0, hidden ** -0.5, (hidden, gate)), "U": rnd.normal(0, hidden ** -0.5, (hidden, gate)),
         "a": rnd.normal(0, gate ** -0.5, gate), "c": rnd.normal(0, hidden ** -0.5, hidden), "d": 0.0}
    model, names = Model(p), ("E", "e", "V", "U", "a", "c", "d")
    m, v, step = {k: 0.0 for k in names}, {k: 0.0 for k in names}, 0
    for _ in range(epochs):
        order = rnd.permutation(len(y))
        for i in range(0, len(y), batch):
            pick = order[i:i + batch]
            sizes = np.array([len(bags[j]) for j in pick])
            starts = np.r_[0, np.cumsum(sizes)[:-1]]
            f = model.forward(np.concatenate([bags[j] for j in pick]), starts, sizes)
            err = (f["score"] - y[pick]) / len(pick)
            grad = {"c": f["bag"].T @ err, "d": err.sum()}
            d_bag = np.repeat(err[:, None] * p["c"], sizes, axis=0)
            d_h = d_bag * f["w"][:, None]
            d_w = (d_bag * f["h"]).sum(1)
            d_s = f["w"] * (d_w - np.repeat(_sums(f["w"] * d_w, starts), sizes))
            grad["a"] = (f["t"] * f["g"]).T @ d_s
            d_tg = d_s[:, None] * p["a"]
            d_t, d_g = d_tg * f["g"] * (1 - f["t"] ** 2), d_tg * f["t"] * f["g"] * (1 - f["g"])
            grad["V"], grad["U"] = f["h"].T @ d_t, f["h"].T @ d_g
            d_z = (d_h + d_t @ p["V"].T + d_g @ p["U"].T) * (1 - f["h"] ** 2)
            grad["E"], grad["e"] = f["z"].T @ d_z, d_z.sum(0)
            step += 1
            for k in names:
                g = grad[k] + l2 * p[k]
                m[k], v[k] = 0.9 * m[k] + 0.1 * g, 0.999 * v[k] + 0.001 * g * g
                p[k] = p[k] - rate * (m[k] / (1 - 0.9 ** step)) / (np.sqrt(v[k] / (1 - 0.999 ** step)) + 1e-8)
    return model


def train(docs: DataFrame, labels: DataFrame, learn, label: str = "quality", per_class: int = 2500, **names: str) -> Model:
    sample = labelled_sample(docs, labels, label, learn, per_class, **names)

    def encode(batches):
        for b in batches:
            yield pd.DataFrame({"doc_id": b["doc_id"], "y": b["y"], "x": [passages(t).ravel() for t in b["text"]]})

    rows = sample.mapInPandas(encode, f"doc_id {sample.schema['doc_id'].dataType.simpleString()}, y int, x array<double>").orderBy("doc_id").collect()
    return fit([np.array(r.x).reshape(-1, WIDTH) for r in rows], np.array([r.y for r in rows], dtype=float))


def scores(docs: DataFrame, model: Model, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, score) of every row."""
    body = own_columns(docs, doc_id=doc_id, text=text)

    def run(batches):
        for b in batches:
            scores = model.score(b.column("text").to_pylist())
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(scores, pa.float64())], ["doc_id", "score"])

    return body.mapInArrow(run, f"doc_id {body.schema['doc_id'].dataType.simpleString()}, score double")
