"""Bounded samples of labelled rows and a logistic fit."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, functions as F

from tidewarden.llm.common import own_columns, staged


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, learn, per_class: int, doc_id: str = "doc_id",
                    text: str = "text") -> DataFrame:
    """(doc_id, text, y) of at most ``per_class`` documents of each label, those with the smallest id hashes.

    ``learn(doc_id)`` says which rows may be learned from. Null labels and ids without a text are left out;
    of repeated ids the smallest label and text stand for all.
    """
    marked = (labels.select(F.col(doc_id).alias("doc_id"), F.col(label).cast("int").alias("y"))
              .where(F.col("y").isin(0, 1) & F.col("doc_id").isNotNull()).where(learn(F.col("doc_id"))))
    body = own_columns(docs, doc_id=doc_id, text=text).where("text is not null and doc_id is not null")
    present = marked.groupBy("doc_id").agg(F.min("y").alias("y")).join(body.select("doc_id"), "doc_id", "left_semi")
    picked = [staged(present.where(F.col("y") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(per_class)) for y in (0, 1)]
    ids = F.broadcast(picked[0].unionByName(picked[1]))  # at most twice per_class ids
    return staged(body.join(ids, "doc_id").groupBy("doc_id", "y").agg(F.min("text").alias("text")))


def fit_logistic(x: np.ndarray, y: np.ndarray, l2: float = 1e-3, steps: int = 50) -> dict:
    """Newton steps on standardised columns; with one class only the base rate."""
    n = len(y)
    if n == 0 or y.min() == y.max():
        rate = float(y.mean()) if n else 0.0
        return {"mean": 0.0, "scale": 1.0, "w": None, "b": rate}
    mean, scale = x.mean(0), x.std(0) + 1e-9
    z = np.c_[(x - mean) / scale, np.ones(n)]
    w = np.zeros(z.shape[1])
    ridge = np.diag(np.r_[np.full(z.shape[1] - 1, l2 * n), 1e-9])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        step = np.linalg.solve((z * (p * (1 - p) + 1e-9)[:, None]).T @ z + ridge, z.T @ (y - p) - ridge @ w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return {"mean": mean, "scale": scale, "w": w[:-1], "b": float(w[-1])}


def predict_logistic(model: dict, x: np.ndarray) -> np.ndarray:
    if model["w"] is None:
        return np.full(len(x), model["b"])
    return 1 / (1 + np.exp(-np.clip((x - model["mean"]) / model["scale"] @ model["w"] + model["b"], -30, 30)))
