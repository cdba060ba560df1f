"""Bounded labelled samples and a small calibrated logistic model."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import bounded_sample, fold


def labelled_texts(docs: DataFrame, labels: DataFrame, label: str, folds: int, held_out: int, per_class: int, longest: int) -> tuple[pd.DataFrame, float]:
    """Texts of at most ``per_class`` labelled rows of either class, outside the held-out fold, of
    texts of at most ``longest`` characters: the sample that a classifier may be fitted on.

    Ids are sampled from the labels alone; only those rows' texts are fetched. A document with
    several labels counts as 0 if any is 0. Ordered by id, so fits repeat exactly. Second: by how much
    the log odds of label 1 are greater among all labelled rows than in the sample.
    """
    known = labels.where(F.col("doc_id").isNotNull() & F.col(label).isin(0, 1) & (fold(F.col("doc_id"), folds) != held_out)).groupBy("doc_id").agg(F.min(label).cast("int").alias("y"))
    ids = None
    for y in (0, 1):
        part = bounded_sample(known.where(F.col("y") == y), "doc_id", per_class)
        ids = part if ids is None else ids.union(part)
    rows = docs.select("doc_id", "text").where(F.col("text").isNotNull() & (F.length("text") <= longest))
    # At most 2 * per_class ids, each once, however often documents repeat it.
    out = rows.join(F.broadcast(ids), "doc_id").groupBy("doc_id").agg(F.min("y").alias("y"), F.min("text").alias("text")).toPandas()
    out = out.sort_values("doc_id", ignore_index=True)
    n = {r["y"]: r["n"] for r in known.groupBy("y").agg(F.count("*").alias("n")).collect()}
    y = out["y"].to_numpy()
    odds = np.log((n.get(1, 0) + 1) / (n.get(0, 0) + 1)) - np.log(((y == 1).sum() + 1) / ((y == 0).sum() + 1))
    return out, float(odds)


class Logistic:
    """Ridge logistic regression on standardised features, by Newton steps."""

    def __init__(self, x: np.ndarray, y: np.ndarray, ridge: float = 1.0):
        self.mean = x.mean(axis=0) if len(x) else np.zeros(x.shape[1])
        self.std = np.maximum(x.std(axis=0), 1e-9) if len(x) else np.ones(x.shape[1])
        z = np.c_[np.ones(len(x)), (x - self.mean) / self.std]
        self.w = np.zeros(z.shape[1])
        pen = np.full(z.shape[1], ridge)
        pen[0] = 1e-3
        for _ in range(30):
            p = 1 / (1 + np.exp(-np.clip(z @ self.w, -30, 30)))
            g = z.T @ (y - p) - pen * self.w
            h = (z * np.maximum(p * (1 - p), 1e-9)[:, None]).T @ z + np.diag(pen)
            step = np.linalg.solve(h, g)
            self.w += step
            if np.abs(step).max() < 1e-8:
                break

    def __call__(self, x: np.ndarray) -> np.ndarray:
        z = np.clip(self.w[0] + ((x - self.mean) / self.std) @ self.w[1:], -30, 30)
        return 1 / (1 + np.exp(-z))
