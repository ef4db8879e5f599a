"""Bounded samples of labelled texts, and calibration of a raw value."""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def remainder(id_col: str, folds: int) -> Column:
    """crc32 of the id as text, modulo ``folds``; null for a null id."""
    return F.crc32(F.col(id_col).cast("string")) % folds


def labelled_sample(
    docs: DataFrame, labels: DataFrame, label: str, usable: Column, per_class: int, most_bytes: int, id_col: str = "doc_id", text_col: str = "text",
    also: Sequence[str] = (),
) -> tuple[list[tuple], dict[int, int]]:
    """At most ``per_class`` texts of each class, and the size of each class among all usable labels.

    Rows ``(id, label, text, *also)`` in hash order of the id. Usable labels are 0 or 1, have
    an id and fulfil ``usable``; ids labelled twice count once, by their smaller label. Texts
    over ``most_bytes`` are not used for training. Only the chosen ids, of which there is a
    fixed number, are joined with the documents.
    """
    known = (
        labels.select(F.col(id_col).cast("long").alias("_id"), F.col(label).cast("int").alias("_y"))
        .where(F.col("_id").isNotNull() & F.col("_y").isin(0, 1)).groupBy("_id").agg(F.min("_y").alias("_y"))
    )
    known = known.withColumnRenamed("_id", id_col).where(usable)
    sizes = {r[0]: r[1] for r in known.groupBy("_y").agg(F.count(F.lit(1))).collect()}
    parts = [known.where(F.col("_y") == y).orderBy(F.xxhash64(id_col), id_col).limit(per_class) for y in (0, 1)]
    chosen = parts[0].unionByName(parts[1]).select(F.col(id_col).alias("_id"), "_y")
    plain = docs.select(
        F.col(id_col).cast("long").alias("_id"), F.col(text_col).alias("_text"), *[F.col(c).cast("string").alias(f"_also_{c}") for c in also]
    )
    found = plain.where(F.octet_length("_text").between(1, most_bytes)).join(F.broadcast(chosen), "_id")
    # an id that many rows share counts once, with its first text
    once = found.groupBy("_id", "_y").agg(F.min(F.struct("_text", *[f"_also_{c}" for c in also])).alias("_r"))
    rows = once.select("_id", "_y", "_r.*", F.xxhash64("_id").alias("_at")).collect()
    return [tuple(r)[:-1] for r in sorted(rows, key=lambda r: (r["_at"], r["_id"]))], sizes


class Calibration:
    """Probability of class 1 from raw features, by a weighted logistic fit.

    Features are standardised; class weights bring the sample back to the class sizes of all
    labels. Without both classes the smoothed share of class 1 is the only answer.
    """

    def __init__(self, values: np.ndarray, y: np.ndarray, sizes: dict[int, int], ridge: float = 1e-3) -> None:
        n0, n1 = sizes.get(0, 0), sizes.get(1, 0)
        self.prior = (n1 + 1) / (n0 + n1 + 2)
        self.weights = None
        if not len(y) or y.min() == y.max():
            return
        values = np.asarray(values, float).reshape(len(y), -1)
        self.mean, self.scale = values.mean(0), values.std(0) + 1e-9
        x = np.c_[self._standard(values), np.ones(len(y))]
        share = np.where(y == 1, n1 / (y == 1).sum(), n0 / (y == 0).sum())
        share = share / share.mean()
        w = np.zeros(x.shape[1])
        for _ in range(50):
            p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
            gradient = x.T @ (share * (p - y)) / len(y) + ridge * w
            bend = (x * (share * p * (1 - p))[:, None]).T @ x / len(y) + ridge * np.eye(len(w))
            step = np.linalg.solve(bend, gradient)
            w -= np.clip(step, -3, 3)
            if np.abs(step).max() < 1e-8:
                break
        self.weights = w

    def _standard(self, values: np.ndarray) -> np.ndarray:
        return np.clip((values - self.mean) / self.scale, -6, 6)

    def __call__(self, values: Sequence[float]) -> float:
        if self.weights is None:
            return self.prior
        z = float(self._standard(np.asarray(values, float)) @ self.weights[:-1] + self.weights[-1])
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, z))))
