"""Toxicity by a small convolutional network over hashed words, trained in numpy."""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from trigwatch.llm.common import batched, filled, table
from trigwatch.llm.labelled import Calibration, labelled_sample, remainder
from trigwatch.llm.registry import query
from trigwatch.llm.wordhash import MARKS, word_heads

#: bound of the training sample: texts of each class, bytes of a text
PER_CLASS, TEXT_BYTES = 1600, 1 << 14
BUCKETS, SIZE, WIDTHS, FILTERS, HEADS = 1 << 15, 12, (2, 3, 4, 5), 8, (4, 5)
ROWS = 1 + len(HEADS)
EPOCHS, BATCH, RATE = 8, 4, 0.15
#: parts of the sample that are held back in turn
FOLDS = 4
#: words that are scored at a time
WINDOW = 1 << 15


def word_ids(text: str) -> np.ndarray:
    """Embedding rows of each word: by the word, and by its first bytes. Marks separate words."""
    parts = word_heads(text, MARKS, HEADS)
    return np.stack([h % np.uint64(BUCKETS) + np.uint64(k * BUCKETS) for k, h in enumerate(parts)], axis=1).astype(np.int64)


class TextCnn:
    """Embedding, convolutions of several widths, maximum over the text, one output.

    An empty text is one padding word. The maximum passes a gradient to one place per filter
    only, so training touches few embedding rows; steps follow Adagrad.
    """

    def __init__(self, seed: int = 7) -> None:
        rng = np.random.default_rng(seed)
        self.embedding = rng.normal(0, 0.1, (ROWS * BUCKETS + 1, SIZE)).astype(np.float32)
        self.embedding[-1] = 0
        self.filters = [rng.normal(0, 0.3, (w * SIZE, FILTERS)).astype(np.float32) for w in WIDTHS]
        self.bias = [np.zeros(FILTERS, np.float32) for _ in WIDTHS]
        self.out = rng.normal(0, 0.1, FILTERS * len(WIDTHS) + 1).astype(np.float32)

    def _pad(self, ids: np.ndarray) -> np.ndarray:
        edge = np.full((max(WIDTHS) - 1, ROWS), ROWS * BUCKETS)
        return np.concatenate([edge, ids, edge]) if len(ids) else np.concatenate([edge, edge, edge[:1]])

    def embedded(self, ids: np.ndarray) -> np.ndarray:
        x = self.embedding[ids[:, 0]]
        for k in range(1, ROWS):
            x = x + self.embedding[ids[:, k]]
        return x

    def pooled(self, ids: np.ndarray, places: bool = False):
        """Largest response of every filter, and where it is."""
        x = self.embedded(ids)
        best, at = [], []
        for w, kernel, bias in zip(WIDTHS, self.filters, self.bias):
            n = len(x) - w + 1
            response = x[:n] @ kernel[:SIZE]
            for j in range(1, w):
                response += x[j : n + j] @ kernel[j * SIZE : (j + 1) * SIZE]
            if places:
                where = response.argmax(0)
                at.append(where)
                best.append(response[where, np.arange(FILTERS)] + bias)
            else:
                best.append(response.max(0) + bias)
        return (np.concatenate(best), at) if places else np.concatenate(best)

    def value(self, text: str) -> float:
        """Log odds of a whole text; long ones window by window, overlapping by the widest filter."""
        ids = self._pad(word_ids(text))
        step = WINDOW - max(WIDTHS) + 1
        best = self.pooled(ids[:WINDOW])
        for at in range(step, len(ids) - max(WIDTHS) + 1, step):
            best = np.maximum(best, self.pooled(ids[at : at + WINDOW]))
        return float(np.maximum(best, 0) @ self.out[:-1] + self.out[-1])

    def fit(self, texts: list[str], y: np.ndarray, seed: int = 11) -> None:
        rng = np.random.default_rng(seed)
        ids = [self._pad(word_ids(t)) for t in texts]
        share = np.where(y == 1, 0.5 / max(y.mean(), 1e-9), 0.5 / max(1 - y.mean(), 1e-9))
        parameters = [*self.filters, *self.bias, self.out]
        squares = [np.full_like(p, 1e-3) for p in parameters]
        squares_e = np.full_like(self.embedding, 1e-3)
        columns = np.arange(FILTERS)
        for _ in range(EPOCHS):
            for chosen in np.array_split(rng.permutation(len(ids)), max(1, len(ids) // BATCH)):
                steps = [np.zeros_like(p) for p in parameters]
                rows, moves = [], []
                for i in chosen:
                    best, at = self.pooled(ids[i], places=True)
                    active = np.maximum(best, 0)
                    p = 1 / (1 + np.exp(-np.clip(active @ self.out[:-1] + self.out[-1], -30, 30)))
                    error = float((p - y[i]) * share[i]) / len(chosen)
                    steps[-1][:-1] += error * active
                    steps[-1][-1] += error
                    back = error * self.out[:-1] * (best > 0)
                    for k, w in enumerate(WIDTHS):
                        b = back[k * FILTERS : (k + 1) * FILTERS]
                        steps[len(WIDTHS) + k] += b
                        for j in range(w):
                            place = ids[i][at[k] + j]
                            x = self.embedded(place)
                            steps[k][j * SIZE : (j + 1) * SIZE, columns] += x.T * b
                            move = self.filters[k][j * SIZE : (j + 1) * SIZE].T * b[:, None]
                            rows += list(place.T)
                            moves += [move] * ROWS
                for p, s, q in zip(parameters, steps, squares):
                    q += s * s
                    p -= RATE * s / np.sqrt(q)
                row, back_to = np.unique(np.concatenate(rows), return_inverse=True)
                step = np.zeros((len(row), SIZE), np.float32)
                np.add.at(step, back_to, np.concatenate(moves))
                squares_e[row] += step * step
                self.embedding[row] -= RATE * step / np.sqrt(squares_e[row])
                self.embedding[-1] = 0


class ToxicityModel:
    """The network, a calibration, and a threshold per language.

    The network is trained on the whole sample. Calibration and thresholds follow the values
    that each text gets from a network trained without its part of the sample; a part without
    which a class is missing gives none. ``fits`` are what ``fitted`` gives for 0 to ``FOLDS``.
    """

    def __init__(self, sample: list[tuple], sizes: dict[int, int], fits: list[tuple] | None = None) -> None:
        *held, (self.network, _) = fits or [fitted(sample, k) for k in range(FOLDS + 1)]
        y = np.array([r[1] for r in sample], int)
        self.thresholds: dict[str | None, float] = {}
        seen = [i for k, (_, part) in enumerate(held) if len(part) for i in range(k, len(sample), FOLDS)]
        values = [v for _, part in held for v in part]
        labels, langs = y[seen], np.array([sample[i][3] for i in seen], object)
        self.calibration = Calibration(np.array(values).reshape(-1, 1), labels, sizes)
        scores = np.array([self.calibration([v]) for v in values])
        for lang in {None, *langs}:
            mine = np.array([lang is None or other == lang for other in langs], bool)
            if mine.sum() >= 20 and 0 < labels[mine].sum() < mine.sum():
                self.thresholds[lang] = best_threshold(scores[mine], labels[mine])

    def score(self, text: str) -> float:
        return self.calibration([self.network.value(text)] if self.network else [0.0])


def network_of(sample: list[tuple]) -> TextCnn | None:
    """A network trained on rows ``(id, label, text, ...)`` of both classes, none if one is missing."""
    y = np.array([r[1] for r in sample], int)
    if not len(y) or y.min() == y.max():
        return None
    network = TextCnn()
    network.fit([r[2] for r in sample], y)
    return network


def fitted(sample: list[tuple], k: int) -> tuple[TextCnn | None, list[float]]:
    """The values of part ``k`` by a network trained on the other parts; for ``k = FOLDS`` the
    network of the whole sample and no values."""
    if k == FOLDS:
        return network_of(sample), []
    network = network_of([r for i, r in enumerate(sample) if i % FOLDS != k])
    return None, [network.value(r[2]) for r in sample[k::FOLDS]] if network else []


def all_fitted(spark: SparkSession, sample: list[tuple]) -> list[tuple]:
    """``fitted`` for every part, each in a task of its own; the sample has a fixed bound."""

    def fit(batches):
        for batch in batches:
            for k in batch.column(0).to_pylist():
                yield pa.RecordBatch.from_arrays([pa.array([k]), pa.array([pickle.dumps(fitted(sample, k))], pa.binary())], names=["k", "fit"])

    found = spark.range(0, FOLDS + 1, 1, FOLDS + 1).mapInArrow(fit, "k long, fit binary").collect()
    return [pickle.loads(r["fit"]) for r in sorted(found, key=lambda r: r["k"])]


def best_threshold(scores: np.ndarray, y: np.ndarray) -> float:
    """Middle of the gap at which F1 is largest."""
    order = np.argsort(-scores, kind="stable")
    hits = np.cumsum(y[order])
    f1 = 2 * hits / (np.arange(1, len(y) + 1) + y.sum())
    at = int(f1.argmax())
    after = scores[order[at + 1]] if at + 1 < len(y) else 0.0
    return float((scores[order[at]] + after) / 2)


def fit_toxicity(docs: DataFrame, labels: DataFrame, usable: Column, id_col: str = "doc_id", text_col: str = "text", label: str = "toxic", lang_col: str = "lang") -> ToxicityModel:
    """Fit on a bounded sample of the usable labels (``PER_CLASS`` texts each, of at most
    ``TEXT_BYTES``). Languages only choose thresholds, never scores; a language with fewer than
    20 held-back texts, or without both classes, uses the threshold of all. With no text of one
    class, every score is the smoothed share of label 1."""
    sample, sizes = labelled_sample(batched(docs), labels, label, usable, PER_CLASS, TEXT_BYTES, id_col, text_col, [lang_col])
    return ToxicityModel(sample, sizes, all_fitted(docs.sparkSession, sample))


def toxicity_score(model: ToxicityModel, text_col: str = "text") -> Column:
    """Probability that a whole text is toxic; null counts as empty."""

    @F.pandas_udf("double")
    def score(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in texts:
            yield pd.Series([model.score(t) for t in batch], dtype="float64")

    return score(filled(text_col))


def language_threshold(model: ToxicityModel, lang_col: str = "lang") -> Column:
    """The calibrated threshold of the row's language, of all languages if it has none."""
    rest = model.thresholds.get(None, 0.5)
    out = F.lit(rest)
    for lang, threshold in sorted((k, v) for k, v in model.thresholds.items() if k is not None):
        out = F.when(F.col(lang_col) == lang, F.lit(threshold)).otherwise(out)
    return out


@query("op8_toxicity")
def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    fold = remainder("doc_id", 3)
    model = fit_toxicity(docs, table(spark, sf_dir, "labels"), fold != 1)
    scored = docs.select("doc_id", F.coalesce(fold == 1, F.lit(False)).alias("held_out"), toxicity_score(model).alias("score"), language_threshold(model).alias("_t"))
    return scored.select("doc_id", "held_out", "score", (F.col("score") >= 0.7).cast("int").alias("predicted"), (F.col("score") >= F.col("_t")).alias("toxic_by_language"))
