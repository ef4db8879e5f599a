"""Quality of a text by how much better a dictionary of good text compresses it than one of bad text."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from trigwatch.llm.common import batched, filled, fresh, table
from trigwatch.llm.labelled import Calibration, labelled_sample, remainder
from trigwatch.llm.registry import query

#: bound of the training sample: texts of each class, bytes of a text, pieces of a text for a dictionary
PER_CLASS, TEXT_BYTES, TEXT_PIECES = 1600, 1 << 15, 6
PIECE, DICTIONARY, LEVEL = 512, 1 << 16, 1


def pieces(text: bytes) -> list[bytes]:
    return [text[at : at + PIECE] for at in range(0, len(text), PIECE)]


def dictionary(texts: list[bytes]) -> bytes:
    """A trained dictionary of pieces spread over each text; too few pieces serve as they are."""
    parts = []
    for text in texts:
        all_ = pieces(text)
        parts += all_[:: max(1, -(-len(all_) // TEXT_PIECES))]
    try:
        return zstandard.train_dictionary(DICTIONARY, parts).as_bytes()
    except (zstandard.ZstdError, ValueError):
        return b"".join(parts)[:DICTIONARY]


class CompressionClassifier:
    """Two dictionaries and a calibration; the texts that train them are different halves."""

    def __init__(self, sample: list[tuple], sizes: dict[int, int]) -> None:
        coded = [(y, text.encode("utf-8", "surrogatepass")) for _, y, text in sample]
        half = {y: [t for label, t in coded if label == y] for y in (0, 1)}
        self.dictionaries = {y: dictionary(texts[::2]) for y, texts in half.items()} if all(half.values()) else None
        self._packers = None
        rest = [(y, t) for y in (0, 1) for t in half[y][1::2]] if self.dictionaries else []
        values = np.array([self.values(t) for _, t in rest]).reshape(len(rest), 2)
        self.calibration = Calibration(values, np.array([y for y, _ in rest], int), sizes)

    def __getstate__(self):
        return self.__dict__ | {"_packers": None}

    def values(self, text: bytes) -> tuple[float, float]:
        """Normalised difference of the compressed sizes over all pieces, and for the piece where it is least.

        A short last piece is too short to compare: the last ``PIECE`` bytes stand for it."""
        if self._packers is None:
            self._packers = {}
            for y, data in self.dictionaries.items():
                known = zstandard.ZstdCompressionDict(data)
                known.precompute_compress(level=LEVEL)
                self._packers[y] = zstandard.ZstdCompressor(dict_data=known, write_content_size=False, write_dict_id=False)
        good, bad = self._packers[1].compress, self._packers[0].compress
        sizes = [(len(bad(p)), len(good(p))) for p in pieces(text)]
        if not sizes:
            return 0.0, 0.0
        b, g = map(sum, zip(*sizes))
        whole = sizes
        if len(text) > PIECE and len(text) % PIECE:
            whole = [*sizes[:-1], (len(bad(text[-PIECE:])), len(good(text[-PIECE:])))]
        return (b - g) / (b + g), min((x - y) / (x + y) for x, y in whole)

    def score(self, text: str) -> float:
        if self.dictionaries is None:
            return self.calibration.prior
        return self.calibration(self.values(text.encode("utf-8", "surrogatepass")))


def fit_quality(docs: DataFrame, labels: DataFrame, usable: Column, id_col: str = "doc_id", text_col: str = "text", label: str = "quality") -> CompressionClassifier:
    """Fit on a bounded sample of the usable labels (``PER_CLASS`` texts each, of at most
    ``TEXT_BYTES``). Labels other than 0 and 1, labels without a text and empty texts are left
    out; with no text of one class, every score is the smoothed share of label 1."""
    return CompressionClassifier(*labelled_sample(batched(docs), labels, label, usable, PER_CLASS, TEXT_BYTES, id_col, text_col))


def quality_score(model: CompressionClassifier, text_col: str = "text") -> Column:
    """Probability that a whole text is good; null counts as empty. An empty text has difference 0."""

    @F.pandas_udf("double")
    def score(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in texts:
            yield pd.Series([model.score(t) for t in batch], dtype="float64")

    return score(filled(text_col))


def good_only(docs: DataFrame, model: CompressionClassifier, least: float = 0.3, text_col: str = "text") -> DataFrame:
    """``docs`` without the rows that score below ``least``; columns stay."""
    (score,) = fresh(docs, "score")
    return docs.withColumn(score, quality_score(model, text_col)).where(F.col(score) >= least).drop(score)


@query("op1_quality")
def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    fold = remainder("doc_id", 5)
    model = fit_quality(docs, table(spark, sf_dir, "labels"), fold != 0)
    scored = docs.select("doc_id", F.coalesce(fold == 0, F.lit(False)).alias("held_out"), quality_score(model).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= 0.3).cast("int"))
