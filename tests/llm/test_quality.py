from __future__ import annotations

import random
import zlib

import numpy as np
import pytest
import zstandard
from pyspark.sql import functions as F

from trigwatch.llm import toxicity
from trigwatch.llm.labelled import Calibration, remainder
from trigwatch.llm.quality import CompressionClassifier, fit_quality, good_only, quality_score
from trigwatch.llm.toxicity import TextCnn, ToxicityModel, best_threshold, fit_toxicity, language_threshold, toxicity_score, word_ids


def prose(rng, n=80):
    return " ".join("".join(rng.choice(["an", "ter", "ing", "re", "on", "tion"]) for _ in range(rng.randint(1, 3))) for _ in range(n))


def junk(rng, n=80):
    return " ".join(w.upper() + "!!" for w in prose(rng, n).split())


def labels(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, quality int, toxic int")


def auc(scores, y):
    order = np.argsort(scores, kind="stable")
    rank = np.empty(len(scores))
    rank[order] = np.arange(len(scores))
    return (rank[y == 1].sum() - y.sum() * (y.sum() - 1) / 2) / (y.sum() * (len(y) - y.sum()))


def test_held_out_quality(spark, make_docs):
    rng = random.Random(1)
    rows = [(i, (junk if i % 4 == 0 else prose)(rng, rng.randint(20, 200)), "en", "a") for i in range(400)]
    known = labels(spark, [(i, int(i % 4 != 0), 0) for i in range(400)])
    docs, fold = make_docs(rows), remainder("doc_id", 5)
    model = fit_quality(docs, known, fold != 0)
    out = docs.withColumn("q", quality_score(model)).withColumn("held", fold == 0).collect()
    assert all(r.held == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in out)
    held = [r for r in out if r.held]
    y = np.array([r.doc_id % 4 != 0 for r in held], int)
    assert len(held) > 50 and auc(np.array([r.q for r in held]), y) > 0.99
    assert np.mean([(r.q >= 0.5) == (r.doc_id % 4 != 0) for r in held]) > 0.97
    kept = good_only(docs, model)
    assert kept.columns == docs.columns
    ids = {r.doc_id for r in kept.collect()}
    assert sum(i % 4 != 0 for i in ids) >= 295 and sum(i % 4 == 0 for i in ids) <= 5


def test_only_usable_labels_count(spark, make_docs):
    """Labels of the held-out fold, wrong ones, change nothing."""
    rng = random.Random(2)
    docs = make_docs([(i, (junk if i % 2 else prose)(rng), "en", "a") for i in range(200)])
    fold = remainder("doc_id", 5)
    held = {i for i in range(200) if zlib.crc32(str(i).encode()) % 5 == 0}
    scores = []
    for flip in (False, True):
        model = fit_quality(docs, labels(spark, [(i, int(i % 2 == 0) ^ int(flip and i in held), 0) for i in range(200)]), fold != 0)
        scores.append([model.score(prose(random.Random(k))) for k in range(5)])
    assert scores[0] == scores[1]


@pytest.mark.parametrize("fit,score,label", [(fit_quality, quality_score, "quality"), (fit_toxicity, toxicity_score, "toxic")])
def test_odd_rows_and_labels(spark, make_docs, odd_rows, fit, score, label):
    docs = make_docs(odd_rows)
    for rows in ([], [(1, 1, 1), (None, 0, 0), (2, None, None), (3, 7, 7)], [(1, 1, 1), (1, 0, 0), (2, 0, 0), (8, 1, 1), (99, 1, 1), (4, 0, 0), (3, 0, 0)]):
        model = fit(docs, labels(spark, rows), F.lit(True))
        out = docs.select("doc_id", score(model).alias("s")).collect()
        assert len(out) == len(odd_rows) and all(0 <= r.s <= 1 for r in out)
    assert make_docs([]).select(score(model)).count() == 0


def test_calibration():
    rng = np.random.default_rng(1)
    x = rng.normal(size=6000)
    y = (rng.random(6000) < 1 / (1 + np.exp(-2 * x))).astype(int)
    fitted = Calibration(x[:, None], y, {0: int((y == 0).sum()), 1: int(y.sum())})
    p = np.array([fitted([v]) for v in x])
    for low in np.arange(0, 1, 0.2):
        inside = (p >= low) & (p < low + 0.2)
        assert abs(p[inside].mean() - y[inside].mean()) < 0.05
    rare = Calibration(x[:, None], y, {0: 9000, 1: 1000})
    assert rare([0.0]) < fitted([0.0])
    assert Calibration(np.zeros((0, 1)), np.zeros(0, int), {}).prior == 0.5


def test_without_a_class():
    model = CompressionClassifier([(1, 1, "some text")], {1: 3})
    assert model.score("x") == model.score("") == 4 / 5
    assert ToxicityModel([(1, 0, "a", "en")], {0: 8}).score("x") == 0.1


WORDS = ["vilword", "grubnak", "zorfel", "kantip"]


def toxic_rows(n, seed):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        w = prose(rng, rng.randint(5, 120)).split()
        toxic = i % 3 == 0
        for _ in range(rng.randint(1, 3) if toxic else 0):
            w.insert(rng.randrange(len(w)), rng.choice(WORDS) + rng.choice(["", ",", "!!", "ish"]))
        rows.append((i, " ".join(w), "ende"[i % 2 * 2 :][:2], "a"))
    return rows


def test_held_out_toxicity(spark, make_docs):
    rows = toxic_rows(700, 3)
    docs, fold = make_docs(rows), remainder("doc_id", 3)
    model = fit_toxicity(docs, labels(spark, [(i, 1, int(i % 3 == 0)) for i in range(700)]), fold != 1)
    out = docs.withColumn("s", toxicity_score(model)).withColumn("t", language_threshold(model)).where(fold == 1).collect()
    y = np.array([r.doc_id % 3 == 0 for r in out])
    s = np.array([r.s for r in out])
    assert auc(s, y.astype(int)) > 0.98
    assert ((s >= 0.7) == y).mean() > 0.95
    assert (np.array([r.s >= r.t for r in out]) == y).mean() > 0.95
    assert set(model.thresholds) == {None, "en", "de"}


def test_long_texts_go_window_by_window(monkeypatch):
    rows = toxic_rows(60, 4)
    network = TextCnn()
    network.fit([r[1] for r in rows], np.array([int(r[0] % 3 == 0) for r in rows]))
    text = " ".join(r[1] for r in rows)
    whole = network.value(text)
    monkeypatch.setattr("trigwatch.llm.toxicity.WINDOW", 16)
    assert abs(network.value(text) - whole) < 1e-5


def test_threshold():
    assert best_threshold(np.array([0.9, 0.8, 0.3, 0.1]), np.array([1, 1, 0, 0])) == pytest.approx(0.55)


def test_worst_piece_can_be_the_last():
    rng = random.Random(8)
    sample = [(i, int(i % 2 == 0), (junk if i % 2 else prose)(rng, 200)) for i in range(80)]
    model = CompressionClassifier(sample, {0: 40, 1: 40})
    good, bad = prose(rng, 900).encode(), junk(rng, 300).encode()
    for size in (300, 512):  # a last piece that is short, or full
        clean, ending, within = (model.values(t)[1] for t in (good[: 1536 + size], good[:1536] + bad[:size], good[:512] + bad[:512] + good[:1024]))
        assert within < clean - 0.2 and ending < clean - 0.1, (size, clean, ending, within)


def test_compressed_difference_by_the_library_alone():
    """Every value against one-off compressors, without the operator's pieces or packers."""
    rng = random.Random(12)
    model = CompressionClassifier([(i, i % 2, (prose if i % 2 else junk)(rng, 150)) for i in range(60)], {0: 30, 1: 30})

    def size(y, data):
        known = zstandard.ZstdCompressionDict(model.dictionaries[y])
        return len(zstandard.ZstdCompressor(level=1, dict_data=known, write_content_size=False, write_dict_id=False).compress(data))

    for n in (1, 40, 60, 200, 900):
        text = (prose(rng, n) + junk(rng, n // 3)).encode()
        starts = range(0, len(text), 512)
        pairs = [(size(0, text[a : a + 512]), size(1, text[a : a + 512])) for a in starts]
        bad, good = sum(p[0] for p in pairs), sum(p[1] for p in pairs)
        compared = [(a, a + 512) for a in starts if a + 512 <= len(text)] or [(0, len(text))]
        if len(text) > 512 and len(text) % 512:
            compared.append((len(text) - 512, len(text)))
        worst = min((size(0, text[a:b]) - size(1, text[a:b])) / (size(0, text[a:b]) + size(1, text[a:b])) for a, b in compared)
        assert model.values(text) == pytest.approx(((bad - good) / (bad + good), worst), abs=1e-12)
        z = sum(w * min(6, max(-6, (v - m) / s)) for w, v, m, s in zip(model.calibration.weights, model.values(text), model.calibration.mean, model.calibration.scale))
        assert model.score(text.decode()) == pytest.approx(1 / (1 + np.exp(-z - model.calibration.weights[-1])))


def test_network_value_place_by_place():
    """The network's value by plain sums over every place, width and filter."""
    rows = toxic_rows(40, 9)
    network = TextCnn()
    network.fit([r[1] for r in rows], np.array([int(r[0] % 3 == 0) for r in rows]))
    for text in ("", "one", "two words", rows[0][1], rows[5][1]):
        words = [network.embedding[list(ids)].sum(0) for ids in word_ids(text)]
        edge = [np.zeros(toxicity.SIZE)] * (max(toxicity.WIDTHS) - 1)
        places = edge + (words or [np.zeros(toxicity.SIZE)]) + edge
        value = float(network.out[-1])
        for k, w in enumerate(toxicity.WIDTHS):
            for f in range(toxicity.FILTERS):
                responses = [sum(places[at + j] @ network.filters[k][j * toxicity.SIZE : (j + 1) * toxicity.SIZE, f] for j in range(w)) for at in range(len(places) - w + 1)]
                value += max(0.0, max(responses) + network.bias[k][f]) * network.out[k * toxicity.FILTERS + f]
        assert network.value(text) == pytest.approx(value, abs=1e-4)


def test_no_text_calibrates_itself(monkeypatch):
    """Calibration and thresholds see values of networks that were not trained on the text."""
    sample = [(r[0], int(r[0] % 3 == 0), r[1], r[2]) for r in toxic_rows(48, 6)]
    trained, judged = [], []
    plain_fit, plain_value = TextCnn.fit, TextCnn.value

    def fit(self, texts, y, **rest):
        self.own = set(texts)
        trained.append(len(texts))
        plain_fit(self, texts, y, **rest)

    def value(self, text):
        assert text not in self.own
        judged.append(text)
        return plain_value(self, text)

    monkeypatch.setattr(TextCnn, "fit", fit)
    monkeypatch.setattr(TextCnn, "value", value)
    ToxicityModel(sample, {0: 32, 1: 16})
    assert sorted(trained) == [36, 36, 36, 36, 48] and sorted(judged) == sorted(r[2] for r in sample)
    # one toxic text: without its part there is none, and that part gives no values
    judged.clear()
    ToxicityModel([(i, int(i == 2), f"text number {i}", "en") for i in range(8)], {0: 7, 1: 1})
    assert len(judged) == 6


def test_fits_in_tasks_are_the_same(spark):
    sample = [(r[0], int(r[0] % 3 == 0), r[1], r[2]) for r in toxic_rows(40, 5)]
    here, there = [toxicity.fitted(sample, k) for k in range(5)], toxicity.all_fitted(spark, sample)
    assert [v for _, part in here for v in part] == pytest.approx([v for _, part in there for v in part], abs=1e-4)
    assert there[4][0].value("vilword here") == pytest.approx(here[4][0].value("vilword here"), abs=1e-4)
    assert toxicity.all_fitted(spark, []) == [(None, [])] * 5
