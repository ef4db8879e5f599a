from __future__ import annotations

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from trigwatch.llm import negatives
from trigwatch.llm.negatives import hard_negatives, mined, pack, products, unpack


def brute(rows, positives=5, negatives=10, least=30, most=90):
    kept = []
    for vec_id, vector, label in rows:
        if vec_id is not None and vector is not None and label is not None and all(x is not None and math.isfinite(x) for x in vector):
            kept.append((vec_id, label, [math.floor(256 * x) for x in vector]))
    out = []
    for anchor_id, label, vector in kept:
        if anchor_id % 10:
            continue
        scored = sorted((-sum(a * b for a, b in zip(vector, v)), i, y) for i, y, v in kept)
        top = [(i, -s) for s, i, y in scored if y == label and i != anchor_id][:positives]
        for positive_id, high in top:
            rest = [(i, -s) for s, i, y in scored if y != label and least * high <= -100 * s <= most * high]
            out += [(anchor_id, positive_id, rank, i, high, s) for rank, (i, s) in enumerate(rest[:negatives], 1)]
    return sorted(out)


def found(spark, rows, parts=5, **settings):
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    frame = frame.selectExpr("*", "1 AS key", "2 AS score", "'x' AS vector", "3 AS anchor").repartition(parts)
    return sorted(map(tuple, hard_negatives(frame, F.col("vec_id") % 10 == 0, **settings).collect()))


def made(n, rng, labels=3, step=8):
    return [(i, [rng.randint(-step, step) / step for _ in range(6)], rng.randrange(labels)) for i in range(n)]


def test_keys_sort_like_their_parts():
    rng = random.Random(1)
    parts = [(rng.randrange(3), rng.choice([-(2**62), -5, 0, 5, 2**62]), rng.random() < 0.5, rng.choice([-7, 0, 7, 2**40])) for _ in range(500)]
    keys = sorted(pack(*p) for p in parts)
    assert [unpack(k) for k in keys] == sorted(parts, key=lambda p: (p[0], -p[1], p[2], p[3]))


def test_windows_open_and_close():
    keys = sorted(pack(1, s, n, i) for s, n, i in [(100, False, 2), (95, True, 3), (90, True, 4), (60, False, 5), (54, True, 6), (30, True, 7), (29, True, 8), (18, True, 9)])
    got = [(p, r, n) for _, p, r, n, _, _ in mined(keys, 5, 10, 30, 90)]
    assert got == [(2, 1, 4), (2, 2, 6), (5, 1, 6), (2, 3, 7), (5, 2, 7), (5, 3, 8), (5, 4, 9)]
    assert not list(mined([], 5, 10, 30, 90))


def test_products_are_exact():
    rng = np.random.default_rng(2)
    for most in (200, 1 << 20, 1 << 28):
        a, b = rng.integers(-most, most, (20, 16)), rng.integers(-most, most, (9, 16))
        assert (products(a, b) == np.array([[sum(int(x) * int(y) for x, y in zip(r, s)) for s in b] for r in a])).all()
    with pytest.raises(ValueError):
        products(np.full((1, 4), 1 << 31), np.full((1, 4), 1 << 31))


@pytest.mark.parametrize("step", [2, 50])
def test_against_brute_force(spark, step):
    rows = made(400, random.Random(step), step=step)
    assert found(spark, rows) == brute(rows) != []
    assert found(spark, rows, positives=2, negatives=3, least=10, most=100) == brute(rows, 2, 3, 10, 100)


def test_several_passes_and_small_blocks(spark, monkeypatch):
    rows = made(400, random.Random(4))
    monkeypatch.setattr(negatives, "ANCHORS", 7)
    monkeypatch.setattr(negatives, "CELLS", 300)
    assert found(spark, rows, 3) == brute(rows)


def test_one_label_and_equal_rows(spark):
    rng = random.Random(8)
    base = made(30, rng)
    rows = [(i, base[i % 30][1], 0 if i % 9 else 1) for i in range(300)]
    assert found(spark, rows) == brute(rows)
    assert found(spark, [(i, [1.0], 0) for i in range(50)]) == []


def test_odd_rows(spark):
    rng = random.Random(5)
    rows = made(120, rng)
    rows += rows[:25]  # repeated anchors and rows
    rows += [(None, [1.0] * 6, 1), (130, None, 1), (140, [1.0] * 6, None), (150, [1.0, None] * 3, 1), (160, [float("nan")] * 6, 1),
             (170, [float("inf")] * 6, 2), (180, [], 1), (190, [0.5, 0.5], 2), (-200, [1.0] * 9, 0), (201, [0.25] * 9, 1)]
    assert found(spark, rows) == brute(rows)


def test_empty_table(spark):
    assert found(spark, []) == []
    assert found(spark, [(1, [1.0], 0)]) == []
