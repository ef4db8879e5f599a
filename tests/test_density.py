"""Density clustering against brute force: sparse and crowded cells, copies, borders, refinement."""

from __future__ import annotations

import numpy as np
import pytest

from trigwatch.operators import anomaly


def brute(points: np.ndarray, eps: float, min_samples: int):
    n = len(points)
    near = np.sqrt(((points[:, None] - points[None]) ** 2).sum(-1)) <= eps
    core = near.sum(1) >= min_samples
    label = np.full(n, -1)
    cluster = 0
    for start in range(n):
        if not core[start] or label[start] >= 0:
            continue
        todo, label[start] = [start], cluster
        while todo:
            i = todo.pop()
            for j in np.nonzero(near[i] & core & (label < 0))[0]:
                label[j] = cluster
                todo.append(j)
        cluster += 1
    for i in np.nonzero(~core)[0]:
        found = label[near[i] & core]
        if len(found):
            label[i] = found.min()
    return label, core


def cases():
    rng = np.random.default_rng(5)
    blobs = np.concatenate([rng.normal(c, 0.25, (60, 2)) for c in ((0, 0), (1.6, 0), (5, 5))])
    crowd = np.concatenate([rng.uniform(0, 1, (150, 2)), rng.uniform(0, 1, (150, 2)) + [1.04, 0], rng.uniform(-4, 6, (60, 2))])
    copies = np.concatenate([np.tile([[2.0, 2.0]], (80, 1)), rng.uniform(0, 4, (60, 2))])
    wide = rng.normal(0, 1, (120, 12))
    deep = np.concatenate([rng.uniform(0, 0.2, (80, 10)), rng.uniform(0, 0.2, (80, 10)) + [1.0, *[0.0] * 9], rng.normal(0, 3, (40, 10))])
    return {
        "blobs": (blobs, 0.3, 5), "crowd": (crowd, 0.3, 6), "copies": (copies, 0.4, 4),
        "line": (np.linspace(0, 9, 91).reshape(-1, 1), 0.1 + 1e-9, 3), "wide": (wide, 3.2, 4), "noise": (wide, 0.01, 2),
        "deep": (deep, 1.0, 5),
    }


@pytest.mark.parametrize("name", sorted(cases()))
@pytest.mark.parametrize("refine", [False, True])
def test_against_brute_force(spark, monkeypatch, name, refine):
    points, eps, min_samples = cases()[name]
    if refine:
        monkeypatch.setattr(anomaly, "DIRECT_PAIRS", 0)
        monkeypatch.setattr(anomaly, "BLOCK", 16)
        monkeypatch.setattr(anomaly, "GROUP", 2)
        if name in ("wide", "noise", "line"):
            pytest.skip("no crowded cells to refine")
    df = spark.createDataFrame([(i, [float(v) for v in p]) for i, p in enumerate(points)], "key BIGINT, features ARRAY<DOUBLE>")
    got = sorted(anomaly.fit_dbscan(df, "key", eps, min_samples).select("key", "cluster", "core").collect())
    label, core = brute(points, eps, min_samples)
    assert [r.core for r in got] == list(core)
    assert [r.cluster for r in got] == list(label)


def test_work_is_counted_and_bounded(spark):
    rng = np.random.default_rng(1)
    apart = np.concatenate([rng.normal(c, 0.1, (50, 2)) for c in ((0, 0), (50, 0), (0, 50), (90, 90))])
    everywhere = rng.normal(0, 1, (200, 64))
    everywhere /= np.linalg.norm(everywhere, axis=1, keepdims=True)
    for points, eps, fewest, most in ((apart, 0.2, 1, 200 * 200 // 3), (everywhere, 1.12, 200 * 200 * 0.9, 200 * 200)):
        df = spark.createDataFrame([(i, [float(v) for v in p]) for i, p in enumerate(points)], "key BIGINT, features ARRAY<DOUBLE>")
        dimension, _, grid = anomaly._grid(df, "key", "features", eps, 100)
        assert fewest <= anomaly.compared_pairs(grid, eps, dimension) <= most
    with pytest.raises(ValueError, match="most_pairs"):
        anomaly.fit_dbscan(df, "key", 1.12, 5, most_pairs=10_000)


def test_components(spark):
    edges = [(i, i + 1) for i in range(0, 40)] + [(100, 101), (103, 101)]
    nodes = spark.createDataFrame([(i,) for i in [*range(41), 100, 101, 103, 200]], "node BIGINT")
    got = {r.node: r.component for r in anomaly.connected_components(spark.createDataFrame(edges, "a BIGINT, b BIGINT"), nodes).collect()}
    assert all(got[i] == 0 for i in range(41)) and got[101] == got[103] == 100 and got[200] == 200


def test_blocks_are_dealt_to_tasks(spark, monkeypatch):
    monkeypatch.setattr(anomaly, "BLOCK", 8)
    monkeypatch.setattr(anomaly, "GROUP", 3)
    points = np.random.default_rng(3).normal(0, 1, (200, 12))
    df = spark.createDataFrame([(i, [float(v) for v in p]) for i, p in enumerate(points)], "key BIGINT, features ARRAY<DOUBLE>")
    dimension, _, grid = anomaly._grid(df, "key", "features", 3.2, 4)
    near = np.sqrt(((points[:, None] - points[None]) ** 2).sum(-1)) <= 3.2
    found = anomaly._neighbours(grid, 3.2, dimension).select("p", "q").collect()
    assert len(found) == len(set(found)) and {tuple(r) for r in found} == set(zip(*(at.tolist() for at in np.nonzero(near))))


def plain_silhouette(x, label):
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(-1))
    out = []
    for i in range(len(x)):
        own = (label == label[i]).sum()
        if own == 1:
            out.append(0.0)
            continue
        a, b = d[i][label == label[i]].sum() / (own - 1), min(d[i][label == k].mean() for k in set(label) - {label[i]})
        out.append((b - a) / max(a, b))
    return np.array(out)


def test_silhouette_of_all_and_of_a_sample(spark):
    rng = np.random.default_rng(2)
    x = np.concatenate([rng.normal(c, 0.8, (80, 3)) for c in (0, 3, 5)] + [np.full((1, 3), 20.0), np.full((9, 3), -4.0)])
    label = np.repeat([0, 1, 2, 3, 4], [80, 80, 80, 1, 9])
    df = spark.createDataFrame([(i, int(k), p.tolist()) for i, (k, p) in enumerate(zip(label, x))], "key BIGINT, cluster BIGINT, features ARRAY<DOUBLE>").repartition(3)
    want = plain_silhouette(x, label).mean()
    mean, error = anomaly.silhouette(df, "key")
    assert abs(mean - want) < 1e-9 and error == 0.0
    mean, error = anomaly.silhouette(df, "key", points=120)
    assert 0 < abs(mean - want) <= error == pytest.approx(np.sqrt(2 * np.log(200) / 120))


def test_many_centres_meet_block_by_block(spark, monkeypatch):
    monkeypatch.setattr(anomaly, "CENTRE_BLOCK", 4)
    rng = np.random.default_rng(6)
    c, s = rng.normal(size=(23, 5)), rng.uniform(0.1, 1, 23)
    df = spark.createDataFrame([(i, float(s[i]), c[i].tolist()) for i in range(23)], "cluster BIGINT, s DOUBLE, center ARRAY<DOUBLE>")
    got = {r.cluster: r.worst for r in anomaly.centre_similarity(df).collect()}
    for i in range(23):
        assert abs(got[i] - max((s[i] + s[j]) / np.linalg.norm(c[i] - c[j]) for j in range(23) if j != i)) < 1e-9


def test_no_pair_is_lost_in_single_precision():
    rng = np.random.default_rng(4)
    for scale, far in ((1.0, 0.0), (1e-9, 0.0), (1.0, 3e4), (1e18, 0.0), (1.0, np.nan)):
        a, b = rng.normal(0, scale, (300, 8)) + np.nan_to_num(far), rng.normal(0, scale, (200, 8)) + np.nan_to_num(far)
        if np.isnan(far):
            a[3, 2] = np.nan
        apart = np.sqrt(((a[:, None] - b) ** 2).sum(2))
        eps = float(np.nanmedian(apart))
        found = np.zeros(apart.shape, bool)
        found[anomaly.maybe_within(a, b, eps)] = True
        assert found[apart <= eps].all()
        if scale == 1.0 and far == 0.0:  # and few more
            assert found.sum() - (apart <= eps).sum() < 20
