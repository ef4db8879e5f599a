"""Trees, boosting, k-means, search, attributions and projections against plain computations."""

from __future__ import annotations

import time
from itertools import permutations
from types import SimpleNamespace

import numpy as np
import pyarrow as pa
import pytest
from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from trigwatch.operators import explain, lookups, metrics, models
from trigwatch.operators.trees import AdaBoost, ExtraTrees, Tree, split_gain
from trigwatch import session
from trigwatch.operators import lookups as lookups_module


def frame(spark, x, y, parts=3):
    rows = [(i, float(b), [float(v) for v in a]) for i, (a, b) in enumerate(zip(x, y))]
    df = spark.createDataFrame(rows, "key BIGINT, label DOUBLE, a ARRAY<DOUBLE>").repartition(parts)
    return df.select("key", "label", array_to_vector("a").alias("features"))


@pytest.fixture(scope="module")
def data():
    rng = np.random.default_rng(11)
    x = np.round(rng.normal(size=(300, 5)), 2)
    x[:, 4] = 1.0  # constant: it splits nothing
    y = ((x[:, 0] + 0.5 * x[:, 1] > 0.3) ^ (rng.random(300) < 0.1)).astype(float)
    return x, y


def test_extra_trees_cut_inside_each_node(spark, data):
    x, y = data
    model = ExtraTrees(trees=7, depth=6).fit(frame(spark, x, y))
    weight = np.where(y == 1, len(y) / (2 * y.sum()), len(y) / (2 * (len(y) - y.sum())))
    for tree in model.trees:
        stack = [(0, np.arange(len(x)))]
        while stack:
            node, rows = stack.pop()
            assert abs(tree.value[node] - weight[rows] @ y[rows] / weight[rows].sum()) < 1e-9
            f = tree.feature[node]
            if f < 0:
                continue
            assert f != 4 and x[rows, f].min() <= tree.threshold[node] < x[rows, f].max()
            left = x[rows, f] <= tree.threshold[node]
            assert 0 < left.sum() < len(rows)
            stack += [(tree.left[node], rows[left]), (tree.right[node], rows[~left])]
    assert max(len(t.feature) for t in model.trees) > 7 and len({tuple(t.threshold) for t in model.trees}) == 7
    again = ExtraTrees(trees=7, depth=6).fit(frame(spark, x, y, parts=1))
    assert all(np.allclose(a.threshold, b.threshold) and a.feature == b.feature for a, b in zip(model.trees, again.trees))


def test_extra_trees_of_one_class(spark):
    model = ExtraTrees(trees=2).fit(frame(spark, [[1.0], [2.0]], [1, 1]))
    assert model.chances(np.array([[3.0]]))[0] == 1.0


def best_stump(x, y, w, cuts):
    best = None
    for f in range(x.shape[1]):
        for c in cuts:
            left = x[:, f] <= c
            if left.all() or not left.any():
                continue
            s = [w[left & (y == 0)].sum(), w[left & (y == 1)].sum(), w[~left & (y == 0)].sum(), w[~left & (y == 1)].sum()]
            gain = round(float(split_gain(*map(np.float64, s))), 9)
            if best is None or gain > best[0]:
                best = (gain, f, c, s[1] / (s[0] + s[1]), s[3] / (s[2] + s[3]))
    return best


def test_every_round_takes_the_best_weighted_split(spark, data):
    x, y = data
    cuts = [round(-2 + 0.25 * i, 2) for i in range(17)]
    model = AdaBoost(rounds=6, cuts=cuts).fit(frame(spark, x, y))
    assert len(model.trees) == 6
    w = np.full(len(x), 1.0)
    raised = np.zeros(len(x))
    for i, (tree, alpha) in enumerate(model.trees):
        scale = np.exp(raised - sum(a for _, a in model.trees[:i]))
        _, f, c, left, right = best_stump(x, y, w * scale, cuts)
        assert (tree.feature[0], tree.threshold[0]) == (f, c)
        assert np.allclose(tree.value[1:], [left, right])
        wrong = (np.where(x[:, f] <= c, left, right) > 0.5) != (y == 1)
        error = (w * scale)[wrong].sum() / (w * scale).sum()
        assert abs(alpha - np.log((1 - error) / error)) < 1e-9
        raised += alpha * wrong


def test_boosted_trees_of_more_levels(spark, data):
    x, y = data
    model = AdaBoost(rounds=5, depth=3).fit(frame(spark, x, y))
    assert max(len(t.feature) for t, _ in model.trees) > 7
    assert ((model.chances(x) > 0.5) == (y == 1)).mean() > 0.85
    perfect = AdaBoost(rounds=5).fit(frame(spark, x, x[:, 0] > 0.07))
    assert len(perfect.trees) <= 5


def test_kmeans_restarts_share_their_passes(spark):
    rng = np.random.default_rng(1)
    x = np.concatenate([rng.normal(c, 0.2, (60, 2)) for c in ((0, 0), (4, 0), (0, 4), (4, 4))])
    df = frame(spark, x, np.zeros(len(x)))
    passes, plain = [], models.Centroids._totals
    models.Centroids._totals = lambda self, rows, starts: passes.append(len(starts)) or plain(self, rows, starts)
    try:
        model = models.fit_kmeans(df, k=4, restarts=5, rounds=50)
    finally:
        models.Centroids._totals = plain
    assert passes[0] == passes[-1] == 5 and len(passes) <= 51
    near = ((x[:, None] - model.centers) ** 2).sum(2)
    assert abs(near.min(1).sum() - model.cost) < 1e-6 and model.cost == min(model.costs)
    assert all(np.allclose(model.centers[c], x[near.argmin(1) == c].mean(0), atol=1e-3) for c in range(4))
    few = models.fit_kmeans(frame(spark, [[1.0], [1.0], [2.0]], [0, 0, 0]), k=5, restarts=2)
    assert sorted(few.centers.ravel()) == [1.0, 2.0]


def test_mixture_table_has_the_criteria(spark):
    rng = np.random.default_rng(2)
    x = np.concatenate([rng.normal(0, 1, (150, 3)), rng.normal(5, 2, (100, 3))])
    df = frame(spark, x, np.zeros(250))
    model = models.fit_gmm(df, k=2)
    table = models.mixture_table(spark, model).toPandas()
    fit = np.zeros(250)
    for c, part in table.groupby("component"):
        mean, cov = np.zeros(3), np.zeros((3, 3))
        for r in part.itertuples():
            mean[r.i] = r.mean
            cov[r.i, r.j] = cov[r.j, r.i] = r.covariance
        z = x - mean
        fit += part.weight.iloc[0] * np.exp(-0.5 * np.einsum("ij,jk,ik->i", z, np.linalg.inv(cov), z)) / np.sqrt(np.linalg.det(2 * np.pi * cov))
    [r] = models.gmm_criteria(model, df, 3).collect()
    assert abs(np.log(fit).sum() - r.log_likelihood) < 1e-6 and abs(r.bic - (19 * np.log(250) - 2 * r.log_likelihood)) < 1e-6


def test_curves_of_many_groups(spark):
    rng = np.random.default_rng(3)
    rows = [(g, int(rng.random() < 0.3), round(float(rng.random()), 1 if g else 3)) for g in range(5) for _ in range(40 + 100 * (g == 2))]
    df = spark.createDataFrame(rows, "g INT, label INT, score DOUBLE")
    got = {r.g: r for r in metrics.curves_by(df, ["g"]).collect()}
    for g in range(5):
        one = {r["metric"]: r["value"] for r in metrics.evaluate(df.where(F.col("g") == g)).collect()}
        assert abs(got[g].roc_auc - one["roc_auc"]) < 1e-9 and abs(got[g].average_precision - one["average_precision"]) < 1e-9


def test_search_scores_all_candidates_at_once(spark, data, monkeypatch):
    x, y = data
    calls, plain = [], metrics.running_totals
    monkeypatch.setattr(metrics, "running_totals", lambda *a, **k: calls.append(1) or plain(*a, **k))
    pipeline = models.decision_tree()
    grid = models.param_grid(pipeline.getStages()[0], {"maxDepth": [1, 4]})
    df = frame(spark, x, y).withColumns({"fold": (F.col("key") % 3).cast("int"), "weight": F.lit(1.0)}).cache()
    found = models.search(pipeline, grid, df, 3, {"roc_auc": 0.5, "average_precision": 0.5})
    assert len(calls) == 1  # one sort for two candidates and three folds
    report = {r.candidate: r for r in models.cv_results(spark, found).collect()}
    for c in (0, 1):
        folds = []
        for k in range(3):
            scored = models.score(pipeline.fit(df.where(F.col("fold") != k), grid[c]), df.where(F.col("fold") == k))
            folds.append(metrics.roc_auc(scored.select(F.col("label").cast("int").alias("label"), F.col("probability").alias("score"))).first()[0])
        assert abs(report[c].mean_roc_auc - np.mean(folds)) < 1e-9 and abs(report[c].std_roc_auc - np.std(folds)) < 1e-9
    assert sorted(r.rank_composite_score for r in report.values()) == [1, 2] and report[found.best].rank_composite_score == 1


def exact(score, x, background, dimension):
    """Mean over all feature orders and background rows."""
    out, orders = np.zeros((len(x), dimension)), list(permutations(range(dimension)))
    for i, row in enumerate(x):
        for b in background:
            for order in orders:
                at = b.copy()
                before = score(at[None])[0]
                for f in order:
                    at[f] = row[f]
                    now = score(at[None])[0]
                    out[i, f] += now - before
                    before = now
    return out / (len(orders) * len(background))


def test_tree_attributions_equal_all_orders(spark, data):
    x, y = data
    x = x[:, :4]
    model = ExtraTrees(trees=4, depth=4).fit(frame(spark, x, y))
    leaves = explain.forest_leaves(explain.node_table(spark, model))
    rows, background = np.concatenate([x[:4], x[:1]]), x[50:56]
    got = explain.leaf_attributions(rows, background, leaves)
    assert np.allclose(got, exact(model.chances, rows, background, 4), atol=1e-12)
    assert np.allclose(got.sum(1), model.chances(rows) - model.chances(background).mean())


@pytest.mark.parametrize("kind", ["forest", "tree"])
def test_forest_attributions_add_up(spark, data, kind):
    x, y = data
    df = frame(spark, x, y)
    model = models.fit_classifier(models.random_forest(trees=9, depth=5) if kind == "forest" else models.decision_tree(depth=5), df)
    rows, background = df.where("key < 20"), df.where("key >= 100 AND key < 130")
    found = explain.shapley_values(spark, explain.node_table(spark, model.stages[-1]), rows, background, "key")
    sums = {r.key: r.s for r in found.groupBy("key").agg(F.sum("attribution").alias("s")).collect()}
    base = models.score(model, background).agg(F.avg("probability")).first()[0]
    for r in models.score(model, rows).collect():
        assert abs(sums.get(r.key, 0.0) - (r.probability - base)) < 1e-9
    sampled = explain.sampled_shapley(model, rows.where("key < 3").select("key", "features"), background.select("features"), "key", 5, permutations=120)
    near = {(r.key, r.feature_idx): r.attribution for r in sampled.collect()}
    assert all(abs(near.get((r.key, r.feature_idx), 0.0) - r.attribution) < 0.05 for r in found.where("key < 3").collect())


def test_one_leaf_has_no_attributions(spark):
    assert not explain.leaf_attributions(np.zeros((2, 3)), np.ones((2, 3)), explain.forest_leaves(spark.createDataFrame([(0, 0, -1, 0.0, -1, -1, 0.5)], "tree INT, node INT, feature INT, threshold DOUBLE, left INT, right INT, value DOUBLE"))).any()
    tree = Tree()
    assert tree.leaves(np.zeros((3, 1))).tolist() == [0, 0, 0]


def test_projection_without_the_covariance(spark):
    rng = np.random.default_rng(7)
    x = rng.normal(size=(400, 40)) @ np.diag(np.linspace(3, 0.2, 40)) * (rng.random((400, 40)) < 0.5) + 1.0 * (np.arange(40) % 3 == 0)
    df = frame(spark, x, np.zeros(400))
    mean, loadings, variances = explain.principal_directions(df, 3)
    want = np.linalg.eigvalsh(np.cov(x.T))[::-1][:3]
    assert np.allclose(mean, x.mean(0)) and np.allclose(variances, want, rtol=0.01)
    assert np.allclose(loadings.T @ loadings, np.eye(3), atol=1e-9)
    got = explain.project_windows(df, 3).orderBy("key").select("c1", "c2", "c3").toPandas().to_numpy()
    assert abs(got.var(0, ddof=1).sum() / want.sum() - 1) < 0.01


def test_alert_context_of_a_hot_host(spark, monkeypatch):
    events = spark.range(3000).select(
        F.col("id").alias("event_id"), F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("h"), (F.col("id") % 97).cast("string"))).alias("hostname"),
        (F.lit("2024-01-01 00:00:00").cast("timestamp_ntz") + F.make_dt_interval(mins=F.when(F.col("id") % 3 == 0, 5).otherwise(F.col("id").cast("int") % 600))).alias("timestamp"),
    )
    windows = [("2024-01-01_00-00-00_W0", h) for h in ("hot", "h1", "h2", "none")] + [("2024-01-01_06-00-00_W1", h) for h in ("hot", "h5")]
    alerts = spark.createDataFrame(windows, "window_id STRING, hostname STRING")
    small = sorted(r.event_id for r in lookups.alert_context(alerts, events, 360).collect())
    monkeypatch.setattr(lookups_module, "is_small", lambda df: False)
    large = lookups.alert_context(alerts, events, 360)
    assert sorted(r.event_id for r in large.collect()) == small and sum(i % 3 == 0 for i in small) == 1000
    assert not session.is_small(events, max_rows=10) and not session.is_small(events, max_bytes=100) and session.is_small(events)


def test_kmeans_sums_are_added_by_column(monkeypatch):
    rng = np.random.default_rng(6)
    x = rng.normal(size=(20_000, 64))
    starts = [x[i * 10 : i * 10 + 10] for i in range(3)]
    batch = pa.RecordBatch.from_arrays([pa.array(list(x))], names=["x"])
    rows = SimpleNamespace(mapInArrow=lambda sums, schema: list(sums([batch])))
    found = lambda parts: (r for part in parts for r in zip(*(c.to_pylist() for c in part.columns)))
    monkeypatch.setattr(models, "added_up", found)
    def plain():
        parts = []
        for centers in starts:
            near = ((x * x).sum(1)[:, None] + (centers * centers).sum(1) - 2 * x @ centers.T).argmin(1)
            part = np.zeros((10, 66))
            np.add.at(part[:, :64], near, x)
            np.add.at(part[:, 64], near, 1)
            np.add.at(part[:, 65], near, ((x - centers[near]) ** 2).sum(1))
            parts.append(part)
        return parts

    took = {plain: [], models.Centroids(10)._totals: []}
    for _ in range(5):
        for run, seconds in took.items():
            began = time.perf_counter()
            out = run() if run is plain else run(rows, starts)
            seconds.append(time.perf_counter() - began)
            if run is plain:
                expected = out
    for (sums, counts, cost), part in zip(out, expected):
        assert np.array_equal(part[:, :64], sums) and np.array_equal(part[:, 64], counts)
        assert abs(cost - part[:, 65].sum()) < 1e-9 * cost
    best = [min(seconds) for seconds in took.values()]
    assert best[1] < 0.8 * best[0]  # values scattered one by one take longest
