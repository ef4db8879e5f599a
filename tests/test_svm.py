"""Support vector cascade: optimality over all rows, the plain dual, copies, odd input, saving."""

import numpy as np
import pytest
from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from trigwatch.operators import models, svm
from trigwatch.plans.tables import scratch


def frame(spark, x, y):
    rows = [(i, float(b), [float(v) for v in a]) for i, (a, b) in enumerate(zip(x, y))]
    df = spark.createDataFrame(rows, "key BIGINT, label DOUBLE, a ARRAY<DOUBLE>")
    return df.select("key", "label", array_to_vector("a").alias("features"))


@pytest.fixture(scope="module")
def rings():
    """Two rings that no plane parts, with some labels turned over."""
    rng = np.random.default_rng(5)
    angle, y = rng.uniform(0, 2 * np.pi, 400), (rng.random(400) < 0.3).astype(float)
    x = (1 + y + rng.normal(0, 0.25, 400))[:, None] * np.c_[np.cos(angle), np.sin(angle)]
    return x, np.where(rng.random(400) < 0.04, 1 - y, y)


def projected(x, sign, cap, gamma, rounds=60000):
    """Dual value by projected gradient ascent, with nothing in common with the solver."""
    q = sign[:, None] * sign * svm.rbf(x, x, gamma)
    rate, alpha = 1 / np.linalg.eigvalsh(q)[-1], np.zeros(len(x))
    momentum, ahead = 1.0, alpha
    for _ in range(rounds // 20):
        goal = ahead + rate * (1 - q @ ahead)
        low, high = -1e4, 1e4
        for _ in range(60):  # the shift that balances the clipped point
            shift = (low + high) / 2
            point = np.clip(goal - shift * sign, 0, cap)
            low, high = (shift, high) if point @ sign > 0 else (low, shift)
        after = (1 + np.sqrt(1 + 4 * momentum**2)) / 2
        ahead, alpha, momentum = point + (momentum - 1) / after * (point - alpha), point, after
    return alpha.sum() - alpha @ q @ alpha / 2


@pytest.mark.parametrize("part_rows", [1000, 50])
def test_cascade_solves_the_whole_problem(spark, rings, part_rows):
    x, y = rings
    model = svm.KernelSvm(part_rows=part_rows, tolerance=1e-4, folds=2).fit(frame(spark, x, y))
    assert model.converged and model.gap <= 1e-4 and (model.n_passes > 1) == (part_rows == 50)
    sign = np.where(y == 1, 1.0, -1.0)
    cap = np.where(y == 1, 200 / y.sum(), 200 / (400 - y.sum()))
    assert model.gamma == pytest.approx(1 / (2 * x.var()))
    ids, own, bound, alpha = model.details.T
    assert (alpha > 0).all() and (alpha <= bound).all() and abs((alpha * own).sum()) < 1e-9
    weights = alpha * own
    dual = alpha.sum() - weights @ svm.rbf(model.vectors, model.vectors, model.gamma) @ weights / 2
    assert dual == pytest.approx(projected(x, sign, cap, model.gamma), rel=2e-4)
    # rows that have no multiplier are outside the margin, those below their bound on it
    apart = sign * model.margins(x)
    at = {tuple(v): (a, b) for v, a, b in zip(model.vectors, alpha, bound)}
    for row, gap in zip(x, apart):
        a, b = at.get(tuple(row), (0.0, 1.0))
        assert gap > 1 - 5e-3 if a == 0 else (gap < 1 + 5e-3 and (a >= b or gap > 1 - 5e-3))


def test_probabilities_follow_unseen_rows(spark, rings):
    x, y = rings
    model = svm.KernelSvm(part_rows=100).fit(frame(spark, x, y))
    scored = models.score(model, frame(spark, x, y), 2).toPandas()
    assert (scored["label"] == scored["predicted_label"]).mean() > 0.9
    assert abs(scored["probability"].mean() - y.mean()) < 0.03
    noise = np.random.default_rng(1).normal(size=(300, 20))
    unrelated = svm.KernelSvm().fit(frame(spark, noise, np.arange(300) % 3 == 0))
    chances = models.score(unrelated, frame(spark, noise, np.zeros(300))).toPandas()["probability"]
    assert chances.between(0.15, 0.55).all()  # nothing to learn: all near a third


def test_copies_and_order_change_nothing(spark, rings):
    x, y = rings
    once = svm.KernelSvm(folds=2, gamma=0.5, part_rows=100, tolerance=1e-5).fit(frame(spark, x, y))
    order = np.random.default_rng(2).permutation(800)
    twice = svm.KernelSvm(folds=2, gamma=0.5, part_rows=100, tolerance=1e-5, c=0.5).fit(frame(spark, np.r_[x, x][order], np.r_[y, y][order]).repartition(7))
    assert twice.n_rows == 400 and np.allclose(once.margins(x), twice.margins(x), atol=2e-2)


def test_bound_takes_both_classes(spark):
    rng = np.random.default_rng(8)
    y = np.arange(3000) % 100 == 0
    x = rng.normal(size=(3000, 3)) + 3 * y[:, None]
    model = svm.KernelSvm(most_rows=200, folds=2).fit(frame(spark, x, y))
    assert model.n_rows == 130  # all 30 of the rare class, 100 of the other
    chances = models.score(model, frame(spark, x, y)).toPandas()["probability"]
    # calibrated to the shares of all rows, not to those of the sample (30 of 130)
    assert abs(chances.mean() - 0.01) < 0.005
    assert (chances[y].to_numpy()[:, None] > chances[~y].to_numpy()).mean() > 0.99


def test_kernel_columns_give_way(monkeypatch, rings):
    x, y = rings
    sign, cap = np.where(y == 1, 1.0, -1.0), np.ones(400)
    whole = svm.solve_dual(x, sign, cap, np.zeros(400), 1.0, 1e-4)
    monkeypatch.setattr(svm, "KERNEL_BYTES", 5 * 8 * 400)
    few = svm.solve_dual(x, sign, cap, np.zeros(400), 1.0, 1e-4)
    assert np.array_equal(whole[0], few[0]) and whole[1] == few[1]


def test_odd_input(spark):
    schema = "label DOUBLE, a ARRAY<DOUBLE>"
    vector = F.when(F.col("a").isNotNull(), array_to_vector("a")).alias("features")
    for rows, chance in (([], 0.0), ([(1.0, [1.0]), (1.0, [2.0])], 1.0), ([(0.0, [1.0]), (None, [2.0]), (1.0, None)], 0.0)):
        model = svm.KernelSvm().fit(spark.createDataFrame(rows, schema).select("label", vector))
        assert model.chances(np.ones((3, max(1, model.dimension)))[:, : model.dimension or 1]).round(6).tolist() == [chance] * 3
    same = spark.createDataFrame([(float(i % 2), [1.0, 1.0]) for i in range(20)], schema).select("label", vector)
    assert np.allclose(svm.KernelSvm().fit(same).chances(np.ones((1, 2))), 0.5, atol=0.05)
    with pytest.raises(ValueError, match="two classes"):
        svm.KernelSvm().fit(spark.createDataFrame([(float(i), [1.0]) for i in range(3)], schema).select("label", vector))


def test_saved_cascade(spark, rings):
    x, y = rings
    model, path = svm.KernelSvm(folds=2).fit(frame(spark, x, y)), scratch(spark, "model")
    models.save_model(model, path)
    assert np.array_equal(models.load_model(path).chances(x), model.chances(x))


def test_large_problems_are_solved_by_sets(monkeypatch, rings):
    x, y = rings
    sign, cap = np.where(y == 1, 1.0, -1.0), np.ones(400)
    whole, bias = svm.solve_dual(x, sign, cap, np.zeros(400), 1.0, 1e-6)
    columns, plain = [], svm.kernel_sums
    monkeypatch.setattr(svm, "WORKING", 80)
    monkeypatch.setattr(svm, "kernel_sums", lambda x, vectors, *rest: columns.append(len(vectors)) or plain(x, vectors, *rest))
    alpha, same = svm.solve_dual(x, sign, cap, np.zeros(400), 1.0, 1e-6)
    assert max(columns) <= 80 and same == pytest.approx(bias, abs=1e-5)
    assert abs(alpha @ sign) < 1e-9 and ((alpha >= 0) & (alpha <= cap)).all()
    k = svm.rbf(x, x, 1.0)
    value = lambda a: a.sum() - (a * sign) @ k @ (a * sign) / 2
    assert value(alpha) == pytest.approx(value(whole), rel=1e-7)
    one, other = svm.solve_dual(x, np.ones(400), cap, np.zeros(400), 1.0, 1e-6)
    assert not one.any() and other == 1.0


def test_later_passes_hold_no_row_twice(spark, monkeypatch, rings):
    x, y = rings
    seen, plain = [], svm.KernelSvm._again

    def again(self, own, state, scored, tolerance):
        sizes = state.where("alpha > 0").groupBy("model").count().join(scored.where("missed").groupBy("model").agg(F.count("id").alias("more")), "model", "left")
        seen.extend((r["count"], r["more"] or 0) for r in sizes.collect())
        return plain(self, own, state, scored, tolerance)

    monkeypatch.setattr(svm.KernelSvm, "_again", again)
    model = svm.KernelSvm(folds=2, part_rows=25, tolerance=1e-6).fit(frame(spark, x, y))
    assert model.converged and model.gap <= 1e-6 and seen
    assert all(held + more <= 400 for held, more in seen) and len(set(model.details[:, 0])) == len(model.details)


def plain_margins(x, model):
    """Margins from the differences of the features."""
    apart = ((np.asarray(x)[:, None] - model.vectors) ** 2).sum(2)
    return np.exp(-model.gamma * apart) @ model.weights + model.bias


def test_working_sets_solve_the_whole_problem(spark, monkeypatch, rings):
    x, y = rings
    joined = svm.KernelSvm(part_rows=50, tolerance=1e-6, folds=2).fit(frame(spark, x, y))
    problems, plain = [], svm.solved_sets
    monkeypatch.setattr(svm, "JOINED", 100)
    monkeypatch.setattr(svm, "WORKING", 50)
    monkeypatch.setattr(svm, "SET", 90)
    monkeypatch.setattr(svm, "solved_sets", lambda held, some, *rest: problems.extend(len(p[1]) for p in some) or plain(held, some, *rest))
    model = svm.KernelSvm(part_rows=50, tolerance=1e-6, folds=2).fit(frame(spark, x, y))
    assert model.converged and model.gap <= 1e-6 and len(problems) > 4 and max(problems) <= 90
    sign, cap = np.where(y == 1, 1.0, -1.0), np.where(y == 1, 200 / y.sum(), 200 / (400 - y.sum()))
    alpha = model.details[:, 3]
    assert (alpha > 0).all() and (alpha <= model.details[:, 2]).all() and abs(model.weights.sum()) < 1e-9
    dual = alpha.sum() - model.weights @ svm.rbf(model.vectors, model.vectors, model.gamma) @ model.weights / 2
    assert dual == pytest.approx(projected(x, sign, cap, model.gamma), rel=2e-4)
    assert np.allclose(model.margins(x), joined.margins(x), atol=5e-3) and np.allclose(model.margins(x), plain_margins(x, model), atol=1e-9)
    assert np.allclose(model.chances(x), joined.chances(x), atol=5e-3)


def test_working_sets_of_odd_folds(spark, monkeypatch):
    """A model that sees one class only, and copies of rows, some with both classes."""
    monkeypatch.setattr(svm, "JOINED", 10)
    rng = np.random.default_rng(4)
    x, y = rng.normal(size=(60, 2)), np.arange(60) == 7
    lone = svm.KernelSvm(folds=2).fit(frame(spark, x, y))
    assert lone.converged and lone.n_rows == 60 and lone.margins(x).argmax() == 7
    x, y = np.repeat(x, 3, axis=0), np.tile([0.0, 0.0, 1.0], 60)
    mixed = svm.KernelSvm(folds=2).fit(frame(spark, x, y))
    assert mixed.converged and mixed.n_rows == 120 and mixed.details[:, 2].sum() == pytest.approx(180)
    assert np.allclose(mixed.chances(x), 1 / 3, atol=0.05)


def test_support_table_and_margins(spark, rings):
    x, y = rings
    model = svm.KernelSvm(folds=2).fit(frame(spark, x, y))
    table = svm.support_table(spark, model)
    assert table.dtypes == [("support", "bigint"), ("y", "double"), ("cap", "double"), ("alpha", "double"), ("x", "array<double>")]
    rows = table.toPandas()
    assert np.array_equal(np.stack(rows["x"].to_numpy()), model.vectors) and np.array_equal(rows[["y", "cap", "alpha"]].to_numpy(), model.details[:, 1:])
    found = svm.with_margins(spark.createDataFrame([(i, [float(v) for v in a]) for i, a in enumerate(x)], "key BIGINT, x ARRAY<DOUBLE>"), model).toPandas().sort_values("key")
    assert np.allclose(found["f"], plain_margins(x, model), atol=1e-9)
    empty = svm.KernelSvm().fit(frame(spark, x, y).limit(0))
    assert svm.support_table(spark, empty).count() == 0


def test_every_row_is_fitted(spark):
    rng = np.random.default_rng(8)
    y = np.arange(12000) % 100 == 0
    x = rng.normal(size=(12000, 2)) + 3 * y[:, None]
    model = svm.KernelSvm(folds=2).fit(frame(spark, x, y))
    assert model.n_rows == 12000 and model.converged
    # the gap over all rows, from the support vectors alone
    sign, cap = np.where(y, 1.0, -1.0), np.where(y, 6000 / y.sum(), 6000 / (~y).sum())
    length = model.weights @ (svm.kernel_sums(model.vectors, model.vectors, model.weights[:, None], model.gamma)[:, 0])
    dual, loss = np.abs(model.weights).sum() - length / 2, cap @ np.maximum(0, 1 - sign * model.margins(x))
    assert length / 2 + loss - dual <= 1.01e-3 * dual
