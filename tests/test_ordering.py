"""Global ranks against brute force, with one group holding most rows."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from trigwatch.functions.ordering import exact_percentile_by, ranked_within, running_totals
from trigwatch.operators import metrics, sampling


def skewed(spark, n=500):
    rng = np.random.default_rng(1)
    group = np.where(rng.random(n) < 0.7, 0, rng.integers(1, 4, n))
    value = np.round(rng.random(n), 1)  # many ties
    frame = pd.DataFrame({"key": np.arange(n), "g": group, "v": value})
    return frame, spark.createDataFrame(frame)


def test_running_totals(spark):
    frame, df = skewed(spark)
    got = running_totals(df, [F.desc("v"), F.col("key")], {"n": F.lit(1), "s": F.col("g")}, slices=7).toPandas().sort_values("key")
    ordered = frame.sort_values(["v", "key"], ascending=[False, True])
    ordered["n"], ordered["s"] = np.arange(1, len(frame) + 1), ordered["g"].cumsum()
    want = ordered.sort_values("key")
    assert (got["n"].to_numpy() == want["n"].to_numpy()).all() and (got["s"].to_numpy() == want["s"].to_numpy()).all()


def test_ranked_within(spark):
    frame, df = skewed(spark)
    got = ranked_within(df, "g", [F.col("v"), F.col("key")]).toPandas().sort_values("key")
    want = frame.sort_values(["v", "key"]).groupby("g").cumcount().sort_index() + 1
    assert (got["rank"].to_numpy() == want.to_numpy()).all()
    assert (got["group_size"].to_numpy() == frame.groupby("g")["key"].transform("size").to_numpy()).all()


def test_exact_percentile(spark):
    frame, df = skewed(spark)
    for q in (0.0, 0.5, 0.95, 1.0):
        got = {r["g"]: r["threshold"] for r in exact_percentile_by(df, "g", "v", "key", q).collect()}
        for g, part in frame.groupby("g"):
            assert abs(got[g] - np.percentile(part["v"], q * 100)) < 1e-12


def test_percentile_of_a_single_row(spark):
    df = spark.createDataFrame([(1, 5, 2.5)], "key INT, g INT, v DOUBLE")
    assert exact_percentile_by(df, "g", "v", "key", 0.95).first()["threshold"] == 2.5


def test_split_and_folds_are_balanced_and_repeatable(spark):
    frame, df = skewed(spark)
    df = df.withColumn("label", (F.col("g") == 0).cast("int"))
    split = sampling.stratified_split(df, "label", "key").toPandas()
    for _, part in split.groupby("label"):
        assert (part["split"] == "test").sum() == round(len(part) * 0.2)
    again = sampling.stratified_split(df.repartition(3), "label", "key").toPandas()
    assert set(split.loc[split["split"] == "test", "key"]) == set(again.loc[again["split"] == "test", "key"])
    folds = sampling.stratified_folds(df, "label", "key", 5).toPandas()
    sizes = folds.groupby(["label", "fold"]).size().groupby("label")
    assert (sizes.max() - sizes.min()).max() <= 1


def test_curves_on_a_hand_case(spark):
    rows = [(1, 1, 0.9), (2, 0, 0.8), (3, 1, 0.8), (4, 0, 0.3), (5, 1, 0.2), (6, 0, 0.1)]
    scores = spark.createDataFrame(rows, "key INT, label INT, score DOUBLE")
    assert abs(metrics.roc_auc(scores).first()[0] - (3 + 2.5 + 1) / 9) < 1e-12
    steps = 1 / 3 * 1 + 1 / 3 * 2 / 3 + 1 / 3 * 3 / 5
    assert abs(metrics.average_precision(scores).first()[0] - steps) < 1e-12
    curve = {(round(r.threshold, 3), round(r.precision, 6), round(r.recall, 6)) for r in metrics.pr_curve(scores).collect()}
    assert curve == {(0.9, 1.0, 0.333333), (0.8, 0.666667, 0.666667), (0.3, 0.5, 0.666667), (0.2, 0.6, 1.0), (1.0, 1.0, 0.0)}
    assert metrics.best_f1_threshold(scores).first().threshold == 0.2
    one_class = scores.where("label = 1")
    assert metrics.roc_auc(one_class).first()[0] is None


def test_calibration_edges(spark):
    scores = spark.createDataFrame([(1, 0.3), (0, 0.31), (1, 1.0), (0, 0.0)], "label INT, score DOUBLE")
    got = {r.bin: r.n for r in metrics.calibration_bins(scores).collect()}
    assert got == {0: 1, 2: 1, 3: 1, 9: 1}
