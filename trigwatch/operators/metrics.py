"""Evaluation of scored rows. ``scores``: a unique key, ``label`` 0/1 and ``score`` in [0, 1].

Curves work on the distinct scores: rows are first counted per score (map-side combined,
so a score shared by most rows is one row), then running totals are taken over
range-partitioned slices. No step sorts all rows in one task.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from trigwatch.functions.ordering import running_totals
from trigwatch.session import checked_broadcast


def label_distribution(df: DataFrame, label: str = "label") -> DataFrame:
    return df.groupBy(label).agg(F.count(F.lit(1)).alias("n"))


def prediction_summary(df: DataFrame) -> DataFrame:
    """Predicted against actual counts per class."""
    return df.agg(
        F.count_if(F.col("prediction") == 1).alias("predicted_attack"),
        F.count_if(F.col("prediction") == 0).alias("predicted_normal"),
        F.count_if(F.col("label") == 1).alias("actual_attack"),
        F.count_if(F.col("label") == 0).alias("actual_normal"),
    )


def confusion(df: DataFrame) -> DataFrame:
    y, p = F.col("label"), F.col("prediction")
    return df.agg(
        F.count_if((y == 0) & (p == 0)).alias("tn"),
        F.count_if((y == 0) & (p == 1)).alias("fp"),
        F.count_if((y == 1) & (p == 0)).alias("fn"),
        F.count_if((y == 1) & (p == 1)).alias("tp"),
    )


def ratio(top, bottom):
    """0 where the denominator is 0."""
    return F.when(bottom != 0, top / bottom).otherwise(F.lit(0.0))


def _f1(precision, recall):
    return ratio(2 * precision * recall, precision + recall)


def binary_metrics(df: DataFrame) -> DataFrame:
    """Accuracy, precision, recall, F1 of class 1; the mean over the occurring classes if the
    truth has only one."""
    tn, fp, fn, tp = (F.col(c) for c in ("tn", "fp", "fn", "tp"))
    n = tn + fp + fn + tp
    per_class = confusion(df).withColumns(
        {
            "p1": ratio(tp, tp + fp), "r1": ratio(tp, tp + fn),
            "p0": ratio(tn, tn + fn), "r0": ratio(tn, tn + fp),
        }
    )
    per_class = per_class.withColumns({"f1_1": _f1(F.col("p1"), F.col("r1")), "f1_0": _f1(F.col("p0"), F.col("r0"))})
    one_class = ((tp + fn) == 0) | ((tn + fp) == 0)
    has0 = F.when((tn + fp + fn) > 0, 1).otherwise(0)
    has1 = F.when((tp + fn + fp) > 0, 1).otherwise(0)

    def pick(positive: str, negative: str):
        macro = ratio(F.col(positive) * has1 + F.col(negative) * has0, has0 + has1)
        return F.when(one_class, macro).otherwise(F.col(positive))

    return per_class.select(
        ratio(tn + tp, n).alias("accuracy"),
        pick("p1", "p0").alias("precision"),
        pick("r1", "r0").alias("recall"),
        pick("f1_1", "f1_0").alias("f1"),
    )


def class_report(df: DataFrame) -> DataFrame:
    """Precision, recall, F1 and support per class, with macro and weighted means."""
    cells = confusion(df)
    tn, fp, fn, tp = (F.col(c) for c in ("tn", "fp", "fn", "tp"))
    rows = cells.select(
        F.explode(
            F.array(
                F.struct(F.lit("normal").alias("class"), tn.alias("hit"), (tn + fn).alias("named"), (tn + fp).alias("support")),
                F.struct(F.lit("attack").alias("class"), tp.alias("hit"), (tp + fp).alias("named"), (tp + fn).alias("support")),
            )
        ).alias("c")
    ).select("c.*")
    scored = rows.select(
        "class", ratio(F.col("hit"), F.col("named")).alias("precision"), ratio(F.col("hit"), F.col("support")).alias("recall"), "support"
    ).withColumn("f1", _f1(F.col("precision"), F.col("recall")))
    names = ["precision", "recall", "f1"]
    macro = scored.agg(*[F.avg(c).alias(c) for c in names], F.sum("support").alias("support")).withColumn("class", F.lit("macro avg"))
    weighted = scored.agg(
        *[ratio(F.sum(F.col(c) * F.col("support")), F.sum("support")).alias(c) for c in names], F.sum("support").alias("support")
    ).withColumn("class", F.lit("weighted avg"))
    return scored.unionByName(macro).unionByName(weighted)


def score_points(scores: DataFrame) -> DataFrame:
    """Per distinct score, highest first: its positives and negatives, and both running totals."""
    per_score = scores.groupBy("score").agg(
        F.sum("label").cast("bigint").alias("pos"), F.sum(1 - F.col("label")).cast("bigint").alias("neg")
    )
    return running_totals(
        per_score, [F.desc("score")], {"tp": F.col("pos"), "fp": F.col("neg"), "place": F.lit(1)}, grand={"p": "tp", "n": "fp"}
    )


def roc_auc(scores: DataFrame) -> DataFrame:
    """Share of (positive, negative) pairs in the right order, ties half; null if one class."""
    pairs = F.col("neg") * (F.col("tp") - F.col("pos")).cast("double") + F.col("pos") * F.col("neg") * 0.5
    area = F.sum(pairs) / (F.max("p") * F.max("n").cast("double"))
    return score_points(scores).agg(F.when((F.max("p") > 0) & (F.max("n") > 0), area).alias("roc_auc"))


def average_precision(scores: DataFrame) -> DataFrame:
    """Sum of precision weighted by the recall gained at each distinct score."""
    step = F.col("pos") / F.col("p") * F.col("tp") / (F.col("tp") + F.col("fp"))
    return score_points(scores).agg(F.sum(step).alias("average_precision"))


def _to_full_recall(points: DataFrame) -> DataFrame:
    """Points up to and including the first that reaches all positives."""
    return points.where((F.col("tp") < F.col("p")) | (F.col("pos") > 0))


def pr_curve(scores: DataFrame) -> DataFrame:
    """Precision and recall at each distinct score, ending with (1, 0) at threshold 1."""
    kept = _to_full_recall(score_points(scores)).select(
        F.col("score").alias("threshold"),
        (F.col("tp") / (F.col("tp") + F.col("fp"))).alias("precision"),
        (F.col("tp") / F.col("p")).alias("recall"),
    )
    end = scores.sparkSession.range(1).select(
        F.lit(1.0).alias("threshold"), F.lit(1.0).alias("precision"), F.lit(0.0).alias("recall")
    )
    return kept.unionByName(end)


def pr_auc_trapezoid(scores: DataFrame) -> DataFrame:
    """Area under the piecewise linear PR curve. The point before a score is its running
    totals without itself; before the first it is precision 1 at recall 0."""
    tp, fp, pos, neg = (F.col(c) for c in ("tp", "fp", "pos", "neg"))
    before = F.when(tp + fp - pos - neg > 0, (tp - pos) / (tp + fp - pos - neg)).otherwise(F.lit(1.0))
    strip = pos / F.col("p") * (tp / (tp + fp) + before) / 2
    return _to_full_recall(score_points(scores)).agg(F.sum(strip).alias("pr_auc"))


def best_f1_threshold(scores: DataFrame) -> DataFrame:
    """Lowest threshold among those with the highest F1."""
    points = pr_curve(scores).where("recall > 0 OR threshold < 1")
    f1 = _f1(F.col("precision"), F.col("recall"))
    # rounding makes equal F1 values equal on every platform before the tie-break
    return points.withColumn("f1", F.round(f1, 12)).orderBy(F.desc("f1"), "threshold").limit(1)


def roc_curve(scores: DataFrame) -> DataFrame:
    """Corner points of the ROC curve: scores between two equal steps are left out; starts at (0, 0).

    A point's neighbour is found by an equi join on its place, not by a global lag.
    """
    points = score_points(scores)
    following = points.select((F.col("place") - 1).alias("place"), F.col("pos").alias("next_pos"), F.col("neg").alias("next_neg"))
    kept = (
        points.join(following, "place", "left")
        .where(
            (F.col("place") == 1)
            | F.col("next_pos").isNull()
            | (F.col("next_pos") != F.col("pos"))
            | (F.col("next_neg") != F.col("neg"))
        )
        .select(
            F.col("score").alias("threshold"),
            (F.col("fp") / F.col("n")).alias("fpr"),
            (F.col("tp") / F.col("p")).alias("tpr"),
        )
    )
    origin = points.where("place = 1").select((F.col("score") + 1).alias("threshold"), F.lit(0.0).alias("fpr"), F.lit(0.0).alias("tpr"))
    return kept.unionByName(origin)


def gains_lift(scores: DataFrame, key: str) -> DataFrame:
    """Per row by descending score (ties by key): share of rows, share of positives, lift."""
    ordered = running_totals(
        scores.select(key, "label", "score"),
        [F.desc("score"), F.col(key)],
        {"position": F.lit(1), "hits": F.col("label")},
        grand={"rows": "position", "positives": "hits"},
    )
    share = F.col("position") / F.col("rows")
    gained = F.col("hits") / F.greatest(F.col("positives"), F.lit(1))
    return ordered.select(
        key, "position", share.alias("share_rows"), gained.alias("share_positives"), (gained / share).alias("lift")
    )


# Fixed value: the last bin's edge lies this far above 1, so that a score of 1 is inside.
BIN_SLACK = 1e-8


def calibration_bins(scores: DataFrame, bins: int = 10) -> DataFrame:
    """Mean score and share of positives per non-empty uniform bin."""
    number = F.floor(F.col("score") * bins / (1.0 + BIN_SLACK)).cast("bigint")
    return scores.groupBy(number.alias("bin")).agg(
        F.avg("score").alias("mean_score"), F.avg(F.col("label").cast("double")).alias("share_positive"), F.count(F.lit(1)).alias("n")
    )


def score_stats(scores: DataFrame) -> DataFrame:
    """Range, mean and deviation of the scores, with flags for a one-sided model."""
    return scores.agg(
        F.min("score").alias("min_score"),
        F.max("score").alias("max_score"),
        F.avg("score").alias("mean_score"),
        F.stddev_pop("score").alias("std_score"),
        F.when(F.max("score") < 0.1, 1).otherwise(0).alias("biased_normal"),
        F.when(F.min("score") > 0.9, 1).otherwise(0).alias("biased_attack"),
    )


def curves_by(scores: DataFrame, groups: Sequence[str]) -> DataFrame:
    """ROC AUC and average precision of every group of ``label, score`` rows, from one scan.

    Equal scores of a group are added up first; then all groups lie behind each other in one
    range-sorted order with one running total, from which each group's start is taken off. So a
    group may be of any size, and many groups cost no more than one.
    """
    points = scores.groupBy(*groups, "score").agg(F.count_if(F.col("label") == 1).alias("pos"), F.count_if(F.col("label") != 1).alias("neg"))
    order = [*[F.col(g) for g in groups], F.desc("score")]
    placed = running_totals(points, order, {"_pos": F.col("pos"), "_neg": F.col("neg")})
    starts = placed.groupBy(*groups).agg(
        F.min(F.col("_pos") - F.col("pos")).alias("_pos0"), F.min(F.col("_neg") - F.col("neg")).alias("_neg0"), F.sum("pos").alias("p"), F.sum("neg").alias("n")
    )
    points = placed.join(checked_broadcast(starts), list(groups))
    tp, fp = F.col("_pos") - F.col("_pos0"), F.col("_neg") - F.col("_neg0")
    pairs = F.col("neg") * (tp - F.col("pos")).cast("double") + F.col("pos") * F.col("neg") * 0.5
    step = F.col("pos") / F.col("p") * tp / (tp + fp)
    return points.groupBy(*groups).agg(
        (F.sum(pairs) / (F.max("p") * F.max("n").cast("double"))).alias("roc_auc"), F.sum(step).alias("average_precision")
    )


def search_scores(folds: DataFrame, weights: dict[str, float], spread: bool = False) -> DataFrame:
    """Mean score over folds per candidate and metric (with ``spread`` the standard deviation too),
    and their weighted sum."""
    figures = [F.avg(m).alias(f"mean_{m}") for m in weights] + [F.stddev_pop(m).alias(f"std_{m}") for m in weights if spread]
    mean_rows = folds.groupBy("candidate").agg(*figures)
    composite = sum((F.lit(w) * F.col(f"mean_{m}") for m, w in weights.items()), F.lit(0.0))
    return mean_rows.withColumn("composite_score", composite)


def search_rank(candidates: DataFrame, top: int | None = None) -> DataFrame:
    """Candidates of a search, best first; with ``top`` only so many. Candidates are as few as the settings tried."""
    ranked = candidates.orderBy(F.desc("composite_score"), "candidate")
    return ranked if top is None else ranked.limit(top)


def search_ranks(scores: DataFrame, weights: Mapping[str, float]) -> DataFrame:
    """``search_scores`` with the rank of each candidate by every metric and by the weighted sum
    (1 is best, equal scores share a rank)."""
    names = [*[f"mean_{m}" for m in weights], "composite_score"]
    return scores.withColumns({f"rank_{n.removeprefix('mean_')}": F.rank().over(Window.orderBy(F.desc(n))) for n in names})


def evaluate(scores: DataFrame, threshold: float = 0.5) -> DataFrame:
    """The whole report as ``metric, value`` rows.

    The points per distinct score are computed once and serve all curve figures.
    """
    labelled = scores.withColumn("prediction", (F.col("score") > threshold).cast("int"))
    cells = confusion(labelled)
    tn, fp, fn, tp = (F.col(c) for c in ("tn", "fp", "fn", "tp"))
    precision, recall = ratio(tp, tp + fp), ratio(tp, tp + fn)
    basic = cells.select(
        *[F.col(c).cast("double").alias(c) for c in ("tn", "fp", "fn", "tp")],
        ratio(tn + tp, tn + fp + fn + tp).alias("accuracy"),
        precision.alias("precision"),
        recall.alias("recall"),
        _f1(precision, recall).alias("f1"),
    )
    points = score_points(scores)
    pos, neg, ctp, cfp = (F.col(c) for c in ("pos", "neg", "tp", "fp"))
    pairs = neg * (ctp - pos).cast("double") + pos * neg * 0.5
    step = pos / F.col("p") * ctp / (ctp + cfp)
    before = F.when(ctp + cfp - pos - neg > 0, (ctp - pos) / (ctp + cfp - pos - neg)).otherwise(F.lit(1.0))
    strip = pos / F.col("p") * (ctp / (ctp + cfp) + before) / 2
    curves = points.agg(
        (F.sum(pairs) / (F.max("p") * F.max("n").cast("double"))).alias("roc_auc"),
        F.sum(step).alias("average_precision"),
        F.sum(strip).alias("pr_auc"),
    )
    long = [t.unpivot([], list(t.columns), "metric", "value") for t in (basic, curves)]
    return long[0].unionByName(long[1])
