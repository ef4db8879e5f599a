"""Evaluation figures over the score table."""

from __future__ import annotations

from pyspark.sql import functions as F

from trigwatch.operators import metrics
from trigwatch.plans.registry import query
from trigwatch.plans.tables import predictions, rounded, scores, scratch, with_ctes

CELLS = """c AS (SELECT count(*) FILTER (label = 0 AND score <= 0.1) AS tn, count(*) FILTER (label = 0 AND score > 0.1) AS fp,
  count(*) FILTER (label = 1 AND score <= 0.1) AS fn, count(*) FILTER (label = 1 AND score > 0.1) AS tp FROM scores)"""


@query("confusion", with_ctes("scores", f"WITH {CELLS} SELECT tn, fp, fn, tp FROM c"))
def confusion(spark, sf):
    return metrics.confusion(predictions(spark, sf))


@query(
    "prediction_summary",
    with_ctes("scores", """
SELECT count(*) FILTER (score > 0.1) AS predicted_attack, count(*) FILTER (score <= 0.1) AS predicted_normal,
  count(*) FILTER (label = 1) AS actual_attack, count(*) FILTER (label = 0) AS actual_normal FROM scores"""),
)
def prediction_summary(spark, sf):
    return metrics.prediction_summary(predictions(spark, sf))


@query(
    "binary_metrics",
    with_ctes("scores", f"""
WITH {CELLS} SELECT round((tn + tp) / (tn + fp + fn + tp), 6) AS accuracy, round(tp / (tp + fp), 6) AS precision, round(tp / (tp + fn), 6) AS recall,
  round(2 * tp / (2 * tp + fp + fn), 6) AS f1 FROM c"""),
)
def binary_metrics(spark, sf):
    return rounded(metrics.binary_metrics(predictions(spark, sf)), "accuracy", "precision", "recall", "f1")


@query(
    "binary_metrics_one_class",
    with_ctes("scores", """
WITH c AS (SELECT count(*) FILTER (score <= 0.1) AS tn, count(*) FILTER (score > 0.1) AS fp FROM scores WHERE label = 0)
SELECT round(tn / (tn + fp), 6) AS accuracy, 0.5::DOUBLE AS precision, round(tn / (tn + fp) / 2, 6) AS recall, round(2 * tn / (2 * tn + fp) / 2, 6) AS f1 FROM c"""),
)
def binary_metrics_one_class(spark, sf):
    return rounded(metrics.binary_metrics(predictions(spark, sf).where("label = 0")), "accuracy", "precision", "recall", "f1")


@query(
    "class_report",
    with_ctes("scores", f"""
WITH {CELLS}, r AS (SELECT 'normal' AS class, tn / (tn + fn) AS precision, tn / (tn + fp) AS recall, 2 * tn / (2 * tn + fn + fp) AS f1, tn + fp AS support FROM c
  UNION ALL SELECT 'attack', tp / (tp + fp), tp / (tp + fn), 2 * tp / (2 * tp + fp + fn), tp + fn FROM c),
a AS (SELECT * FROM r UNION ALL SELECT 'macro avg', avg(precision), avg(recall), avg(f1), sum(support) FROM r
  UNION ALL SELECT 'weighted avg', sum(precision * support) / sum(support), sum(recall * support) / sum(support), sum(f1 * support) / sum(support), sum(support) FROM r)
SELECT class, round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1, CAST(support AS BIGINT) AS support FROM a"""),
)
def class_report(spark, sf):
    return rounded(metrics.class_report(predictions(spark, sf)), "precision", "recall", "f1")


AUC_SQL = "sum(neg * (tp - pos) + 0.5 * pos * neg) / (max(p) * max(n))"
AP_SQL = "sum(pos / p * tp / (tp + fp))"
TRAP_SQL = "sum(pos / p * (tp / (tp + fp) + CASE WHEN tp + fp - pos - neg > 0 THEN (tp - pos) / (tp + fp - pos - neg) ELSE 1 END) / 2)"


@query(
    "roc_auc",
    with_ctes("scores", """
WITH r AS (SELECT label, rank() OVER (ORDER BY score) + (count(*) OVER (PARTITION BY score) - 1) / 2 AS rk FROM scores)
SELECT round((sum(rk) FILTER (label = 1) - (count(*) FILTER (label = 1)) * (count(*) FILTER (label = 1) + 1) / 2)
  / ((count(*) FILTER (label = 1)) * (count(*) FILTER (label = 0))), 6) AS roc_auc FROM r"""),
)
def roc_auc(spark, sf):
    return rounded(metrics.roc_auc(scores(spark, sf)), "roc_auc")


@query("average_precision", with_ctes("pts", f"SELECT round({AP_SQL}, 6) AS average_precision FROM pts"))
def average_precision(spark, sf):
    return rounded(metrics.average_precision(scores(spark, sf)), "average_precision")


@query("pr_auc_trapezoid", with_ctes("pts", f"SELECT round({TRAP_SQL}, 6) AS pr_auc FROM pts WHERE tp < p OR pos > 0"))
def pr_auc_trapezoid(spark, sf):
    return rounded(metrics.pr_auc_trapezoid(scores(spark, sf)), "pr_auc")


@query(
    "pr_curve",
    with_ctes("pts", """
SELECT score AS threshold, round(tp / (tp + fp), 6) AS precision, round(tp / p, 6) AS recall FROM pts WHERE tp < p OR pos > 0
UNION ALL SELECT 1.0, 1.0, 0.0"""),
)
def pr_curve(spark, sf):
    return rounded(metrics.pr_curve(scores(spark, sf)), "precision", "recall")


@query(
    "roc_curve",
    with_ctes("pts", """
WITH nx AS (SELECT *, lead(pos) OVER (ORDER BY place) AS npos, lead(neg) OVER (ORDER BY place) AS nneg FROM pts)
SELECT score AS threshold, round(fp / n, 6) AS fpr, round(tp / p, 6) AS tpr FROM nx WHERE place = 1 OR npos IS NULL OR npos <> pos OR nneg <> neg
UNION ALL SELECT max(score) + 1, 0.0, 0.0 FROM scores"""),
)
def roc_curve(spark, sf):
    return rounded(metrics.roc_curve(scores(spark, sf)), "fpr", "tpr")


@query(
    "best_f1_threshold",
    with_ctes("pts", """
SELECT score AS threshold, round(tp / (tp + fp), 6) AS precision, round(tp / p, 6) AS recall, round(2 * tp / (p + tp + fp), 6) AS f1
FROM pts WHERE tp < p OR pos > 0 ORDER BY round(2 * tp / (p + tp + fp), 12) DESC, score LIMIT 1"""),
)
def best_f1_threshold(spark, sf):
    return rounded(metrics.best_f1_threshold(scores(spark, sf)), "precision", "recall", "f1")


@query(
    "gains_lift",
    with_ctes("scores", """
WITH o AS (SELECT event_id, row_number() OVER w AS position, sum(label) OVER w AS hits, count(*) OVER () AS n, sum(label) OVER () AS p
  FROM scores WINDOW w AS (ORDER BY score DESC, event_id ROWS UNBOUNDED PRECEDING))
SELECT event_id, position, round(position / n, 6) AS share_rows, round(hits / p, 6) AS share_positives, round((hits / p) / (position / n), 6) AS lift FROM o"""),
)
def gains_lift(spark, sf):
    return rounded(metrics.gains_lift(scores(spark, sf), "event_id"), "share_rows", "share_positives", "lift")


@query(
    "calibration_bins",
    with_ctes("scores", """
SELECT CAST(floor(score * 10 / 1.00000001) AS BIGINT) AS bin, round(avg(score), 6) AS mean_score, round(avg(label), 6) AS share_positive, count(*) AS n
FROM scores GROUP BY 1"""),
)
def calibration_bins(spark, sf):
    return rounded(metrics.calibration_bins(scores(spark, sf)), "mean_score", "share_positive")


@query(
    "score_stats",
    with_ctes("scores", """
SELECT min(score) AS min_score, max(score) AS max_score, round(avg(score), 6) AS mean_score, round(stddev_pop(score), 6) AS std_score,
  CASE WHEN max(score) < 0.1 THEN 1 ELSE 0 END AS biased_normal, CASE WHEN min(score) > 0.9 THEN 1 ELSE 0 END AS biased_attack FROM scores"""),
)
def score_stats(spark, sf):
    return rounded(metrics.score_stats(scores(spark, sf)), "mean_score", "std_score")


def fold_scores(spark, sf):
    """Per user and event type the mean scores, as if users were candidates and types folds."""
    from trigwatch.plans.tables import table

    e = table(spark, sf, "events")
    return e.groupBy(F.col("user_id").alias("candidate"), F.col("event_type").alias("fold")).agg(
        (F.max("value") / 1000).alias("roc_auc"), (F.min("value") / 1000).alias("average_precision")
    )


FOLDS = """f AS (SELECT user_id AS candidate, event_type AS fold, max(value) / 1000 AS roc, min(value) / 1000 AS ap FROM events GROUP BY 1, 2),
s AS (SELECT candidate, avg(roc) AS r, avg(ap) AS a FROM f GROUP BY 1)"""


@query(
    "search_scores",
    f"""WITH {FOLDS} SELECT candidate, round(r, 6) AS mean_roc_auc, round(a, 6) AS mean_average_precision, round(0.6 * r + 0.4 * a, 6) AS composite_score FROM s""",
)
def search_scores(spark, sf):
    found = metrics.search_scores(fold_scores(spark, sf), {"roc_auc": 0.6, "average_precision": 0.4})
    return rounded(found, "mean_roc_auc", "mean_average_precision", "composite_score")


@query("search_rank", f"WITH {FOLDS} SELECT candidate, round(0.6 * r + 0.4 * a, 6) AS composite_score FROM s ORDER BY 2 DESC, 1 LIMIT 10")
def search_rank(spark, sf):
    found = rounded(metrics.search_scores(fold_scores(spark, sf), {"roc_auc": 0.6, "average_precision": 0.4}), "composite_score")
    return metrics.search_rank(found, 10).select("candidate", "composite_score")


@query(
    "search_ranks",
    f"""WITH {FOLDS}, w AS (SELECT candidate, round(r, 6) AS r, round(a, 6) AS a, round(0.6 * r + 0.4 * a, 6) AS c FROM s)
SELECT candidate, r AS mean_roc_auc, a AS mean_average_precision, c AS composite_score, CAST(rank() OVER (ORDER BY r DESC) AS INTEGER) AS rank_roc_auc,
  CAST(rank() OVER (ORDER BY a DESC) AS INTEGER) AS rank_average_precision, CAST(rank() OVER (ORDER BY c DESC) AS INTEGER) AS rank_composite_score FROM w""",
)
def search_ranks(spark, sf):
    weights = {"roc_auc": 0.6, "average_precision": 0.4}
    found = metrics.search_scores(fold_scores(spark, sf), weights)
    return metrics.search_ranks(rounded(found, "mean_roc_auc", "mean_average_precision", "composite_score"), weights)


EVALUATE = f"""
WITH c AS (SELECT count(*) FILTER (label = 0 AND score <= 0.1) AS tn, count(*) FILTER (label = 0 AND score > 0.1) AS fp,
  count(*) FILTER (label = 1 AND score <= 0.1) AS fn, count(*) FILTER (label = 1 AND score > 0.1) AS tp FROM scores),
wide AS (SELECT tn::DOUBLE AS tn, fp::DOUBLE AS fp, fn::DOUBLE AS fn, tp::DOUBLE AS tp, (tn + tp) / (tn + fp + fn + tp) AS accuracy, tp / (tp + fp) AS precision,
  tp / (tp + fn) AS recall, 2 * tp / (2 * tp + fp + fn) AS f1, (SELECT {AUC_SQL} FROM pts) AS roc_auc, (SELECT {AP_SQL} FROM pts) AS average_precision,
  (SELECT {TRAP_SQL} FROM pts WHERE tp < p OR pos > 0) AS pr_auc FROM c)
SELECT name AS metric, round(value, 6) AS value FROM (UNPIVOT wide ON COLUMNS(*) INTO NAME name VALUE value)"""


@query("evaluate", with_ctes("pts", EVALUATE))
def evaluate(spark, sf):
    return rounded(metrics.evaluate(scores(spark, sf), 0.1), "value")


@query("eval_tables", with_ctes("pts", EVALUATE))
def eval_tables(spark, sf):
    from trigwatch.operators.store import save_table

    path = scratch(spark, "report")
    save_table(metrics.evaluate(scores(spark, sf), 0.1), path)
    return rounded(spark.read.parquet(path), "value")
