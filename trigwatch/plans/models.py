"""Fitting, scoring, searching, comparing and explaining models.

Fits have no SQL counterpart (their results are checked as invariants in the tests); the
parts that are plain aggregates have one.
"""

from __future__ import annotations

from functools import reduce

from pyspark.ml import PipelineModel
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import functions as F

from trigwatch.functions import timing
from trigwatch.operators import anomaly, explain, metrics, models, sampling, svm, vectors
from trigwatch.operators.store import save_table
from trigwatch.plans.registry import query
from trigwatch.plans.tables import catalog, embeddings, embeddings_long, rounded, scratch, telemetry, wid, with_ctes
from trigwatch.plans.vectors import used_families, window_vectors
from trigwatch.session import cut_lineage

DIMENSION = 64
#: rows that a task compares with all support vectors
PAIRED_ROWS = 1000


def labelled_vectors(spark, sf):
    """Vectors with class 1 = cluster 3."""
    e = embeddings(spark, sf)
    return e.select("vec_id", (F.col("cluster") == 3).cast("double").alias("label"), array_to_vector(F.col("features")).alias("features"))


def split(spark, sf):
    parts = sampling.stratified_split(labelled_vectors(spark, sf), "label", "vec_id")
    return parts.where("split = 'train'").drop("split"), parts


def scored(model, rows):
    out = models.score(model, rows, DIMENSION)
    return out.select("vec_id", "split", F.col("label").cast("int").alias("label"), "predicted_label", "probability")


def _pipeline_query(name, build):
    @query(name)
    def run(spark, sf):
        train, everything = split(spark, sf)
        return scored(models.fit_classifier(build(train), train), everything)

    return run


_pipeline_query("fit_random_forest", lambda train: models.random_forest())
_pipeline_query("fit_decision_tree", lambda train: models.decision_tree())
_pipeline_query("fit_gbt", lambda train: models.gradient_boosting())
_pipeline_query("fit_logistic", lambda train: models.logistic(train.count()))
_pipeline_query("fit_naive_bayes", lambda train: models.naive_bayes())


def _object_query(name, build):
    @query(name)
    def run(spark, sf):
        train, everything = split(spark, sf)
        return scored(build().fit(train), everything)

    return run


_object_query("fit_svm", svm.KernelSvm)
_object_query("fit_svm_fourier", models.FourierSvm)
_object_query("fit_adaboost", models.AdaBoost)
_object_query("fit_extra_trees", models.ExtraTrees)


@query(
    "svm_optimality",
    """SELECT count(*) AS n_rows, CAST(0 AS BIGINT) AS outside_box, true AS balanced, CAST(0 AS BIGINT) AS conditions_broken, true AS gap_closed
FROM embeddings""",
)
def svm_optimality(spark, sf):
    """What makes multipliers the solution of the dual problem: they lie in their boxes and
    balance, rows without one are outside the margin, rows at their bound inside or on it, the
    others on it; and the primal value is the dual one. Margins are summed up anew, from the rows
    and the table of support vectors, for each row over all of them."""
    rows = labelled_vectors(spark, sf)
    model = svm.KernelSvm(part_rows=200, folds=2, tolerance=1e-6).fit(rows)
    support = svm.support_table(spark, model)
    y = F.when(F.col("label") == 1.0, 1.0).otherwise(-1.0)
    weighted = vectors.class_weights(rows).select(y.alias("y"), vector_to_array("features").alias("x"), (F.col("weight") * model.c).alias("cap"))
    # equal rows share a multiplier, up to the sum of their bounds
    caps = weighted.groupBy("x", "y").agg(F.sum("cap").alias("cap"), F.count(F.lit(1)).alias("copies"))
    # the few bytes of the rows would make one task of all pairs
    margins = svm.with_margins(cut_lineage(caps.repartition(max(1, model.n_rows // PAIRED_ROWS), "x", "y")), model)
    placed = margins.join(support.select("x", "y", "alpha"), ["x", "y"], "left").withColumn("alpha", F.coalesce("alpha", F.lit(0.0)))
    gap, slack, full = F.col("y") * F.col("f") - 1, 2e-3, F.col("alpha") >= F.col("cap") * (1 - 1e-9)
    broken = ((F.col("alpha") == 0) & (gap < -slack)) | (full & (gap > slack)) | ((F.col("alpha") > 0) & ~full & (F.abs(gap) > slack))
    # |w|^2 is the sum of alpha y (f - b), and the balance makes b drop out
    length = F.sum(F.col("alpha") * F.col("y") * F.col("f"))
    dual, primal = F.sum("alpha") - length / 2, length / 2 + F.sum(F.col("cap") * F.greatest(F.lit(0.0), -gap))
    return placed.agg(
        F.sum("copies").alias("n_rows"), F.count_if((F.col("alpha") < 0) | (F.col("alpha") > F.col("cap") * (1 + 1e-9))).alias("outside_box"),
        (F.abs(F.sum(F.col("alpha") * F.col("y"))) < 1e-6).alias("balanced"), F.count_if(broken).alias("conditions_broken"),
        (primal - dual <= 2e-4 * dual).alias("gap_closed"),
    )


@query(
    "naive_bayes_sql",
    with_ctes("emb", """
WITH l AS (SELECT vec_id, CASE WHEN cluster = 3 THEN 1 ELSE 0 END AS y, pos, x FROM emb),
wide AS (SELECT max(v) AS v FROM (SELECT var_pop(x) AS v FROM l GROUP BY pos)),
s AS (SELECT y AS c, pos, avg(x) AS m, var_pop(x) + 1e-9 * (SELECT v FROM wide) AS v, count(*) AS n FROM l GROUP BY 1, 2),
pr AS (SELECT c, max(n) / (SELECT count(DISTINCT vec_id) FROM l) AS prior FROM s GROUP BY 1),
j AS (SELECT vec_id, s.c, sum(-0.5 * ln(2 * pi() * s.v) - power(x - s.m, 2) / (2 * s.v)) + max(ln(prior)) AS lj
  FROM l JOIN s ON l.pos = s.pos JOIN pr ON pr.c = s.c GROUP BY 1, 2)
SELECT vec_id, CAST(arg_max(c, lj) AS BIGINT) AS predicted, round(max(lj), 5) AS log_joint FROM j GROUP BY 1"""),
)
def naive_bayes_sql(spark, sf):
    long = embeddings_long(spark, sf).withColumn("label", (F.col("cluster") == 3).cast("bigint"))
    found = models.naive_bayes_predict(long, models.naive_bayes_stats(long), "vec_id")
    return rounded(found, "log_joint", places=5)


@query("train_and_evaluate")
def train_and_evaluate(spark, sf):
    """Telemetry to report: windows, vectors, split, forest, held-out figures."""
    key = F.concat_ws("|", "window_id", "hostname", "source_label", "source_ip")
    rows = window_vectors(spark, sf).select(key.alias("key"), F.col("is_attack").cast("double").alias("label"), "features")
    parts = sampling.stratified_split(rows, "label", "key")
    model = models.fit_classifier(models.random_forest(), parts.where("split = 'train'").select("label", "features"))
    held_out = models.score(model, parts.where("split = 'test'"))
    return metrics.evaluate(held_out.select(F.col("label").cast("int").alias("label"), F.col("probability").alias("score")))


@query("save_load_model", "SELECT vec_id, CASE WHEN label = 3 THEN 1 ELSE 0 END AS label, 1 AS same FROM embeddings")
def save_load_model(spark, sf):
    train, everything = split(spark, sf)
    path = scratch(spark, "model")
    fitted = models.fit_classifier(models.logistic(train.count(), rounds=50), train)
    models.save_model(fitted, path)
    before = models.score(fitted, everything).select("vec_id", "label", F.col("probability").alias("before"))
    after = models.score(models.load_model(path), everything).select("vec_id", F.col("probability").alias("after"))
    return before.join(after, "vec_id").select("vec_id", F.col("label").cast("int").alias("label"), (F.col("before") == F.col("after")).cast("int").alias("same"))


@query("score_model")
def score_model(spark, sf):
    train, everything = split(spark, sf)
    model: PipelineModel = models.fit_classifier(models.decision_tree(depth=4), train)
    return scored(model, everything).where("split = 'test'")


@query("fit_kmeans")
def fit_kmeans(spark, sf):
    rows = labelled_vectors(spark, sf)
    return models.fit_kmeans(rows, k=10).transform(rows).select("vec_id", F.col("prediction").alias("cluster"))


@query("kmeans_centers")
def kmeans_centers(spark, sf):
    return models.centroid_table(spark, models.fit_kmeans(labelled_vectors(spark, sf), k=10))


@query(
    "kmeans_optimality",
    """SELECT count(*) AS n_rows, CAST(10 AS BIGINT) AS n_clusters, CAST(0 AS BIGINT) AS nearer_elsewhere, CAST(0 AS BIGINT) AS centres_off, true AS inertia_adds_up
FROM embeddings""",
)
def kmeans_optimality(spark, sf):
    """What makes a k-means solution one: every row is at its nearest centre, and every centre is the mean of its rows."""
    rows = cut_lineage(labelled_vectors(spark, sf))
    model = models.fit_kmeans(rows, k=10, tolerance=0.0)
    centers = models.cluster_centers(spark, model)
    x = vector_to_array("features")
    placed = model.transform(rows).select("vec_id", x.alias("x"), F.col("prediction").alias("cluster")).join(F.broadcast(centers), "cluster")
    apart = placed.withColumn("d", anomaly.squared_distance(F.col("x"), F.col("center")))
    every = apart.drop("center").join(F.broadcast(centers.withColumnRenamed("cluster", "other").withColumnRenamed("center", "c")), F.lit(True))
    nearest = every.groupBy("vec_id").agg(F.first("d").alias("d"), F.min(anomaly.squared_distance(F.col("x"), F.col("c"))).alias("least"))
    means = apart.select("cluster", "center", F.posexplode("x").alias("pos", "v")).groupBy("cluster", "pos").agg(F.avg("v").alias("mean"), F.first(F.get("center", F.col("pos"))).alias("c"))
    off = means.agg(F.count_if(F.abs(F.col("mean") - F.col("c")) > 1e-9).alias("centres_off"), F.count_distinct("cluster").alias("n_clusters"))
    far = nearest.agg(F.count(F.lit(1)).alias("n_rows"), F.count_if(F.col("d") > F.col("least") + 1e-12).alias("nearer_elsewhere"), (F.abs(F.sum("d") - F.lit(model.cost)) < 1e-6).alias("inertia_adds_up"))
    return far.join(off, F.lit(True)).select("n_rows", "n_clusters", "nearer_elsewhere", "centres_off", "inertia_adds_up")


@query("fit_gmm")
def fit_gmm(spark, sf):
    rows = labelled_vectors(spark, sf)
    model = models.fit_gmm(rows, k=4)
    membership = F.array_max("probability")
    return model.transform(rows).select("vec_id", F.col("prediction").alias("cluster"), membership.alias("membership"))


@query("gmm_criteria")
def gmm_criteria(spark, sf):
    rows = labelled_vectors(spark, sf)
    return models.gmm_criteria(models.fit_gmm(rows, k=4), rows, DIMENSION)


@query("gmm_components")
def gmm_components(spark, sf):
    return models.mixture_table(spark, models.fit_gmm(labelled_vectors(spark, sf), k=4))


#: thresholds of every feature in the split query, and the same as SQL
CUTS = [round(-0.30 + 0.02 * i, 2) for i in range(31)]


@query(
    "boosted_splits",
    with_ctes("emb", """
WITH l AS (SELECT vec_id, CASE WHEN cluster = 3 THEN 1.0 ELSE 0.0 END AS y, pos, x FROM emb),
cuts AS (SELECT round(-0.30 + 0.02 * i, 2)::DOUBLE AS cut FROM range(31) r(i)),
h AS (SELECT pos, cut, sum(CASE WHEN x <= cut THEN 1 - y ELSE 0 END) AS l0, sum(CASE WHEN x <= cut THEN y ELSE 0 END) AS l1,
    sum(CASE WHEN x > cut THEN 1 - y ELSE 0 END) AS r0, sum(CASE WHEN x > cut THEN y ELSE 0 END) AS r1 FROM l, cuts GROUP BY 1, 2),
g AS (SELECT *, (l0 * l0 + l1 * l1) / (l0 + l1) + (r0 * r0 + r1 * r1) / (r0 + r1) AS gain FROM h WHERE l0 + l1 > 0 AND r0 + r1 > 0),
one AS (SELECT * FROM g ORDER BY round(gain, 9) DESC, pos, cut LIMIT 1),
w AS (SELECT l.vec_id, l.y, CASE WHEN ((CASE WHEN l.x <= one.cut THEN l1 / (l0 + l1) ELSE r1 / (r0 + r1) END) > 0.5) <> (l.y = 1) THEN 1 ELSE 0 END AS wrong FROM l JOIN one ON l.pos = one.pos),
e AS (SELECT avg(wrong) AS error FROM w)
SELECT CAST(pos AS INTEGER) AS feature, cut AS threshold, round(gain, 6) AS gain, round(error, 9) AS error, round(ln((1 - error) / error), 6) AS alpha FROM one, e"""),
)
def boosted_splits(spark, sf):
    """The first round of boosting against the best split by SQL, over stated thresholds."""
    model = models.AdaBoost(rounds=1, cuts=CUTS).fit(labelled_vectors(spark, sf))
    (tree, alpha), (gain, error) = model.trees[0], model.history[0]
    row = [(tree.feature[0], tree.threshold[0], round(gain, 6), round(error, 9), round(alpha, 6))]
    return spark.createDataFrame(row, "feature INT, threshold DOUBLE, gain DOUBLE, error DOUBLE, alpha DOUBLE")


SEARCHED = {"roc_auc": 0.5, "average_precision": 0.5}


@query("search_grid")
def search_grid(spark, sf):
    """Grid search on the training rows, reported with the winner's held-out figures."""
    train, everything = split(spark, sf)
    rows = cut_lineage(vectors.class_weights(sampling.stratified_folds(train, "label", "vec_id", folds=5)))
    pipeline = models.random_forest(trees=20)
    grid = models.param_grid(pipeline.getStages()[0], {"maxDepth": [4, 10], "minInstancesPerNode": [1, 4]})
    found = models.search(pipeline, grid, rows, 5, SEARCHED)
    report = models.search_report(spark, found, everything.where("split = 'test'"), SEARCHED)
    path = scratch(spark, "search")
    save_table(report, path)
    return spark.read.parquet(path)


@query("search_random")
def search_random(spark, sf):
    rows = sampling.stratified_folds(labelled_vectors(spark, sf), "label", "vec_id", folds=5)
    pipeline = models.decision_tree()
    grid = models.param_grid(pipeline.getStages()[0], {"maxDepth": [2, 4, 6, 10], "minInstancesPerNode": [1, 5, 10]})
    drawn = models.sample_candidates(grid, 6)
    found = models.search(pipeline, drawn, cut_lineage(vectors.class_weights(rows)), 5, SEARCHED)
    return models.cv_results(spark, found)


@query(
    "search_results_ranked",
    "SELECT CAST(count(*) AS BIGINT) AS n_candidates, true AS ranks_follow_scores, true AS composite_adds_up FROM range(6)",
)
def search_results_ranked(spark, sf):
    """The report of a real search: its ranks and weighted sums against the same from its means."""
    found = search_random(spark, sf)
    again = metrics.search_ranks(found.drop(*[c for c in found.columns if c.startswith("rank_")]), SEARCHED)
    ranks = [c for c in found.columns if c.startswith("rank_")]
    both = found.select("candidate", *[F.col(c).alias(f"_{c}") for c in ranks], "composite_score", "mean_roc_auc", "mean_average_precision").join(again.select("candidate", *ranks), "candidate")
    same = [F.col(c) == F.col(f"_{c}") for c in ranks]
    sum_ = sum((F.lit(w) * F.col(f"mean_{m}") for m, w in SEARCHED.items()), F.lit(0.0))
    return both.agg(
        F.count(F.lit(1)).alias("n_candidates"), F.every(reduce(lambda a, b: a & b, same)).alias("ranks_follow_scores"),
        F.every(F.abs(sum_ - F.col("composite_score")) < 1e-9).alias("composite_adds_up"),
    )


@query("search_clusters")
def search_clusters(spark, sf):
    """Every kind of clusterer; no setting is refused."""
    grid = [{"k": 5}, {"k": 10}, {"model": "bisecting", "k": 10}, {"model": "mixture", "k": 4}, {"model": "density", "eps": 1.12, "min_samples": 3}]
    _, tried = models.search_clusters(labelled_vectors(spark, sf), "vec_id", grid)
    rows = [(t.get("model", "kmeans"), t.get("k"), t.get("eps"), t["n_clusters"], t["noise"], t["silhouette"]) for t in tried]
    return spark.createDataFrame(rows, "model STRING, k INT, eps DOUBLE, n_clusters BIGINT, noise BIGINT, silhouette DOUBLE")


@query("feature_importances")
def feature_importances(spark, sf):
    rows = window_vectors(spark, sf).select(F.col("is_attack").cast("double").alias("label"), "features")
    model = models.fit_classifier(models.random_forest(), rows)
    layout = vectors.feature_layout(used_families(spark, sf), "family_first").select("feature_idx", "feature")
    names = catalog(spark, sf).select("rule_id", F.col("name").alias("rule_name"))
    found = models.feature_importances(spark, model.stages[-1], layout, names, used_families(spark, sf))
    return found.withColumn("member_rules", F.array_join(F.col("member_rules").cast("array<string>"), ","))


@query("compare_models")
def compare_models(spark, sf):
    train, everything = split(spark, sf)
    fitted = {
        "decision_tree": models.fit_classifier(models.decision_tree(depth=5), train),
        "logistic": models.fit_classifier(models.logistic(train.count(), rounds=50), train),
        "naive_bayes": models.fit_classifier(models.naive_bayes(), train),
    }
    return models.compare_models(fitted, everything.where("split = 'test'"), "vec_id")


def explained(spark, sf):
    """A fitted forest, the windows it calls attacks, and the background they are compared with."""
    key = F.concat_ws("|", "window_id", "hostname", "source_label", "source_ip")
    rows = window_vectors(spark, sf).select(key.alias("key"), F.col("is_attack").cast("double").alias("label"), "features")
    model = models.fit_classifier(models.random_forest(), rows.select("label", "features"))
    alerts = cut_lineage(models.score(model, rows).where("predicted_label = 1").select("key", "features", "probability"))
    background = cut_lineage(sampling.background_rows(rows, 50, "key").select("features"))
    return model, alerts, background


@query("shapley_values")
def shapley_values(spark, sf):
    """Attributions of every window predicted as attack."""
    model, alerts, background = explained(spark, sf)
    return explain.shapley_values(spark, explain.node_table(spark, model.stages[-1]), alerts.select("key", "features"), background, "key")


@query("shapley_sums", "SELECT true AS alerts_found, CAST(0 AS BIGINT) AS off FROM events LIMIT 1")
def shapley_sums(spark, sf):
    """Alerts whose attributions do not sum to their score minus the mean score of the background."""
    model, alerts, background = explained(spark, sf)
    found = explain.shapley_values(spark, explain.node_table(spark, model.stages[-1]), alerts.select("key", "features"), background, "key")
    base = models.score(model, background).agg(F.avg("probability")).first()[0]
    sums = alerts.join(found.groupBy("key").agg(F.sum("attribution").alias("s")), "key", "left")
    gap = F.abs(F.coalesce("s", F.lit(0.0)) - (F.col("probability") - F.lit(base)))
    return sums.agg((F.count(F.lit(1)) > 0).alias("alerts_found"), F.count_if(gap > 1e-9).alias("off"))


@query(
    "background_cross",
    """WITH v AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
b AS (SELECT vec_id AS bg_id, e AS b FROM v WHERE label <> 3 ORDER BY md5('42:' || vec_id), vec_id LIMIT 50)
SELECT vec_id, bg_id, round(list_distance(e, b), 6) AS distance FROM v, b""",
)
def background_cross(spark, sf):
    """Every vector with every background row."""
    e = embeddings(spark, sf).withColumn("label", (F.col("cluster") == 3).cast("int"))
    background = sampling.background_rows(e, 50, "vec_id").select(F.col("vec_id").alias("bg_id"), F.col("features").alias("b"))
    pairs = explain.background_pairs(e.select("vec_id", "features"), background)
    return rounded(pairs.select("vec_id", "bg_id", anomaly.distance(F.col("features"), F.col("b")).alias("distance")), "distance")


def forest(spark, sf):
    rows = window_vectors(spark, sf).select(F.col("is_attack").cast("double").alias("label"), "features")
    return models.fit_classifier(models.random_forest(), rows).stages[-1]


@query("tree_path_itemsets")
def tree_path_itemsets(spark, sf):
    paths = explain.tree_paths(explain.node_table(spark, forest(spark, sf)))
    found = explain.path_itemsets(paths, sizes=(2, 3), min_support=0.01, top_k=20)
    return found.select(F.array_join(F.col("itemset").cast("array<string>"), ",").alias("itemset"), "n_paths", "support")


MIN_SUPPORT = 0.002


@query(
    "cooccurring_rules",
    with_ctes("tele", f"""
WITH b AS (SELECT DISTINCT {wid('ts', 1440)} AS w, user_id, rule_id FROM tele), n AS (SELECT count(*) AS n FROM (SELECT DISTINCT w, user_id FROM b))
SELECT a.rule_id AS rule_a, z.rule_id AS rule_b, count(*) AS n_windows FROM b a JOIN b z ON a.w = z.w AND a.user_id = z.user_id AND a.rule_id < z.rule_id
GROUP BY 1, 2 HAVING count(*) >= ceil({MIN_SUPPORT} * (SELECT n FROM n))"""),
)
def cooccurring_rules(spark, sf):
    t = telemetry(spark, sf).withColumn("window_id", timing.window_id(F.col("timestamp"), 1440))
    found = explain.cooccurring_rules(t, ["window_id", "user_id"], MIN_SUPPORT)
    return found.select(F.get("rules", F.lit(0)).alias("rule_a"), F.get("rules", F.lit(1)).alias("rule_b"), "n_windows")


@query("project_windows")
def project_windows(spark, sf):
    """Three components of a sample that keeps the shares of the labels."""
    key = F.concat_ws("|", "window_id", "hostname", "source_label", "source_ip")
    rows = window_vectors(spark, sf).withColumn("key", key)
    sample = sampling.stratified_split(rows, "is_attack", "key", test_share=0.5).where("split = 'test'")
    return explain.project_windows(sample, 3).select("window_id", "hostname", "source_label", "source_ip", "c1", "c2", "c3")
