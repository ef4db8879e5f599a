"""Files, stored tables, alerts, models, explanations and streams: invariants and known answers."""

from __future__ import annotations

import math
import time
from datetime import datetime, timedelta

import numpy as np
import pytest
from conftest import SF
from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from trigwatch.operators import aggregates as agg
from trigwatch.operators import explain, filters, lookups, models, ranking, sampling, store, vectors
from trigwatch.plans import load_all
from trigwatch.plans.tables import scratch
from trigwatch.sources import catalog, jobs, triggers
from trigwatch.streaming import windows as live

QUERIES, ORACLES = load_all()


# --- files --------------------------------------------------------------------------------


def trigger_folder(spark, rows):
    path = scratch(spark, "triggers")
    names = "`sysmon_hostname (custom)` STRING, `Custom Rule` STRING, `Log Source Time (Minimum)` STRING, `Count` STRING"
    for folder, part in rows.items():
        spark.createDataFrame(part, names).coalesce(1).write.option("header", "true").csv(f"{path}/{folder}")
    return path


def test_trigger_files(spark):
    good = ("h", "300417", "Mar 03, 2031, 11:07:08 PM", "816.0")
    path = trigger_folder(
        spark,
        {
            "a": [good, ("h", "300417", "Feb 9, 2031, 6:05:04 AM", "71,305"), ("N/A", "1", "Feb 9, 2031, 6:05:04 AM", "1")],
            "b": [good, ("h", "2", "yesterday", "5"), ("h", "x", "Feb 9, 2031, 6:05:04 AM", "5")],
        },
    )
    rows = triggers.scan_trigger_csv(spark, path, "attack").collect()
    assert sorted(r["count"] for r in rows) == [816, 816, 71305]
    assert {r.source_label for r in rows} == {"attack"} and len({r.window_id for r in rows}) == 2
    strict = triggers.scan_trigger_csv(spark, path, "attack", strict_count=True)
    assert sorted(r["count"] for r in strict.collect()) == [816, 816]
    named = triggers.scan_trigger_csv(spark, path, "attack", null_host="nan")
    assert "nan" in {r.hostname for r in named.collect()}
    quarantined = triggers.scan_trigger_csv(spark, path, "attack", bad_rows="quarantine_file")
    assert sorted(r["count"] for r in quarantined.collect()) == [816, 71305]


def test_no_trigger_files(spark):
    empty = triggers.scan_trigger_csv(spark, scratch(spark, "nothing"), "normal")
    assert empty.count() == 0 and dict(empty.dtypes)["timestamp"] == "timestamp_ntz"


def test_catalog_last_file_wins_and_bad_ids_go(spark):
    rows = [("1.0", "a", "EVENT", "True", "U", "f1"), ("1", "b", "EVENT", "false", "U", "f2"), ("x", "c", "EVENT", "True", "U", "f2")]
    raw = spark.createDataFrame(rows, "id STRING, name STRING, type STRING, enabled STRING, origin STRING, file STRING")
    assert [(r.rule_id, r.name, r.enabled) for r in catalog.clean_catalog(raw).collect()] == [(1, "b", False)]


def test_job_list_raises(spark):
    path = scratch(spark, "jobs")
    spark.createDataFrame([("", "2025-01-01T00:00:00", "2025-01-02T00:00:00", "o")], "hostname STRING, start_time STRING, end_time STRING, output_dir STRING").select(
        "*", *[F.lit("").alias(c) for c in ("db_name", "collection", "source_schema", "window_size_minutes")]
    ).write.option("header", "true").csv(path)
    with pytest.raises(Exception, match="missing hostname"):
        jobs.scan_jobs(spark, path).collect()


def test_calendar_file(spark):
    path = scratch(spark, "calendar")
    spark.createDataFrame([("4/3/2031 7:15", "4/3/2031 7:45")], "`start time` STRING, `end time` STRING").write.option("header", "true").csv(path)
    assert jobs.scan_calendar(spark, path).first() == (datetime(2031, 3, 4, 7, 15), datetime(2031, 3, 4, 7, 45))


# --- stored tables ------------------------------------------------------------------------


def rows_of(spark, *rows):
    return spark.createDataFrame([(*r, datetime(2024, 1, 1).date()) for r in rows], "window_id STRING, hostname STRING, rule_id BIGINT, count BIGINT, version BIGINT, window_date DATE")


def test_upsert_table_is_idempotent(spark):
    path, keys = scratch(spark, "table"), ["window_id", "hostname", "rule_id"]
    first, second = rows_of(spark, ("w", "h", 1, 5, 1), ("w", "h", 2, 6, 1)), rows_of(spark, ("w", "h", 1, 9, 2))
    for batch in (first, second, second, first):
        store.upsert_table(batch, path, keys, "version")
    assert {(r.rule_id, r["count"]) for r in store.read_table(spark, path).collect()} == {(1, 9), (2, 6)}


def test_upsert_touches_only_its_dates(spark):
    path, keys = scratch(spark, "table"), ["window_id", "hostname", "rule_id"]
    store.upsert_table(rows_of(spark, ("w", "h", 1, 5, 1)), path, keys, "version")
    other = rows_of(spark, ("w2", "h", 1, 7, 1)).withColumn("window_date", F.lit("2024-01-02").cast("date"))
    store.upsert_table(other, path, keys, "version")
    assert {(r.window_id, r["count"]) for r in store.read_table(spark, path).collect()} == {("w", 5), ("w2", 7)}


def test_upsert_reads_only_its_dates(spark):
    path, keys = scratch(spark, "table"), ["window_id", "hostname", "rule_id"]
    first = rows_of(spark, ("w", "h", 1, 5, 1))
    other = rows_of(spark, ("w2", "h", 1, 7, 1)).withColumn("window_date", F.lit("2024-01-02").cast("date"))
    for batch in (first, other):
        store.upsert_table(batch, path, keys, "version")
    plan = store.touched_dates(store.read_table(spark, path), other, "window_date")._jdf.queryExecution().toString()
    assert "PartitionFilters: [isnotnull(window_date" in plan and "2024-01-02" in plan and "2024-01-01" not in plan


def test_writing_the_same_rows_twice_changes_nothing(spark):
    rows = rows_of(spark, ("w", "h", 1, 5, 1), ("w", "h", 2, 6, 1))
    assert store.upsert_windows(rows, rows, "version").count() == 2
    assert store.upsert_windows(rows, rows, "version", merge="sum").agg(F.sum("count")).first()[0] == 11


def test_wide_pivot_keeps_null_keys(spark):
    events = spark.createDataFrame([(None, 1, 5), (4, 2, 6), (4, 2, 1)], "k INT, rule_id BIGINT, count BIGINT")
    for n in (2, 65, 300):
        rows = {r.k: (r.rule_1, r.rule_2) for r in agg.pivot_rules(events, ["k"], range(n + 1)).collect()}
        assert rows == {None: (5, 0), 4: (0, 7)}
    assert agg.pivot_rules(events, ["k"], []).count() == 2


def test_documents_of_a_window_add_up(spark):
    events = spark.createDataFrame(
        [(datetime(2024, 1, 1, 9), f"h{i}", f"ip{i % 2}", i % 5, 1 + i) for i in range(40)], "window_start TIMESTAMP_NTZ, hostname STRING, source_ip STRING, rule_id BIGINT, count BIGINT"
    )
    for shards in (1, 4):
        docs = agg.window_documents(events, 30, shards).collect()
        assert len({(d._id, d.shard) for d in docs}) == len(docs) <= shards
        assert sum(d.total_triggers for d in docs) == sum(range(1, 41))
        assert sorted(h for d in docs for h in d.host_triggers) == sorted(f"h{i}" for i in range(40))


def test_late_rows_are_stored(spark):
    source, path, marks = scratch(spark, "source"), scratch(spark, "table"), scratch(spark, "marks")
    schema = "timestamp TIMESTAMP_NTZ, count BIGINT, hostname STRING"
    for day in (20, 1, 19, 2):  # each file is later than any slack
        spark.createDataFrame([(datetime(2024, 1, day, 9), day, "h")], schema).coalesce(1).write.mode("append").parquet(source)
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(source)
    live.store_counts(stream, path, marks, 60, ["hostname"]).awaitTermination()
    assert sorted(r["count"] for r in live.stored_counts(spark, path, ["hostname"]).collect()) == [1, 2, 19, 20]
    with pytest.raises(ValueError):
        live.tumbling_counts(stream, 60, ["hostname"])


def test_replace_drops_rows_of_the_older_fetch(spark):
    old, new = rows_of(spark, ("w", "h", 1, 5, 1), ("w", "h", 2, 6, 1)), rows_of(spark, ("w", "h", 1, 3, 2))
    assert [(r.rule_id, r["count"]) for r in store.upsert_windows(old, new, "version").collect()] == [(1, 3)]
    summed = store.upsert_windows(old, new, "version", merge="sum").collect()
    assert {(r.rule_id, r["count"]) for r in summed} == {(1, 8), (2, 6)}


def test_expired_windows_with_a_dotted_host(spark):
    host = "named_struct('total_triggers', 1L, 'rules', map('1', 1L), 'source_ip', 'x')"
    docs = spark.sql(f"SELECT TIMESTAMP_NTZ'2024-01-01 00:00:00' AS window_start, posexplode(array(map('a.b', {host}), map('c', {host}))) AS (_id, host_triggers)")
    kept = store.expired_windows(docs, F.lit("2024-02-01").cast("timestamp_ntz"), ["a.b"])
    assert [list(r.host_triggers) for r in kept.collect()] == [["c"]]


def test_superset_text(spark):
    a = spark.sql("SELECT 1 AS b, TIMESTAMP_NTZ'2024-01-01 00:00:01.5' AS t")
    b = spark.sql("SELECT map('k', 1) AS a, TIMESTAMP_NTZ'2024-01-01 00:00:01' AS t")
    found = store.superset_text(a, b)
    assert found.columns == ["a", "b", "t"]
    assert {tuple(r) for r in found.collect()} == {(None, 1, "2024-01-01T00:00:01.500000"), ('{"k":1}', None, "2024-01-01T00:00:01")}


def test_summary_without_data(spark):
    windows = spark.createDataFrame([], "window_start TIMESTAMP_NTZ")
    results = spark.createDataFrame([], "prediction_time TIMESTAMP_NTZ, predicted_label INT, confidence DOUBLE")
    at = lambda t: F.lit(t).cast("timestamp_ntz")
    assert tuple(store.detection_summary(windows, results, at("2024-01-01"), at("2024-01-02")).first()) == (0, 0, 0.0, 0.0)


def test_pushdown_reaches_the_scan(spark):
    events = spark.read.parquet(f"{SF}/events.parquet").withColumnRenamed("ts", "timestamp")
    plan = filters.time_range(events, "2024-01-05", "2024-01-06").select("event_id")._jdf.queryExecution().toString()
    assert "PushedFilters: [IsNotNull(ts), GreaterThanOrEqual(ts" in plan and "ReadSchema: struct<event_id:bigint,ts:timestamp_ntz>" in plan


# --- alerts -------------------------------------------------------------------------------


def items(spark, *rows):
    return spark.createDataFrame([("w", i + 1, b, imp) for i, (b, imp) in enumerate(rows)], "w STRING, rank INT, bucket INT, importance DOUBLE")


def order(found):
    return [r.rank for r in sorted(found.collect(), key=lambda r: r.new_rank)]


def test_priority_modes(spark):
    mixed = items(spark, (3, 0.9), (2, 0.8), (1, 0.7), (0, 0.6), (1, 0.0))
    assert order(ranking.prioritize_topk(mixed, ["w"], 5)) == [4, 3, 1, 2]
    assert order(ranking.prioritize_topk(mixed, ["w"], 5, mode="strict")) == [4, 3, 2, 1]
    plain = items(spark, (3, 0.9), (2, 0.0), (3, 0.5))
    assert order(ranking.prioritize_topk(plain, ["w"], 3)) == [1, 2, 3]
    assert order(ranking.prioritize_topk(plain, ["w"], 3, mode="strict")) == [1, 3]
    assert ranking.prioritize_topk(items(spark, (0, 0.0)), ["w"], 3).count() == 0


def test_leef_line_without_features(spark):
    df = spark.sql(
        "SELECT 'h=1' AS hostname, 'w' AS window_id, 'ATTACK' AS prediction, CAST(NULL AS DOUBLE) AS confidence, TIMESTAMP_NTZ'2024-01-01 00:00:00' AS prediction_time, "
        "CAST(NULL AS INT) AS feature_count, CAST(NULL AS ARRAY<STRUCT<display: STRING, importance: DOUBLE>>) AS top_features"
    )
    line = ranking.leef_lines(df, ranking.leef_header("V", "P")).first().line
    assert line.startswith("LEEF:2.0|V|P|1.0|ATTACK_DETECTION|High|name=Malicious Threat Detection\thostname=h:1\t")
    assert line.endswith("features=unknown\ttimestamp=2024-01-01 00:00:00\tprediction=Attack\tconfidencePct=N/A\ttopFeatures=n/a\tmostCritical=n/a")


def test_interval_join_is_half_open_and_counts_every_job(spark):
    day = datetime(2024, 1, 1)
    windows = spark.createDataFrame([("h", day + timedelta(hours=i)) for i in range(72)], "hostname STRING, window_start TIMESTAMP_NTZ")
    bounds = [(0, 24), (23, 25), (24, 48), (5, 6)]
    listed = spark.createDataFrame(
        [("h", i, day + timedelta(hours=a), day + timedelta(hours=b)) for i, (a, b) in enumerate(bounds)],
        "hostname STRING, job INT, start_time TIMESTAMP_NTZ, end_time TIMESTAMP_NTZ",
    )
    found = {r.job: r["count"] for r in lookups.job_windows(windows, listed).groupBy("job").count().collect()}
    assert found == {i: b - a for i, (a, b) in enumerate(bounds)}


# --- vectors ------------------------------------------------------------------------------


def test_entries_to_array(spark):
    entries = F.expr("from_json(e, 'array<struct<feature_idx: int, value: double>>')")
    rows = spark.createDataFrame([('[{"feature_idx":1,"value":2.0},{"feature_idx":4,"value":3.0}]',), ("[]",), ('[{"feature_idx":0,"value":1.0},{"feature_idx":5,"value":9.0}]',)], "e STRING")
    got = [r[0] for r in rows.withColumn("x", entries).select(vectors.entries_to_array(F.col("x"), 6)).collect()]
    assert got == [[0, 2.0, 0, 0, 3.0, 0], [0.0] * 6, [1.0, 0, 0, 0, 0, 9.0]]


def test_background_falls_back_to_all_rows(spark):
    df = spark.createDataFrame([(i, 1 if i > 2 else 0) for i in range(20)], "key INT, label INT")
    assert sampling.background_rows(df, 50, "key", fewest=10).count() == 20
    assert sampling.background_rows(df, 50, "key", fewest=3).count() == 3


# --- models -------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def labelled(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(240, 4))
    y = ((x[:, 0] + x[:, 1] > 0) ^ (rng.random(240) < 0.05)).astype(float)
    rows = [(i, float(y[i]), [float(v) for v in x[i]]) for i in range(240)]
    df = spark.createDataFrame(rows, "key BIGINT, label DOUBLE, a ARRAY<DOUBLE>")
    return df.select("key", "label", array_to_vector("a").alias("features")).cache()


def build(name, n):
    return {
        "forest": lambda d: models.fit_classifier(models.random_forest(trees=10, depth=5), d),
        "tree": lambda d: models.fit_classifier(models.decision_tree(depth=5), d),
        "boosted": lambda d: models.fit_classifier(models.gradient_boosting(rounds=5), d),
        "logistic": lambda d: models.fit_classifier(models.logistic(n, rounds=50), d),
        "bayes": lambda d: models.fit_classifier(models.naive_bayes(), d),
        "svm": lambda d: models.FourierSvm(size=64, rounds=20).fit(d),
        "ada": lambda d: models.AdaBoost(rounds=8, depth=1).fit(d),
        "extra": lambda d: models.ExtraTrees(trees=10, depth=5).fit(d),
    }[name]


@pytest.mark.parametrize("name", ["forest", "tree", "boosted", "logistic", "bayes", "svm", "ada", "extra"])
def test_models_learn(labelled, name):
    scored = models.score(build(name, 240)(labelled), labelled, 4).select("label", "predicted_label", "probability").toPandas()
    assert scored["probability"].between(0, 1).all() and len(scored) == 240
    assert (scored["label"] == scored["predicted_label"]).mean() > 0.75


def test_wrong_dimension_is_refused(labelled):
    model = models.fit_classifier(models.decision_tree(depth=2), labelled)
    with pytest.raises(Exception, match="dimension mismatch"):
        models.score(model, labelled, 7).collect()


@pytest.mark.parametrize("name", ["logistic", "forest", "svm", "ada", "extra"])
def test_saved_model_scores_the_same(spark, labelled, name):
    model, path = build(name, 240)(labelled), scratch(spark, "model")
    models.save_model(model, path)
    one, two = (models.score(m, labelled).orderBy("key").toPandas() for m in (model, models.load_model(path)))
    assert np.allclose(one["probability"], two["probability"]) and (one["predicted_label"] == two["predicted_label"]).all()


def test_saved_clusterers_place_the_same(spark, labelled):
    for model in (models.fit_kmeans(labelled, k=3, restarts=2), models.fit_gmm(labelled, k=2)):
        path = scratch(spark, "model")
        models.save_model(model, path)
        models.save_model(model, path)  # overwrites
        back = models.load_model(path)
        one, two = (m.transform(labelled).orderBy("key").toPandas()["prediction"] for m in (model, back))
        assert (one == two).all() and vars(back).keys() >= {"n_rounds"}


def test_class_weights_sum_to_the_rows(labelled):
    total = vectors.class_weights(labelled).agg(F.sum("weight")).first()[0]
    assert abs(total - 240) < 1e-9


def test_shapley_adds_up(spark, labelled):
    model = models.fit_classifier(models.random_forest(trees=5, depth=4), labelled)
    rows, background = labelled.where("key < 6"), labelled.where("key >= 200 AND key < 208")
    values = explain.sampled_shapley(model, rows.select("key", "features"), background.select("features"), "key", 4, permutations=3)
    sums = {r.key: r.s for r in values.groupBy("key").agg(F.sum("attribution").alias("s")).collect()}
    base = models.score(model, background).agg(F.avg("probability")).first()[0]
    for r in models.score(model, rows).collect():
        assert abs(sums.get(r.key, 0.0) - (r.probability - base)) < 1e-9


def test_tree_paths(spark):
    # tree 0: f2 -> (leaf, f5 -> (leaf, f2 -> (leaf, leaf))); tree 1: a single leaf
    rows = [(0, 0, 2, 1, 2), (0, 1, -1, -1, -1), (0, 2, 5, 3, 4), (0, 3, -1, -1, -1), (0, 4, 2, 5, 6), (0, 5, -1, -1, -1), (0, 6, -1, -1, -1), (1, 0, -1, -1, -1)]
    nodes = spark.createDataFrame(rows, "tree INT, node INT, feature INT, left INT, right INT")
    paths = explain.tree_paths(nodes)
    assert sorted(r.features for r in paths.collect()) == [[2], [2, 5], [2, 5], [2, 5]]
    (found,) = explain.path_itemsets(paths, sizes=(2, 3)).collect()
    assert found.itemset == [2, 5] and found.n_paths == 3 and found.support == 0.75
    assert sorted(r.features for r in explain.tree_paths(nodes, max_depth=1).collect()) == [[2], [2]]
    assert explain.tree_paths(nodes.where("tree = 1")).count() == 0


def test_itemsets_of_three(spark):
    paths = spark.createDataFrame([(0, [1, 2, 3, 4]), (0, [1, 3, 4])], "tree INT, features ARRAY<INT>")
    found = {tuple(r.itemset): r.n_paths for r in explain.path_itemsets(paths, sizes=(3,), top_k=None).collect()}
    assert found == {(1, 2, 3): 1, (1, 2, 4): 1, (1, 3, 4): 2, (2, 3, 4): 1}


def test_random_candidates_are_distinct():
    grid = [{"a": i} for i in range(10)]
    drawn = models.sample_candidates(grid, 4)
    assert len({d["a"] for d in drawn}) == 4 and len(models.sample_candidates(grid, 99)) == 10


# --- streams ------------------------------------------------------------------------------


def test_stream_in_many_batches_equals_batch(spark):
    # four files, one per trigger, so windows are updated by later batches
    base = spark.read.parquet(f"{SF}/events.parquet").select(
        F.col("ts").alias("timestamp"), F.floor("value").cast("bigint").alias("count"), (F.col("event_id") % 3).alias("hostname"), "event_id"
    )
    source, path, marks = scratch(spark, "source"), scratch(spark, "table"), scratch(spark, "marks")
    base.repartitionByRange(4, "event_id").sortWithinPartitions("event_id").write.parquet(source)
    stream = spark.readStream.schema(base.schema).option("maxFilesPerTrigger", 1).parquet(source)
    counted = live.tumbling_counts(stream, 60, ["hostname"], slack="60 days")
    live.stream_upsert(counted, path, marks, ["window_start", "hostname"]).awaitTermination()
    want = {(r.window_start, r.hostname): r["count"] for r in live.tumbling_counts(base, 60, ["hostname"]).collect()}
    got = {(r.window_start, r.hostname): r["count"] for r in store.read_table(spark, path).collect()}
    assert got == want


def test_expired_days_go(spark):
    path = scratch(spark, "days")
    rows = [("2024-01-01", "a"), ("2024-01-02", "b"), ("2024-01-09", "a"), (None, "c")]
    days = spark.createDataFrame(rows, "d STRING, hostname STRING").select(F.col("d").cast("date").alias("window_date"), "hostname", F.lit(1).alias("version"))
    store.upsert_table(days, path, ["hostname", "window_date"], "version")
    before = store.read_table(spark, path)
    assert live.drop_expired_days(spark, path, "2024-01-05", lookups.host_list(spark, ["b"])) == 1
    left = {(str(r.window_date), r.hostname) for r in store.read_table(spark, path).collect()}
    assert left == {("2024-01-02", "b"), ("2024-01-09", "a"), ("None", "c")} and before.count() == 4
    assert live.drop_expired_days(spark, path, "2024-01-05") == 1
    assert live.drop_expired_days(spark, path, "2024-01-05") == 0
    assert live.drop_expired_days(spark, scratch(spark, "none"), "2024-01-05") == 0


def scored(spark, *rows):
    start = datetime(2024, 1, 1, 9)
    return spark.createDataFrame([(w, h, p, start, start + timedelta(hours=1)) for w, h, p in rows], "window_id STRING, hostname STRING, probability DOUBLE, window_start TIMESTAMP_NTZ, window_end TIMESTAMP_NTZ")


def test_alerts_are_corrected_and_withdrawn(spark):
    path = scratch(spark, "alerts")
    judge = lambda df: df.withColumn("predicted_label", (F.col("probability") > 0.5).cast("int"))
    alerts = lambda: {(r.window_id, r.confidence) for r in live.stored_alerts(spark, path).collect()}
    runs = []
    for confidence, want in ((0.95, 0.95), (0.60, 0.60), (0.10, None), (0.70, 0.70), (None, None)):
        time.sleep(0.002)  # runs start at different milliseconds
        runs.append(live.detect_sink(judge, 0.5, path))
        runs[-1](scored(spark, ("w", "h", confidence), ("v", "h", 0.8)), 0)
        assert alerts() == {("v", 0.8)} | ({("w", want)} if want else set())
    runs[0](scored(spark, ("w", "h", 0.95), ("v", "h", 0.8)), 0)  # an old run's batch comes again
    assert alerts() == {("v", 0.8)}


def test_progress_outlives_a_restart(spark):
    kept, log = scratch(spark, "progress"), live.ProgressLog()
    log.rows += [("q", "r1", "started", "t0", None, None, None), ("q", "r1", "progress", "t1", 0, 5, None), ("q", "r1", "progress", "t2", 1, 7, None)]
    assert log.store(spark, kept) == 3 and log.rows == [] and log.store(spark, kept) == 0
    again = live.ProgressLog()  # batch 1 was not committed and is repeated
    again.rows += [("q", "r2", "progress", "t3", 1, 9, None), ("q", "r2", "progress", "t4", 2, 1, None), ("p", "r3", "progress", "t4", 0, 100, None)]
    again.store(spark, kept)
    sums = {r.query: r.n for r in live.stored_progress(spark, kept).groupBy("query").agg(F.sum("input_rows").alias("n")).collect()}
    assert sums == {"q": 15, "p": 100}


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES) - {"search_grid", "shapley_values"}))
def test_queries_without_sql_run(spark, name):
    assert QUERIES[name](spark, SF).limit(1).count() == 1


def test_gmm_probabilities(spark):
    rows = QUERIES["fit_gmm"](spark, SF).collect()
    assert all(0 <= r.membership <= 1 + 1e-9 and not math.isnan(r.membership) for r in rows)


def test_mixture_uses_all_dimensions(spark):
    rng = np.random.default_rng(4)
    # the two groups differ in the last five dimensions only
    x = np.concatenate([rng.normal(0, [3, 3, 3, 1, 1, 1, 1, 1], (200, 8)), rng.normal([0, 0, 0, 6, 6, 6, 6, 6], [3, 3, 3, 1, 1, 1, 1, 1], (200, 8))])
    df = spark.createDataFrame(list(enumerate(x.tolist())), ["key", "x"]).select("key", array_to_vector("x").alias("features"))
    model = models.fit_gmm(df, k=2)
    got = {r.key: r.prediction for r in model.transform(df).collect()}
    assert model.converged and len({got[i] for i in range(200)}) == len({got[i] for i in range(200, 400)}) == 1 and got[0] != got[399]
    assert np.allclose(sorted(model.weights), [0.5, 0.5], atol=1e-3)
    densities = [w * np.exp(-0.5 * np.einsum("ij,jk,ik->i", x - m, np.linalg.inv(c), x - m)) / np.sqrt(np.linalg.det(2 * np.pi * c)) for w, m, c in zip(model.weights, model.means, model.covariances)]
    assert abs(model.log_likelihood - np.log(sum(densities)).sum()) < 1e-6
    same = spark.createDataFrame([([1.0, 2.0] if i < 9 else [float(i), 1.0],) for i in range(20)], ["x"]).select(array_to_vector("x").alias("features"))
    assert models.fit_gmm(same, k=3).transform(same).where("isnan(probability[0])").count() == 0


def test_mixture_queries_fit_the_embeddings(spark):
    free = 3 + 4 * 64 + 4 * 64 * 65 // 2
    [r] = QUERIES["gmm_criteria"](spark, SF).collect()
    assert abs(r.aic - (2 * free - 2 * r.log_likelihood)) < 1e-6


def test_shapley_query_takes_the_whole_background(spark, monkeypatch):
    sizes, plain = [], explain.shapley_values

    def seen(session, nodes, rows, background, *args):
        sizes.append((background.count(), nodes.select("tree").distinct().count()))
        return plain(session, nodes, rows.limit(2), background, *args)

    monkeypatch.setattr(explain, "shapley_values", seen)
    assert QUERIES["shapley_values"](spark, SF).count() > 0
    assert sizes == [(50, 200)]
