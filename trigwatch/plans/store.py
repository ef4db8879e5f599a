"""Upserts, retention, summaries and exports."""

from __future__ import annotations

from pyspark.sql import functions as F

from trigwatch.operators import aggregates as agg
from trigwatch.operators import lookups, store
from trigwatch.plans.registry import query
from trigwatch.plans.tables import (
    hstart, plain, scratch, siem, stored_results, stored_windows, telemetry, texts, wid, windowed, with_ctes, wstart,
)


def versions(spark, sf):
    """Rule rows written twice: all of them first, those of two thirds of the events again with other counts."""
    t, keys, seen = telemetry(spark, sf), ["hostname", "rule_id"], F.min("timestamp").alias("first_time")
    first = windowed(t, 360, keys, F.sum("count").alias("count"), seen).withColumn("version", F.lit(1).cast("bigint"))
    again = windowed(t.where("event_id % 3 <> 0"), 360, keys, (F.sum("count") + 7).alias("count"), seen)
    return first, again.withColumn("version", F.lit(2).cast("bigint"))


VERSIONS = f"""t AS (SELECT *, {wid('ts', 360)} AS window_id FROM tele),
v1 AS (SELECT window_id, hostname, rule_id, sum(cnt) AS c, 1 AS version FROM t GROUP BY 1, 2, 3),
v2 AS (SELECT window_id, hostname, rule_id, sum(cnt) + 7 AS c, 2 AS version FROM t WHERE event_id % 3 <> 0 GROUP BY 1, 2, 3),
both_v AS (SELECT * FROM v1 UNION ALL SELECT * FROM v2)"""


@query(
    "upsert_events",
    with_ctes("tele", f"""
WITH {VERSIONS} SELECT window_id, hostname, rule_id, CAST(arg_max(c, version) AS BIGINT) AS count, CAST(max(version) AS BIGINT) AS version FROM both_v GROUP BY 1, 2, 3"""),
)
def upsert_events(spark, sf):
    first, again = versions(spark, sf)
    return store.upsert_events(first, again).drop("first_time")


@query(
    "upsert_events_sum",
    with_ctes("tele", f"""
WITH {VERSIONS} SELECT window_id, hostname, rule_id, CAST(sum(c) AS BIGINT) AS count, CAST(max(version) AS BIGINT) AS version FROM both_v GROUP BY 1, 2, 3"""),
)
def upsert_events_sum(spark, sf):
    first, again = versions(spark, sf)
    merged = store.merge_rows(first, again, ["window_id", "hostname", "rule_id"], "version", merge="sum", add=["count"])
    return merged.drop("first_time")


@query(
    "upsert_windows",
    with_ctes("tele", f"""
WITH {VERSIONS} SELECT b.window_id, hostname, rule_id, CAST(c AS BIGINT) AS count FROM both_v b
JOIN (SELECT window_id, max(version) AS newest FROM both_v GROUP BY 1) n ON b.window_id = n.window_id AND b.version = n.newest"""),
)
def upsert_windows(spark, sf):
    first, again = versions(spark, sf)
    return store.upsert_windows(first, again, "version").select("window_id", "hostname", "rule_id", "count")


@query(
    "upsert_results",
    with_ctes("results", f"""
SELECT window_id, hostname, CASE WHEN label_odd THEN 1 - predicted_label ELSE predicted_label END AS predicted_label, confidence,
  {plain("CASE WHEN label_odd THEN prediction_time + INTERVAL 1 HOUR ELSE prediction_time END")} AS prediction_time
FROM (SELECT *, hostname IN ('host-1', 'host-3') AS label_odd FROM results)"""),
)
def upsert_results(spark, sf):
    old = stored_results(spark, sf)
    new = old.where("hostname IN ('host-1', 'host-3')").select(
        "window_id", "hostname", (1 - F.col("predicted_label")).alias("predicted_label"), "confidence",
        (F.col("prediction_time") + F.make_dt_interval(hours=F.lit(1))).alias("prediction_time"),
    )
    return texts(store.upsert_results(old, new), "prediction_time")


@query(
    "upsert_table",
    with_ctes("tele", f"""
WITH {VERSIONS} SELECT window_id, hostname, rule_id, CAST(arg_max(c, version) AS BIGINT) AS count, substr(window_id, 1, 10) AS window_date FROM both_v GROUP BY 1, 2, 3"""),
)
def upsert_table(spark, sf):
    back = written(spark, sf, "replace")
    return back.select("window_id", "hostname", "rule_id", "count", F.col("window_date").cast("string").alias("window_date"))


def written(spark, sf, mode, versions_=None):
    """Both versions written to a new table, each of them twice."""
    path = scratch(spark, "events-table")
    for part in versions_ or versions(spark, sf):
        dated = part.drop("first_time").withColumn("window_date", F.substring("window_id", 1, 10).cast("date"))
        for _ in range(2):
            store.upsert_table(dated, path, KEYS, "version", merge=mode)
    return store.read_table(spark, path)


KEYS = ["window_id", "hostname", "rule_id"]


@query(
    "upsert_table_windows",
    with_ctes("tele", f"""
WITH {VERSIONS} SELECT b.window_id, hostname, rule_id, CAST(c AS BIGINT) AS count FROM both_v b
JOIN (SELECT window_id, max(version) AS newest FROM both_v GROUP BY 1) n ON b.window_id = n.window_id AND b.version = n.newest"""),
)
def upsert_table_windows(spark, sf):
    return written(spark, sf, "windows").select(*KEYS, "count")


@query(
    "upsert_table_sum",
    with_ctes("tele", f"""
WITH {VERSIONS} SELECT window_id, hostname, rule_id, CAST(sum(c) AS BIGINT) AS count, CAST(max(version) AS BIGINT) AS version FROM both_v GROUP BY 1, 2, 3"""),
)
def upsert_table_sum(spark, sf):
    return store.summed(written(spark, sf, "sum"), KEYS, "version", ["count"]).select(*KEYS, "count", "version")


@query(
    "upsert_null_version",
    with_ctes("tele", f"""
WITH {VERSIONS}, b AS (SELECT window_id, hostname, rule_id, c, CASE WHEN version = 2 THEN 2 END AS version FROM both_v)
SELECT b.window_id, hostname, rule_id, CAST(c AS BIGINT) AS count, CAST(version AS BIGINT) AS version FROM b
JOIN (SELECT window_id, max(version) AS newest FROM b GROUP BY 1) n ON b.window_id = n.window_id AND b.version IS NOT DISTINCT FROM n.newest"""),
)
def upsert_null_version(spark, sf):
    # the first version carries no number: it is the oldest, and stays where there is no other
    first, again = versions(spark, sf)
    unnumbered = first.withColumn("version", F.lit(None).cast("bigint"))
    return written(spark, sf, "windows", (unnumbered, again, unnumbered)).select(*KEYS, "count", "version")


@query(
    "dedupe_latest",
    with_ctes("tele", f"SELECT user_id, arg_max(event_type, event_id) AS event_type, max(event_id) AS event_id FROM tele GROUP BY user_id"),
)
def dedupe_latest(spark, sf):
    return store.dedupe_latest(telemetry(spark, sf).select("user_id", "event_type", "event_id"), ["user_id"], "event_id")


CUT = "(SELECT max(ts) - INTERVAL 10 DAY FROM tele)"


def cutoff(spark, sf):
    return store.cutoff_from(telemetry(spark, sf), "timestamp", 10)


@query("expired", with_ctes("tele", f"SELECT event_id, hostname FROM tele WHERE ts < {CUT} AND hostname NOT IN ('host-1', 'host-3')"))
def expired(spark, sf):
    hosts = lookups.host_list(spark, ["host-1", "host-3"])
    return store.expired(telemetry(spark, sf), cutoff(spark, sf), "timestamp", hosts).select("event_id", "hostname")


@query("survivors", with_ctes("tele", f"SELECT event_id, hostname FROM tele WHERE ts >= {CUT} OR hostname IN ('host-1', 'host-3')"))
def survivors(spark, sf):
    hosts = lookups.host_list(spark, ["host-1", "host-3"])
    return store.survivors(telemetry(spark, sf), cutoff(spark, sf), "timestamp", hosts).select("event_id", "hostname")


@query(
    "expired_windows",
    with_ctes("tele", f"""
SELECT strftime(w, '%Y-%m-%d_%H-%M-%S') AS window_id FROM (SELECT {hstart('ts', 60)} AS w, bool_or(hostname = 'host-2') AS kept FROM tele GROUP BY 1)
WHERE w < {CUT} AND NOT kept"""),
)
def expired_windows(spark, sf):
    docs = agg.window_documents(agg.ingest_windows(telemetry(spark, sf), 60), 60, shards=3)
    return store.expired_windows(docs, cutoff(spark, sf), [" host-2 ", ""]).select(F.col("_id").alias("window_id")).distinct()


@query(
    "delete_range",
    with_ctes("tele", "SELECT event_id FROM tele WHERE NOT (ts >= TIMESTAMP '2024-01-05' AND ts < TIMESTAMP '2024-01-20')"),
)
def delete_range(spark, sf):
    return store.delete_range(telemetry(spark, sf), "2024-01-05", "2024-01-20", "timestamp").select("event_id")


@query(
    "retention_dry_run",
    with_ctes("results", f"""
SELECT 'events' AS table_name, count(*) AS expired FROM tele WHERE ts < {CUT} AND hostname <> 'host-1'
UNION ALL SELECT 'windows', count(*) FROM windows WHERE window_start < {CUT} AND hostname <> 'host-1'
UNION ALL SELECT 'results', count(*) FROM results WHERE prediction_time < {CUT} AND hostname <> 'host-1'"""),
)
def retention_dry_run(spark, sf):
    tables = {
        "events": (telemetry(spark, sf), "timestamp"),
        "windows": (stored_windows(spark, sf), "window_start"),
        "results": (stored_results(spark, sf), "prediction_time"),
    }
    return store.retention_dry_run(tables, cutoff(spark, sf), lookups.host_list(spark, ["host-1"]))


@query(
    "table_summary",
    with_ctes("results", f"""
SELECT 'events' AS table_name, count(*) AS n_rows, count(DISTINCT hostname) AS n_hosts, count(DISTINCT rule_id) AS n_rules, 0 AS n_labelled, 0 AS n_attack, 0 AS n_normal,
  {plain('min(ts)')} AS first_time, {plain('max(ts)')} AS last_time, 0 AS training_ready FROM tele
UNION ALL SELECT 'windows', count(*), count(DISTINCT hostname), 0, count(label), count(*) FILTER (label = 1), count(*) FILTER (label = 0),
  {plain('min(window_start)')}, {plain('max(window_end)')}, 1 FROM windows
UNION ALL SELECT 'results', count(*), count(DISTINCT hostname), 0, count(*), count(*) FILTER (predicted_label = 1), count(*) FILTER (predicted_label = 0),
  {plain('min(prediction_time)')}, {plain('max(prediction_time)')}, 0 FROM results"""),
)
def table_summary(spark, sf):
    return texts(store.table_summary(telemetry(spark, sf), stored_windows(spark, sf), stored_results(spark, sf)), "first_time", "last_time")


@query(
    "ingest_summary",
    with_ctes("windows", f"""
SELECT 'windows' AS table_name, count(*) AS n_rows, {plain('min(window_start)')} AS first_time, {plain('max(window_end)')} AS last_time FROM windows
UNION ALL SELECT 'events', count(*), {plain('min(ts)')}, {plain('max(ts)')} FROM tele"""),
)
def ingest_summary(spark, sf):
    return texts(store.ingest_summary(stored_windows(spark, sf), telemetry(spark, sf)), "first_time", "last_time")


@query(
    "detection_summary",
    with_ctes("results", """
WITH w AS (SELECT count(*) AS n FROM windows WHERE window_start >= TIMESTAMP '2024-01-10' AND window_start < TIMESTAMP '2024-01-20'),
r AS (SELECT CAST(sum(predicted_label) AS BIGINT) AS a, CAST(round(CAST(sum(CAST(confidence AS DECIMAL(18, 9))) / count(*) AS DECIMAL(18, 12)), 3) AS DOUBLE) AS c FROM results WHERE prediction_time >= TIMESTAMP '2024-01-10' AND prediction_time < TIMESTAMP '2024-01-20')
SELECT n AS total_windows, a AS total_anomalies, c AS average_confidence, round(a / n, 3) AS detection_rate FROM w, r"""),
)
def detection_summary(spark, sf):
    at = lambda t: F.lit(t).cast("timestamp_ntz")
    return store.detection_summary(stored_windows(spark, sf), stored_results(spark, sf), at("2024-01-10"), at("2024-01-20"))


@query(
    "union_superset",
    with_ctes("results", """
SELECT hostname, window_id, total_events, label, NULL AS confidence, NULL AS predicted_label FROM windows
UNION ALL SELECT hostname, window_id, NULL, NULL, confidence, predicted_label FROM results"""),
)
def union_superset(spark, sf):
    return store.union_superset(
        stored_windows(spark, sf).select("hostname", "window_id", "total_events", "label"),
        stored_results(spark, sf).select("hostname", "window_id", "confidence", "predicted_label"),
    )


@query(
    "export_superset_csv",
    with_ctes("results", """
SELECT hostname, window_id, '{"n":' || CAST(total_events AS VARCHAR) || '}' AS details, strftime(window_start, '%Y-%m-%dT%H:%M:%S') AS window_start, NULL AS confidence FROM windows
UNION ALL SELECT hostname, window_id, NULL, NULL, CAST(confidence AS VARCHAR) FROM results"""),
)
def export_superset_csv(spark, sf):
    path = scratch(spark, "export")
    store.export_superset_csv(
        path,
        stored_windows(spark, sf).select("hostname", "window_id", "window_start", F.struct(F.col("total_events").alias("n")).alias("details")),
        stored_results(spark, sf).select("hostname", "window_id", "confidence"),
    )
    return spark.read.option("header", "true").option("escape", '"').csv(path)


@query(
    "export_window_files",
    with_ctes("tele", f"""
SELECT hostname, strftime({wstart('ts', 360)}, '%Y%m%d_%H%M') AS win, rule_id, {siem('min(' + hstart('ts', 15) + ')')} AS first_seen,
  CAST(sum(cnt) AS BIGINT) AS total FROM tele GROUP BY 1, 2, 3"""),
)
def export_window_files(spark, sf):
    path = scratch(spark, "files")
    small = agg.host_rule_counts(agg.ingest_windows(telemetry(spark, sf), 15))
    store.export_window_files(agg.reaggregate(small, 360), path)
    back = spark.read.option("header", "true").csv(path)
    return back.select(
        "hostname", F.col("window").alias("win"), F.col("Custom Rule").cast("bigint").alias("rule_id"),
        F.col("Log Source Time (Minimum)").alias("first_seen"), F.col("Count").cast("bigint").alias("total"),
    )


