"""Filters, table checks and store queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from trigwatch.functions import cleaning
from trigwatch.operators import aggregates as agg
from trigwatch.operators import filters
from trigwatch.plans.registry import query
from trigwatch.plans.scans import window_docs
from trigwatch.plans.tables import (
    MARKER, catalog, embeddings_long, hstart, plain, scores, stored_results, stored_windows, table, telemetry, texts, with_ctes,
)

DIRTY_SQL = """dirty AS (SELECT event_id, CASE WHEN event_id % 7 = 0 THEN NULL ELSE hostname END AS hostname,
  CASE WHEN event_id % 11 = 0 THEN NULL ELSE rule_id END AS rule_id, CASE WHEN event_id % 13 = 0 THEN NULL ELSE ts END AS ts,
  CASE WHEN event_id % 17 = 0 THEN NULL WHEN event_id % 5 = 0 THEN -cnt ELSE cnt END AS cnt,
  CASE WHEN event_id % 3 = 0 THEN 'other' ELSE source_label END AS source_label FROM tele)"""


def dirty(spark, sf):
    key = F.col("event_id")
    return telemetry(spark, sf).select(
        "event_id",
        F.when(key % 7 != 0, F.col("hostname")).alias("hostname"),
        F.when(key % 11 != 0, F.col("rule_id")).alias("rule_id"),
        F.when(key % 13 != 0, F.col("timestamp")).alias("timestamp"),
        F.when(key % 17 == 0, None).when(key % 5 == 0, -F.col("count")).otherwise(F.col("count")).alias("count"),
        F.when(key % 3 == 0, "other").otherwise(F.col("source_label")).alias("source_label"),
    )


@query(
    "drop_incomplete",
    with_ctes("tele", f"""
WITH {DIRTY_SQL} SELECT event_id, hostname, rule_id, cnt AS count FROM dirty
WHERE hostname IS NOT NULL AND rule_id IS NOT NULL AND ts IS NOT NULL AND cnt IS NOT NULL"""),
)
def drop_incomplete(spark, sf):
    return filters.drop_incomplete(dirty(spark, sf)).select("event_id", "hostname", "rule_id", "count")


@query("positive_counts", with_ctes("tele", f"WITH {DIRTY_SQL} SELECT event_id, cnt AS count FROM dirty WHERE cnt > 0"))
def positive_counts(spark, sf):
    return filters.positive_counts(dirty(spark, sf)).select("event_id", "count")


@query(
    "check_events",
    with_ctes("tele", f"""
WITH {DIRTY_SQL}, c AS (SELECT 0 AS column_hostname, 0 AS column_rule_id, 0 AS column_timestamp, 0 AS column_count, 0 AS column_source_label,
  count(*) FILTER (rule_id IS NULL) AS rule_id_null, count(*) FILTER (cnt IS NULL) AS count_null, count(*) FILTER (cnt < 0) AS count_negative,
  count(*) FILTER (hostname IS NULL) AS hostname_null, count(*) FILTER (ts IS NULL) AS timestamp_null,
  count(*) FILTER (source_label NOT IN ('normal', 'attack', 'detection')) AS label_unknown FROM dirty)
SELECT name AS "check", CAST(value AS BIGINT) AS violations FROM (UNPIVOT c ON COLUMNS(*) INTO NAME name VALUE value)"""),
)
def check_events(spark, sf):
    return filters.check_events(dirty(spark, sf))


@query(
    "check_windows",
    with_ctes("tele", """
SELECT unnest(['column_window_id', 'column_hostname', 'column_aggregated_rules', 'column_total_events', 'column_unique_rules',
  'rules_not_a_map', 'total_events_not_integer', 'unique_rules_not_integer', 'empty_table', 'total_negative', 'label_unknown']) AS "check",
  unnest([0, 0, 0, 0, 0, 0, 0, 0, (SELECT CASE WHEN count(*) = 0 THEN 1 ELSE 0 END FROM tele), 0, 0])::BIGINT AS violations"""),
)
def check_windows(spark, sf):
    return filters.check_windows(agg.aggregate_windows(telemetry(spark, sf), 1440))


@query(
    "time_range",
    with_ctes("tele", f"""
SELECT event_id, hostname, {plain('ts')} AS timestamp FROM tele
WHERE ts >= TIMESTAMP '2024-01-05 00:00:00' AND ts < TIMESTAMP '2024-01-12 12:00:00' AND hostname = 'host-2'"""),
)
def time_range(spark, sf):
    found = filters.time_range(telemetry(spark, sf), "2024-01-05 00:00:00", "2024-01-12 12:00:00", hostname="host-2")
    return texts(found.select("event_id", "hostname", "timestamp"), "timestamp")


@query(
    "has_host",
    with_ctes("tele", f"""
SELECT DISTINCT strftime({hstart('ts', 60)}, '%Y-%m-%d_%H-%M-%S') AS window_id FROM tele WHERE hostname = 'host-4'"""),
)
def has_host(spark, sf):
    from trigwatch.sources.documents import has_host as keep

    return keep(window_docs(spark, sf), "host-4").select(F.col("_id").alias("window_id"))


@query(
    "query_results",
    with_ctes("results", f"""
SELECT window_id, hostname, predicted_label, confidence, {plain('prediction_time')} AS prediction_time FROM results
WHERE prediction_time >= TIMESTAMP '2024-01-03' AND prediction_time < TIMESTAMP '2024-01-25' AND predicted_label = 1 AND confidence >= 0.35"""),
)
def query_results(spark, sf):
    return texts(filters.query_results(stored_results(spark, sf), "2024-01-03", "2024-01-25", 1, 0.35), "prediction_time")


@query(
    "query_events",
    with_ctes("tele", f"""
SELECT event_id, hostname, rule_id, {plain('ts')} AS timestamp FROM tele
WHERE ts >= TIMESTAMP '2024-01-03' AND ts < TIMESTAMP '2024-01-25' AND hostname = 'host-1' ORDER BY ts DESC, event_id LIMIT 100"""),
)
def query_events(spark, sf):
    found = filters.query_events(telemetry(spark, sf), "2024-01-03", "2024-01-25", hostname="host-1", limit=100)
    return texts(found.select("event_id", "hostname", "rule_id", "timestamp"), "timestamp")


@query(
    "query_windows",
    with_ctes("tele", f"""
SELECT DISTINCT strftime({hstart('ts', 60)}, '%Y-%m-%d_%H-%M-%S') AS window_id FROM tele
WHERE hostname = 'host-4' AND {hstart('ts', 60)} < TIMESTAMP '2024-01-20' AND {hstart('ts', 60)} >= TIMESTAMP '2024-01-02'"""),
)
def query_windows(spark, sf):
    stored = window_docs(spark, sf).withColumnRenamed("_id", "window_id")
    return filters.query_windows(stored, "2024-01-02", "2024-01-20", "host-4").select("window_id")


@query(
    "labelled_windows",
    with_ctes("windows", """
SELECT window_id, hostname, label FROM windows WHERE window_start >= TIMESTAMP '2024-01-04' AND window_end <= TIMESTAMP '2024-01-20' AND label IS NOT NULL"""),
)
def labelled_windows(spark, sf):
    return filters.labelled_windows(stored_windows(spark, sf), "2024-01-04", "2024-01-20").select("window_id", "hostname", "label")


@query(
    "windows_contained",
    with_ctes("windows", """
SELECT window_id, hostname FROM windows WHERE window_start > TIMESTAMP '2024-01-04' AND window_end < TIMESTAMP '2024-01-20' AND label IS NULL"""),
)
def windows_contained(spark, sf):
    # bounds in the wrong order on purpose
    return filters.windows_contained(stored_windows(spark, sf), "2024-01-20", "2024-01-04").select("window_id", "hostname")


@query(
    "latest_windows",
    with_ctes("windows", "SELECT window_id, CAST(sum(total_events) AS BIGINT) AS total FROM windows GROUP BY 1 ORDER BY 1 DESC LIMIT 2"),
)
def latest_windows(spark, sf):
    per_window = stored_windows(spark, sf).groupBy("window_id").agg(F.sum("total_events").alias("total"))
    return filters.latest_windows(per_window, 2)


@query(
    "window_by_id",
    with_ctes("windows", "SELECT window_id, hostname, total_events FROM windows WHERE window_id = '2024-01-08_06-00-00_W1'"),
)
def window_by_id(spark, sf):
    return filters.window_by_id(stored_windows(spark, sf), "2024-01-08_06-00-00_W1").select("window_id", "hostname", "total_events")


@query(
    "source_event_filter",
    with_ctes("tele", """
SELECT event_id FROM tele WHERE hostname IS NOT NULL AND source_label = 'normal' AND event_type IN ('click', 'view') AND rule_id IN (100001, 100002, 100003)
  AND ts >= TIMESTAMP '2024-01-02' AND ts < TIMESTAMP '2024-01-28'"""),
)
def source_event_filter(spark, sf):
    return filters.source_event_filter(
        telemetry(spark, sf), ["hostname"], {"source_label": "normal"},
        {"event_type": ["click", "view"], "rule_id": [100001, 100002, 100003]}, "2024-01-02", "2024-01-28",
    ).select("event_id")


@query("nonfinite_rows", "SELECT event_id FROM events WHERE event_id % 10 IN (1, 2, 3)")
def nonfinite_rows(spark, sf):
    kind = F.col("event_id") % 10
    broken = table(spark, sf, "events").select(
        "event_id",
        F.when(kind == 1, float("nan")).when(kind == 2, float("inf")).otherwise(F.col("value")).alias("a"),
        F.when(kind == 3, float("-inf")).otherwise(F.col("value")).alias("b"),
    )
    return filters.nonfinite_rows(broken, ["a", "b"]).select("event_id")


@query("drop_zero_importance", "SELECT vec_id, pos FROM (SELECT vec_id, generate_subscripts(embedding, 1) - 1 AS pos, unnest(embedding) AS x FROM embeddings) WHERE x > 0")
def drop_zero_importance(spark, sf):
    long = embeddings_long(spark, sf).withColumnRenamed("value", "importance")
    return filters.drop_zero_importance(long).select("vec_id", F.col("feature_idx").cast("bigint").alias("pos"))


@query("exclude_names", with_ctes("cat", f"SELECT rule_id FROM cat WHERE name NOT LIKE '%{MARKER}%'"))
def exclude_names(spark, sf):
    return filters.exclude_names(catalog(spark, sf), MARKER, "name").select("rule_id")


@query(
    "union_distinct",
    with_ctes("tele scores", "SELECT event_id FROM scores WHERE score > 0.2 UNION SELECT event_id FROM tele WHERE source_label = 'attack'"),
)
def union_distinct(spark, sf):
    flagged = scores(spark, sf).where("score > 0.2").select("event_id")
    attacks = telemetry(spark, sf).where(cleaning.label_binary(F.col("source_label")) == 1).select("event_id")
    return flagged.union(attacks).distinct()
