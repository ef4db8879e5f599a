"""Windows of rule counts and their summaries."""

from __future__ import annotations

from pyspark.sql import functions as F

from trigwatch.functions import timing
from trigwatch.operators import aggregates as agg
from trigwatch.operators import ranking
from trigwatch.plans.registry import query
from trigwatch.plans.tables import hstart, plain, rounded, table, telemetry, texts, wend, wid, with_ctes, wstart

KEYS_SQL = f"{wid('ts', 1440)} AS window_id, hostname, source_label, source_ip"


@query(
    "aggregate_windows",
    with_ctes("tele", f"""
SELECT {KEYS_SQL}, rule_id, CAST(sum(cnt) AS BIGINT) AS count, round(sum(ln(1 + cnt)), 6) AS log_count,
  CASE WHEN source_label = 'attack' THEN 1 ELSE 0 END AS is_attack
FROM tele GROUP BY ALL"""),
)
def aggregate_windows(spark, sf):
    windows = agg.aggregate_windows(telemetry(spark, sf), 1440)
    rules = windows.select(
        "window_id", "hostname", "source_label", "source_ip", "is_attack",
        F.explode("aggregated_rules").alias("rule_text", "count"), "aggregated_rules_log1p_sum",
    )
    flat = rules.select(
        "window_id", "hostname", "source_label", "source_ip", F.col("rule_text").cast("bigint").alias("rule_id"), "count",
        F.element_at("aggregated_rules_log1p_sum", F.col("rule_text")).alias("log_count"), "is_attack",
    )
    return rounded(flat, "log_count")


@query(
    "aggregate_windows_detect",
    with_ctes("tele", f"""
SELECT {wid('ts', 45)} AS window_id, hostname, source_label, source_ip, CAST(sum(cnt) AS BIGINT) AS total_events,
  {plain(wstart('min(ts)', 45))} AS window_start, {plain(wend('min(ts)', 45))} AS window_end FROM tele GROUP BY 1, 2, 3, 4"""),
)
def aggregate_windows_detect(spark, sf):
    windows = agg.aggregate_windows(telemetry(spark, sf), 45, mode="detect")
    return texts(windows, "window_start", "window_end").select(
        "window_id", "hostname", "source_label", "source_ip", "total_events", "window_start", "window_end"
    )


@query(
    "aggregate_windows_by_file",
    with_ctes("tele", f"""
SELECT 'file-' || CAST(user_id AS VARCHAR) AS window_id, hostname, source_label, CAST(sum(cnt) AS BIGINT) AS total_events,
  count(DISTINCT rule_id) AS unique_rules, {plain('min(ts)')} AS window_start, {plain('max(ts)')} AS window_end FROM tele GROUP BY 1, 2, 3"""),
)
def aggregate_windows_by_file(spark, sf):
    events = telemetry(spark, sf).withColumn("window_id", F.concat(F.lit("file-"), F.col("user_id").cast("string"))).drop("source_ip")
    windows = agg.aggregate_windows(events, window_by="file")
    return texts(windows, "window_start", "window_end").select(
        "window_id", "hostname", "source_label", "total_events", "unique_rules", "window_start", "window_end"
    )


@query(
    "rule_counts",
    with_ctes("tele", f"SELECT {KEYS_SQL}, rule_id, CAST(sum(cnt) AS BIGINT) AS total_count, count(*) AS n_rows FROM tele GROUP BY ALL"),
)
def rule_counts(spark, sf):
    return agg.window_rule_counts(telemetry(spark, sf), 1440).drop("total_log", "first_time", "last_time")


@query(
    "rule_log_counts",
    with_ctes("tele", f"SELECT {KEYS_SQL}, rule_id, round(sum(ln(1 + cnt)), 6) AS total_log FROM tele GROUP BY ALL"),
)
def rule_log_counts(spark, sf):
    rules = agg.window_rule_counts(telemetry(spark, sf), 1440)
    return rounded(rules.select(*agg.KEYS, "rule_id", "total_log"), "total_log")


@query(
    "window_totals",
    with_ctes("tele", f"""
SELECT {KEYS_SQL}, CAST(sum(cnt) AS BIGINT) AS total_events, round(sum(ln(1 + cnt)), 6) AS total_events_log1p, count(DISTINCT rule_id) AS unique_rules,
  {plain('min(ts)')} AS first_time, {plain('max(ts)')} AS last_time FROM tele GROUP BY 1, 2, 3, 4"""),
)
def window_totals(spark, sf):
    totals = agg.window_totals(agg.window_rule_counts(telemetry(spark, sf), 1440))
    return rounded(texts(totals, "first_time", "last_time"), "total_events_log1p")


WINDOWED = f"w AS (SELECT {KEYS_SQL}, sum(cnt) AS total_events, count(DISTINCT rule_id) AS unique_rules FROM tele GROUP BY 1, 2, 3, 4)"


@query(
    "window_stats",
    with_ctes("tele", f"""
WITH {WINDOWED} SELECT count(*) AS total_windows, count(DISTINCT hostname) AS unique_hosts, CAST(sum(total_events) AS BIGINT) AS total_events,
  round(avg(total_events), 6) AS avg_events_per_window, round(avg(unique_rules), 6) AS avg_rules_per_window,
  CAST(max(total_events) AS BIGINT) AS max_events_per_window, CAST(min(total_events) AS BIGINT) AS min_events_per_window,
  max(unique_rules) AS max_rules_per_window, min(unique_rules) AS min_rules_per_window,
  count(*) FILTER (source_label = 'attack') AS attack_windows, count(*) FILTER (source_label = 'normal') AS normal_windows,
  round(avg(CASE WHEN source_label = 'attack' THEN 1.0 ELSE 0.0 END), 6) AS attack_ratio FROM w"""),
)
def window_stats(spark, sf):
    totals = agg.window_totals(agg.window_rule_counts(telemetry(spark, sf), 1440))
    return rounded(agg.window_stats(totals), "avg_events_per_window", "avg_rules_per_window", "attack_ratio")


@query(
    "common_rules",
    with_ctes("tele", f"""
SELECT rule_id, count(*) AS n_windows FROM (SELECT DISTINCT {KEYS_SQL}, rule_id FROM tele) GROUP BY rule_id ORDER BY 2 DESC, 1 LIMIT 10"""),
)
def common_rules(spark, sf):
    return agg.common_rules(agg.aggregate_windows(telemetry(spark, sf), 1440))


@query(
    "window_documents",
    with_ctes("tele", f"""
WITH h AS (SELECT {hstart('ts', 30)} AS w, hostname, sum(cnt) AS host_total, count(DISTINCT rule_id) AS host_rules FROM tele GROUP BY 1, 2),
v AS (SELECT {hstart('ts', 30)} AS w, sum(cnt) AS total, count(DISTINCT rule_id) AS n_rules FROM tele GROUP BY 1)
SELECT strftime(w, '%Y-%m-%d_%H-%M-%S') AS window_id, {plain('w + INTERVAL 30 MINUTE')} AS window_end, hostname, CAST(host_total AS BIGINT) AS host_total, host_rules,
  CAST(total AS BIGINT) AS total_triggers, n_rules AS total_rules_triggered FROM h JOIN v USING (w)"""),
)
def window_documents(spark, sf):
    docs = agg.window_documents(agg.ingest_windows(telemetry(spark, sf), 30), 30)
    flat = docs.select(
        F.col("_id").alias("window_id"), "window_end", F.explode("host_triggers").alias("hostname", "h"), "total_triggers", "total_rules_triggered"
    )
    return texts(flat, "window_end").select(
        "window_id", "window_end", "hostname", F.col("h.total_triggers").alias("host_total"),
        F.size("h.rules").cast("bigint").alias("host_rules"), "total_triggers", "total_rules_triggered",
    )


@query(
    "majority_ip",
    with_ctes("tele", f"""
SELECT strftime(w, '%Y-%m-%d_%H-%M-%S') AS window_id, hostname, source_ip, CAST(total AS BIGINT) AS total_triggers FROM (
  SELECT w, hostname, source_ip, sum(s) OVER (PARTITION BY w, hostname) AS total, row_number() OVER (PARTITION BY w, hostname ORDER BY s DESC, source_ip) AS rn
  FROM (SELECT {hstart('ts', 60)} AS w, hostname, source_ip, sum(cnt) AS s FROM tele GROUP BY 1, 2, 3)) WHERE rn = 1"""),
)
def majority_ip(spark, sf):
    return agg.named(agg.majority_ip(agg.ingest_windows(telemetry(spark, sf), 60))).select("window_id", "hostname", "source_ip", "total_triggers")


def small_windows(spark, sf):
    return agg.host_rule_counts(agg.ingest_windows(telemetry(spark, sf), 15))


@query(
    "reaggregate",
    with_ctes("tele", f"""
SELECT {plain(wstart('ts', 120))} AS bucket, hostname, rule_id, CAST(sum(cnt) AS BIGINT) AS count, {plain('min(' + hstart('ts', 15) + ')')} AS first_time
FROM tele GROUP BY 1, 2, 3"""),
)
def reaggregate(spark, sf):
    return texts(agg.reaggregate(small_windows(spark, sf), 120), "bucket", "first_time")


@query(
    "source_trigger_query",
    with_ctes("tele", f"""
SELECT hostname, source_ip, r AS rule_id, {plain('min(ts)')} AS first_time, count(*) AS count
FROM (SELECT hostname, source_ip, ts, unnest([rule_id, rule_id + 1, rule_id + 2]) AS r FROM tele) GROUP BY 1, 2, 3"""),
)
def source_trigger_query(spark, sf):
    t = telemetry(spark, sf).withColumn("rules", F.array("rule_id", F.col("rule_id") + 1, F.col("rule_id") + 2))
    return texts(agg.source_trigger_query(t), "first_time")


@query(
    "pivot_rules",
    with_ctes("tele", f"SELECT {wid('ts', 1440)} AS window_id, hostname, " + ", ".join(
        f"CAST(coalesce(sum(cnt) FILTER (rule_id = {100000 + i}), 0) AS BIGINT) AS rule_{100000 + i}" for i in range(20)) + " FROM tele GROUP BY 1, 2"),
)
def pivot_rules(spark, sf):
    t = telemetry(spark, sf).withColumn("window_id", timing.window_id(F.col("timestamp"), 1440))
    return agg.pivot_rules(t, ["window_id", "hostname"], range(100000, 100020))


@query(
    "top_rules_per_window",
    with_ctes("tele", f"""
SELECT window_id, rule_id, CAST(s AS BIGINT) AS count, rn AS rank FROM (
  SELECT *, row_number() OVER (PARTITION BY window_id ORDER BY s DESC, rule_id) AS rn
  FROM (SELECT {wid('ts', 360)} AS window_id, rule_id, sum(cnt) AS s FROM tele GROUP BY 1, 2)) WHERE rn <= 5"""),
)
def top_rules_per_window(spark, sf):
    t = telemetry(spark, sf).withColumn("window_id", timing.window_id(F.col("timestamp"), 360))
    return ranking.top_rules_per_window(t).withColumn("rank", F.col("rank").cast("bigint"))


@query(
    "label_distribution",
    with_ctes("tele", "SELECT source_label AS label, count(*) AS n FROM tele GROUP BY 1"),
)
def label_distribution(spark, sf):
    from trigwatch.operators.metrics import label_distribution as count

    return count(telemetry(spark, sf).withColumnRenamed("source_label", "label"))


@query(
    "ordered_query",
    with_ctes("tele", f"""
SELECT {plain(wstart('ts', 120))} AS bucket, hostname, rule_id, CAST(sum(cnt) AS BIGINT) AS count FROM tele GROUP BY 1, 2, 3"""),
)
def ordered_query(spark, sf):
    from trigwatch.operators.store import ordered_export

    rows = agg.reaggregate(small_windows(spark, sf), 120)
    return texts(ordered_export(rows), "bucket").select("bucket", "hostname", "rule_id", "count")


@query("union_all", "SELECT event_type, count(*) AS n FROM (SELECT event_type FROM events WHERE value > 50 UNION ALL SELECT event_type FROM events) GROUP BY 1")
def union_all(spark, sf):
    e = table(spark, sf, "events")
    return e.where("value > 50").unionByName(e).groupBy("event_type").agg(F.count(F.lit(1)).alias("n"))


@query(
    "sliding_windows",
    with_ctes("tele", f"""
SELECT strftime(b - back, '%Y-%m-%d %H:%M:%S') AS window_start, hostname, rule_id, CAST(sum(cnt) AS BIGINT) AS count FROM (
  SELECT {wstart('ts', 15)} AS b, hostname, rule_id, cnt, unnest([INTERVAL 0 MINUTE, INTERVAL 15 MINUTE]) AS back FROM tele) GROUP BY 1, 2, 3"""),
)
def sliding_windows(spark, sf):
    from trigwatch.streaming.windows import sliding_counts

    counted = sliding_counts(telemetry(spark, sf), "30 minutes", "15 minutes", ["hostname", "rule_id"])
    return texts(counted, "window_start").select("window_start", "hostname", "rule_id", "count")
