"""Ranking behind alerts, alert texts and detection."""

from __future__ import annotations

from pyspark.sql import functions as F

from trigwatch.functions import naming
from trigwatch.operators import ranking, store
from trigwatch.plans.lookups import EXPANDED, expanded
from trigwatch.plans.registry import query
from trigwatch.plans.tables import (
    KEYWORD, MARKER, PREFIX, catalog, embeddings_long, plain, rounded, scratch, telemetry, texts, wid, windowed, with_ctes,
)

# Attributions: the embedding values, one alert per vector.
RANKED = """rk AS (SELECT vec_id, pos, x, row_number() OVER (PARTITION BY vec_id ORDER BY abs(x) DESC, pos) AS rank FROM emb)"""


def attributions(spark, sf):
    return embeddings_long(spark, sf).withColumnRenamed("value", "attribution")


@query("rank_attributions", with_ctes("emb", f"WITH {RANKED} SELECT vec_id, pos, x AS attribution, rank FROM rk WHERE rank <= 10"))
def rank_attributions(spark, sf):
    found = ranking.rank_attributions(attributions(spark, sf), ["vec_id"], 10)
    return found.select("vec_id", F.col("feature_idx").cast("bigint").alias("pos"), "attribution", F.col("rank").cast("bigint").alias("rank"))


@query("mean_abs_attribution", with_ctes("emb", "SELECT pos, round(avg(abs(x)), 6) AS importance FROM emb GROUP BY pos"))
def mean_abs_attribution(spark, sf):
    found = ranking.mean_abs_attribution(attributions(spark, sf)).select(F.col("feature_idx").cast("bigint").alias("pos"), "importance")
    return rounded(found, "importance")


# Every vector's positions as ranked items; the bucket depends on vector and position, some
# vectors have no item of bucket 0 or 1, and negative values count as zero importance.
ITEM_BUCKET = "CASE WHEN vec_id % 4 = 0 THEN 2 + pos % 2 ELSE (pos + vec_id) % 4 END"
ITEMS = f"""items AS (SELECT vec_id, pos, greatest(x, 0) AS importance, {ITEM_BUCKET} AS bucket, row_number() OVER (PARTITION BY vec_id ORDER BY abs(x) DESC, pos) AS rank FROM emb)"""


def items(spark, sf):
    ranked = ranking.rank_attributions(attributions(spark, sf), ["vec_id"], 64)
    bucket = F.when(F.col("vec_id") % 4 == 0, 2 + F.col("feature_idx") % 2).otherwise((F.col("feature_idx") + F.col("vec_id")) % 4)
    return ranked.withColumns({"bucket": bucket, "importance": F.greatest("attribution", F.lit(0.0))})


@query(
    "prioritize_topk",
    with_ctes("emb", f"""
WITH {ITEMS}, marked AS (SELECT *, max(CASE WHEN importance > 0 AND bucket <= 1 THEN 1 ELSE 0 END) OVER (PARTITION BY vec_id) AS special,
  max(CASE WHEN importance > 0 THEN 1 ELSE 0 END) OVER (PARTITION BY vec_id) AS any_pos FROM items),
o AS (SELECT vec_id, pos, row_number() OVER (PARTITION BY vec_id ORDER BY CASE WHEN special = 1 THEN least(bucket, 2) ELSE 0 END, rank) AS new_rank
  FROM marked WHERE any_pos = 1 AND (importance > 0 OR special = 0))
SELECT vec_id, pos, new_rank FROM o WHERE new_rank <= 5"""),
)
def prioritize_topk(spark, sf):
    found = ranking.prioritize_topk(items(spark, sf), ["vec_id"], 5)
    return found.select("vec_id", F.col("feature_idx").cast("bigint").alias("pos"), F.col("new_rank").cast("bigint").alias("new_rank"))


@query(
    "prioritize_topk_strict",
    with_ctes("emb", f"""
WITH {ITEMS}, o AS (SELECT vec_id, pos, row_number() OVER (PARTITION BY vec_id ORDER BY bucket, rank) AS new_rank FROM items WHERE importance > 0)
SELECT vec_id, pos, new_rank FROM o WHERE new_rank <= 5"""),
)
def prioritize_topk_strict(spark, sf):
    found = ranking.prioritize_topk(items(spark, sf), ["vec_id"], 5, mode="strict")
    return found.select("vec_id", F.col("feature_idx").cast("bigint").alias("pos"), F.col("new_rank").cast("bigint").alias("new_rank"))


BUCKET = """CASE WHEN (lower(coalesce(name, '')) LIKE 'orb^_%' ESCAPE '^' OR lower(feature) LIKE 'family^_orb^_%' ESCAPE '^') AND lower(coalesce(name, '')) LIKE '%beacon%' THEN 0
  WHEN lower(coalesce(name, '')) LIKE 'orb^_%' ESCAPE '^' OR lower(feature) LIKE 'family^_orb^_%' ESCAPE '^' THEN 1
  WHEN lower(coalesce(name, '')) LIKE '%beacon%' THEN 2 ELSE 3 END"""


@query(
    "finalize_rules",
    with_ctes("tele fam", f"""
WITH {EXPANDED}, b AS (SELECT *, {BUCKET} AS priority_bucket, round(importance, 9) AS imp FROM shown WHERE display_name NOT LIKE '%{MARKER}%'),
o AS (SELECT window_id, hostname, display_name, priority_bucket, feature,
  row_number() OVER (PARTITION BY window_id, hostname ORDER BY priority_bucket, imp DESC, coalesce(rule_id, 0), feature) AS rank FROM b)
SELECT window_id, hostname, display_name, priority_bucket, feature, rank FROM o WHERE rank <= 5"""),
)
def finalize_rules(spark, sf):
    shown = expanded(spark, sf).withColumns(
        {
            "priority_bucket": naming.priority_bucket(F.col("rule_name"), F.col("feature"), PREFIX, KEYWORD),
            "importance": F.round("importance", 9),
            "tie": F.struct(F.coalesce("rule_id", F.lit(0)), F.col("feature")),
        }
    )
    found = ranking.finalize_rules(shown, ["window_id", "hostname"], 5, MARKER, tie="tie")
    return found.select(
        "window_id", "hostname", "display_name", "priority_bucket", "feature", F.col("rank").cast("bigint").alias("rank")
    )


@query("top_by_value", with_ctes("emb", """
SELECT vec_id, pos, rank FROM (SELECT vec_id, pos, row_number() OVER (PARTITION BY vec_id ORDER BY x DESC, pos) AS rank FROM emb WHERE x > 0) WHERE rank <= 5"""))
def top_by_value(spark, sf):
    found = ranking.top_by_value(embeddings_long(spark, sf), ["vec_id"], 5)
    return found.select("vec_id", F.col("feature_idx").cast("bigint").alias("pos"), F.col("rank").cast("bigint").alias("rank"))


IMPORTANCE = "imp AS (SELECT rule_id, name, rule_id - 100000 AS feature_idx, coalesce(n, 0) AS importance FROM cat LEFT JOIN (SELECT rule_id, count(*) AS n FROM tele GROUP BY 1) USING (rule_id))"


def importances(spark, sf):
    fired = telemetry(spark, sf).groupBy("rule_id").agg(F.count(F.lit(1)).alias("n"))
    return catalog(spark, sf).join(fired, "rule_id", "left").select(
        "rule_id", F.col("name").alias("rule_name"), (F.col("rule_id") - 100000).alias("feature_idx"), F.coalesce("n", F.lit(0)).alias("importance")
    )


@query(
    "importance_top10",
    with_ctes("tele cat", f"""
WITH {IMPORTANCE} SELECT rule_id, importance, CASE WHEN lower(name) LIKE '%orb%' THEN 1 ELSE 0 END AS prior FROM imp WHERE importance > 0
ORDER BY 3 DESC, importance DESC, feature_idx LIMIT 10"""),
)
def importance_top10(spark, sf):
    return ranking.importance_top(importances(spark, sf), 10, ["orb", "odd pairing", "driftpattern"]).select("rule_id", "importance", "prior")


@query("top_n_importance", with_ctes("tele cat", f"WITH {IMPORTANCE} SELECT rule_id, importance FROM imp ORDER BY importance DESC, rule_id LIMIT 20"))
def top_n_importance(spark, sf):
    return ranking.top_n_importance(importances(spark, sf)).select("rule_id", "importance")


def alerts(spark, sf):
    """Alerted windows with their three largest rules as payload entries."""
    t = telemetry(spark, sf)
    base = windowed(
        t, 360, ["hostname"], (F.floor(F.max("value") / 5).cast("double") / 100).alias("confidence"),
        F.min("source_ip").alias("source_ip"), F.min("timestamp").alias("first_time"),
    ).where("confidence > 0.4")
    t = windowed(t, 360, ["hostname", "rule_id"], F.sum("count").alias("count"))
    top = ranking.top_rules_per_window(t, 3, ["window_id", "hostname"]).groupBy("window_id", "hostname").agg(
        F.sort_array(F.collect_list(F.struct("rank", "rule_id", "count"))).alias("top")  # at most three per alert
    )
    return base.join(top, ["window_id", "hostname"])


ALERTS = f"""t AS (SELECT *, {wid('ts', 360)} AS window_id FROM tele),
base AS (SELECT window_id, hostname, floor(max(value) / 5) / 100 AS confidence, min(source_ip) AS source_ip, min(ts) AS first_time FROM t GROUP BY 1, 2 HAVING floor(max(value) / 5) / 100 > 0.4),
rk AS (SELECT window_id, hostname, rule_id, s, row_number() OVER (PARTITION BY window_id, hostname ORDER BY s DESC, rule_id) AS rank
  FROM (SELECT window_id, hostname, rule_id, sum(cnt) AS s FROM t GROUP BY 1, 2, 3))"""


@query(
    "leef_lines",
    with_ctes("tele", f"""
WITH {ALERTS}, f AS (SELECT window_id, hostname, string_agg(CAST(rank AS VARCHAR) || ':rule_' || CAST(rule_id AS VARCHAR) || ':' || CAST(s AS VARCHAR) || '.0000', ';' ORDER BY rank) AS tops,
  min('rule_' || CAST(rule_id AS VARCHAR) || ':' || CAST(s AS VARCHAR) || '.0000') FILTER (rank = 1) AS best FROM rk WHERE rank <= 3 GROUP BY 1, 2)
SELECT window_id, hostname, 'LEEF:2.0|Example|Detector|1.0|ATTACK_DETECTION|High|name=Malicious Threat Detection' || chr(9) || 'hostname=' || hostname || chr(9) || 'windowId=' || window_id
  || chr(9) || 'model=RandomForestClassifier' || chr(9) || 'instances=1' || chr(9) || 'features=20' || chr(9) || 'timestamp=' || {plain('first_time')} || chr(9) || 'prediction=Attack'
  || chr(9) || 'confidencePct=' || printf('%.1f', confidence * 100) || '%' || chr(9) || 'topFeatures=' || tops || chr(9) || 'mostCritical=' || best AS line
FROM base JOIN f USING (window_id, hostname)"""),
)
def leef_lines(spark, sf):
    features = F.transform(
        "top", lambda e: F.struct(F.concat(F.lit("rule_"), e["rule_id"].cast("string")).alias("display"), e["count"].cast("double").alias("importance"))
    )
    ready = alerts(spark, sf).select(
        "window_id", "hostname", "confidence", F.lit("attack").alias("prediction"), F.col("first_time").alias("prediction_time"),
        F.lit(20).alias("feature_count"), features.alias("top_features"),
    )
    lines = ranking.leef_lines(ready, ranking.leef_header("Example", "Detector")).select("window_id", "hostname", "line")
    path = scratch(spark, "leef")
    store.save_lines(lines, "line", path)
    return lines


@query(
    "alert_payload_json",
    with_ctes("tele", f"""
WITH {ALERTS}, f AS (SELECT window_id, hostname, string_agg('{{"rule_id-' || CAST(rank AS VARCHAR) || '":"' || CAST(rule_id AS VARCHAR) || '","value-' || CAST(rank AS VARCHAR) || '":"' || CAST(s AS VARCHAR) || '"}}', ',' ORDER BY rank) AS tops
  FROM rk WHERE rank <= 3 GROUP BY 1, 2)
SELECT '{{"hostname":"' || hostname || '","source_ip":"' || source_ip || '","window_id":"' || window_id || '","confidence":' || CAST(confidence AS VARCHAR) || ',"top_rules_by_count":[' || tops || ']}}' AS payload
FROM base JOIN f USING (window_id, hostname)"""),
)
def alert_payload_json(spark, sf):
    entries = F.transform("top", lambda e: F.struct(e["rule_id"].alias("rule_id"), e["count"].alias("value")))
    ready = alerts(spark, sf).withColumn("top_rules", entries)
    path = scratch(spark, "payloads")
    store.save_lines(ranking.alert_payload_json(ready), "payload", path)
    return spark.read.text(path).withColumnRenamed("value", "payload")


def scored_windows(spark, sf):
    return windowed(
        telemetry(spark, sf), 360, ["hostname"], (F.floor(F.max("value") / 5).cast("double") / 100).alias("probability"),
        F.max((F.col("event_type") == "error").cast("int")).alias("predicted_label"),
    )


SCORED = f"sw AS (SELECT {wid('ts', 360)} AS window_id, hostname, floor(max(value) / 5) / 100 AS probability, max(CASE WHEN event_type = 'error' THEN 1 ELSE 0 END) AS predicted_label FROM tele GROUP BY 1, 2)"


@query(
    "detect",
    with_ctes("tele", f"WITH {SCORED} SELECT window_id, hostname, probability, predicted_label, CASE WHEN probability > 0.35 THEN 1 ELSE 0 END AS is_alert FROM sw"),
)
def detect(spark, sf):
    return ranking.detect(scored_windows(spark, sf), 0.35).withColumn("is_alert", F.col("is_alert").cast("int"))


@query(
    "detection_counts",
    with_ctes("tele", f"""
WITH {SCORED} SELECT count(*) AS total_windows, count(*) FILTER (probability > 0.35) AS alerts, count(*) FILTER (predicted_label = 1) AS predicted_attack,
  round(avg(probability) FILTER (probability > 0.35), 6) AS mean_alert_confidence FROM sw"""),
)
def detection_counts(spark, sf):
    return rounded(ranking.detection_counts(ranking.detect(scored_windows(spark, sf), 0.35)), "mean_alert_confidence")


@query(
    "top_rules_per_alert",
    with_ctes("tele", f"""
WITH {ALERTS} SELECT window_id, hostname, rule_id, CAST(s AS BIGINT) AS count, rank, {plain('first_time')} AS first_time
FROM rk JOIN base USING (window_id, hostname) WHERE rank <= 3"""),
)
def top_rules_per_alert(spark, sf):
    flat = alerts(spark, sf).select("window_id", "hostname", "first_time", F.explode("top").alias("t"))
    return texts(flat.select("window_id", "hostname", "first_time", "t.rule_id", "t.count", F.col("t.rank").cast("bigint").alias("rank")), "first_time")
