"""Joins with catalogue, translations, jobs, hosts and calendar."""

from __future__ import annotations

from pyspark.sql import functions as F

from trigwatch.functions import naming, timing
from trigwatch.operators import aggregates as agg
from trigwatch.operators import lookups
from trigwatch.plans.registry import query
from trigwatch.plans.tables import (
    FAMILY_PATTERNS, catalog, id_map, plain, rounded, stored_windows, table, telemetry, texts, wid, windowed, with_ctes, wstart,
)
from trigwatch.sources.jobs import window_calendar


def families(spark, sf):
    return lookups.catalog_families(catalog(spark, sf), FAMILY_PATTERNS)


def raw_ids(spark, sf):
    """Beacon whose ids are still in the test environment's numbering for every third event."""
    rule = F.when(F.col("event_id") % 3 == 0, F.col("rule_id") + 100000).otherwise(F.col("rule_id"))
    return telemetry(spark, sf).withColumn("rule_id", rule)


RAW_SQL = "raw AS (SELECT event_id, user_id, CASE WHEN event_id % 3 = 0 THEN rule_id + 100000 ELSE rule_id END AS rule_id FROM tele)"


@query(
    "translate_ids",
    with_ctes("tele idmap", f"""
WITH {RAW_SQL} SELECT event_id, coalesce(prod_rule_id, rule_id) AS rule_id FROM raw LEFT JOIN idmap ON rule_id = uat_rule_id"""),
)
def translate_ids(spark, sf):
    return lookups.translate_ids(raw_ids(spark, sf), id_map(spark, sf)).select("event_id", "rule_id")


@query(
    "translate_uat_files",
    with_ctes("tele idmap", f"""
WITH {RAW_SQL} SELECT event_id, CASE WHEN user_id % 2 = 0 THEN coalesce(prod_rule_id, rule_id) ELSE rule_id END AS rule_id
FROM raw LEFT JOIN idmap ON rule_id = uat_rule_id"""),
)
def translate_uat_files(spark, sf):
    path = F.when(F.col("user_id") % 2 == 0, "/data/UAT/a.csv").otherwise("/data/UAT2/a.csv")
    rows = raw_ids(spark, sf).withColumn("path", path)
    return lookups.translate_uat_files(rows, id_map(spark, sf), "path").select("event_id", "rule_id")


@query(
    "prod_rule_universe",
    with_ctes("tele idmap cat", f"""
WITH {RAW_SQL}, ids AS (SELECT rule_id FROM raw UNION SELECT rule_id FROM cat)
SELECT DISTINCT coalesce(prod_rule_id, rule_id) AS rule_id FROM ids LEFT JOIN idmap ON rule_id = uat_rule_id"""),
)
def prod_rule_universe(spark, sf):
    ids = raw_ids(spark, sf).select("rule_id").union(catalog(spark, sf).select("rule_id"))
    return lookups.prod_rule_universe(ids.distinct(), id_map(spark, sf))


@query(
    "join_family",
    with_ctes("tele fam", "SELECT event_id, rule_id, coalesce(family, 'Uncategorized') AS family FROM tele LEFT JOIN fam USING (rule_id)"),
)
def join_family(spark, sf):
    return lookups.join_family(telemetry(spark, sf), families(spark, sf)).select("event_id", "rule_id", "family")


@query(
    "enrich_rule_names",
    with_ctes("tele cat", "SELECT event_id, rule_id, name AS rule_name FROM tele LEFT JOIN cat USING (rule_id)"),
)
def enrich_rule_names(spark, sf):
    names = catalog(spark, sf).withColumnRenamed("name", "rule_name")
    return lookups.enrich_rule_names(telemetry(spark, sf), names).select("event_id", "rule_id", "rule_name")


@query(
    "catalog_families",
    with_ctes("fam", """
SELECT rule_id, CASE WHEN rule_id % 10 = 0 THEN p_brand ELSE family END AS family FROM fam JOIN part ON rule_id = 100000 + p_partkey"""),
)
def catalog_families(spark, sf):
    overrides = table(spark, sf, "part").where("p_partkey % 10 = 0").select(
        (100000 + F.col("p_partkey")).alias("rule_id"), F.col("p_brand").alias("family")
    )
    return lookups.catalog_families(catalog(spark, sf), FAMILY_PATTERNS, overrides).select("rule_id", "family")


@query(
    "rules_by_family",
    with_ctes("fam", """
SELECT family, array_to_string(list_sort(list(rule_id)), ',') AS rules, count(*) AS n_rules FROM fam GROUP BY family"""),
)
def rules_by_family(spark, sf):
    return lookups.rules_by_family(families(spark, sf)).select(
        "family", F.array_join(F.col("rule_ids").cast("array<string>"), ",").alias("rules"), "n_rules"
    )


@query("uncategorized_rules", with_ctes("fam", "SELECT rule_id FROM fam WHERE family = 'Uncategorized'"))
def uncategorized_rules(spark, sf):
    return lookups.uncategorized_rules(families(spark, sf))


@query(
    "rule_coverage",
    with_ctes("tele idmap cat", f"""
WITH {RAW_SQL}, used AS (SELECT DISTINCT coalesce(prod_rule_id, rule_id) AS rule_id FROM raw LEFT JOIN idmap ON rule_id = uat_rule_id)
SELECT count(*) FILTER (u.rule_id IS NOT NULL AND c.rule_id IS NOT NULL) AS present_rules, count(*) FILTER (u.rule_id IS NULL) AS missing_rules,
  count(*) FILTER (c.rule_id IS NULL) AS unknown_rules FROM used u FULL JOIN cat c ON u.rule_id = c.rule_id"""),
)
def rule_coverage(spark, sf):
    return lookups.rule_coverage(raw_ids(spark, sf), catalog(spark, sf), id_map(spark, sf))


@query("intersect_rules", with_ctes("tele cat", "SELECT rule_id FROM tele INTERSECT SELECT rule_id FROM cat"))
def intersect_rules(spark, sf):
    return lookups.present_rules(telemetry(spark, sf), catalog(spark, sf))


@query("except_rules", with_ctes("tele cat", "SELECT rule_id FROM tele EXCEPT SELECT rule_id FROM cat"))
def except_rules(spark, sf):
    return lookups.unknown_rules(telemetry(spark, sf), catalog(spark, sf))


def alert_features(spark, sf):
    """Alerted day windows, each with three family features and one rule feature."""
    alerts = windowed(
        telemetry(spark, sf), 1440, ["hostname"], F.max("value").alias("top"), F.min("rule_id").alias("low_rule")
    ).where("top > 100")
    feature = F.explode(
        F.array(
            F.struct(F.lit("family_ORB_7xx").alias("feature"), (F.col("top") / 100).alias("importance")),
            F.struct(F.lit("family_ORB_700xx").alias("feature"), (F.col("top") / 200).alias("importance")),
            F.struct(F.lit("family_other").alias("feature"), (F.col("top") / 300).alias("importance")),
            F.struct(F.concat(F.lit("rule_"), F.col("low_rule").cast("string")).alias("feature"), (F.col("top") / 400).alias("importance")),
        )
    )
    return alerts.select("window_id", "hostname", feature.alias("f")).select("window_id", "hostname", "f.*")


def window_rules(spark, sf):
    return windowed(telemetry(spark, sf), 1440, ["hostname", "rule_id"], F.sum("count").alias("count"))


ALERT_FEATURES = f"""wr AS (SELECT {wid('ts', 1440)} AS window_id, hostname, rule_id, sum(cnt) AS cnt, max(value) AS top FROM tele GROUP BY ALL),
alerts AS (SELECT window_id, hostname, max(top) AS top, min(rule_id) AS low_rule FROM wr GROUP BY ALL HAVING max(top) > 100),
feats AS (SELECT window_id, hostname, 'family_ORB_7xx' AS feature, 'ORB_7xx' AS family, NULL AS own, top / 100 AS importance FROM alerts
  UNION ALL SELECT window_id, hostname, 'family_ORB_700xx', 'ORB_700xx', NULL, top / 200 FROM alerts
  UNION ALL SELECT window_id, hostname, 'family_other', 'other', NULL, top / 300 FROM alerts
  UNION ALL SELECT window_id, hostname, 'rule_' || CAST(low_rule AS VARCHAR), NULL, low_rule, top / 400 FROM alerts)"""

EXPANDED = f"""{ALERT_FEATURES},
wf AS (SELECT window_id, hostname, wr.rule_id, cnt, coalesce(family, 'Uncategorized') AS family FROM wr LEFT JOIN fam USING (rule_id)),
tot AS (SELECT window_id, hostname, family, sum(cnt) AS total FROM wf GROUP BY ALL),
low AS (SELECT family, min(rule_id) AS fallback FROM fam GROUP BY family),
ex AS (SELECT f.window_id, f.hostname, f.feature, f.family, f.importance, coalesce(f.own, wf.rule_id, low.fallback) AS rule_id,
  CASE WHEN wf.rule_id IS NULL THEN f.importance WHEN tot.total > 0 THEN f.importance * wf.cnt / tot.total ELSE f.importance END AS value
  FROM feats f LEFT JOIN wf ON f.window_id = wf.window_id AND f.hostname = wf.hostname AND f.family = wf.family
  LEFT JOIN tot ON f.window_id = tot.window_id AND f.hostname = tot.hostname AND f.family = tot.family
  LEFT JOIN low ON f.family = low.family),
shown AS (SELECT ex.*, cat.name, CASE WHEN ex.rule_id IS NULL THEN ex.family
    WHEN ex.family IS NOT NULL THEN coalesce(cat.name, CAST(ex.rule_id AS VARCHAR)) || ' (ID:' || CAST(ex.rule_id AS VARCHAR) || ')'
    ELSE coalesce(cat.name || ' (ID:' || CAST(ex.rule_id AS VARCHAR) || ')', CAST(ex.rule_id AS VARCHAR)) END AS display_name
  FROM ex LEFT JOIN cat ON ex.rule_id = cat.rule_id)"""


def expanded(spark, sf):
    names = catalog(spark, sf).withColumnRenamed("name", "rule_name")
    return lookups.expand_families(alert_features(spark, sf), window_rules(spark, sf), families(spark, sf), names)


@query(
    "expand_families",
    with_ctes("tele fam", f"""
WITH {EXPANDED} SELECT window_id, hostname, feature, rule_id, display_name, round(value, 6) AS value FROM shown"""),
)
def expand_families(spark, sf):
    return rounded(expanded(spark, sf).select("window_id", "hostname", "feature", "rule_id", "display_name", "value"), "value")


@query(
    "job_windows",
    with_ctes("windows", """
WITH jobs AS (SELECT 'host-' || CAST(c_custkey % 5 AS VARCHAR) AS hostname, c_custkey AS job_id,
  TIMESTAMP '2024-01-01' + to_hours(CAST(c_custkey % 700 AS INTEGER)) AS s,
  TIMESTAMP '2024-01-01' + to_hours(CAST(c_custkey % 700 + 1 + c_custkey % 40 AS INTEGER)) AS e FROM customer)
SELECT job_id, w.hostname, w.window_id, w.total_events FROM windows w JOIN jobs j ON w.hostname = j.hostname AND window_start >= s AND window_start < e"""),
)
def job_windows(spark, sf):
    key = F.col("c_custkey")
    begin = F.lit("2024-01-01 00:00:00").cast("timestamp_ntz")
    jobs = table(spark, sf, "customer").select(
        F.concat(F.lit("host-"), (key % 5).cast("string")).alias("hostname"),
        key.alias("job_id"),
        (begin + F.make_dt_interval(hours=(key % 700).cast("int"))).alias("start_time"),
        (begin + F.make_dt_interval(hours=(key % 700 + 1 + key % 40).cast("int"))).alias("end_time"),
    )
    return lookups.job_windows(stored_windows(spark, sf), jobs).select("job_id", "hostname", "window_id", "total_events")


@query(
    "protected_hosts",
    with_ctes("tele", "SELECT event_id, CASE WHEN hostname IN ('host-1', 'host-3') THEN 1 ELSE 0 END AS kept FROM tele"),
)
def protected_hosts(spark, sf):
    listed = lookups.host_list(spark, [" host-1", "host-3 ", "  ", "host-1"])
    t = telemetry(spark, sf).select("event_id", "hostname")
    kept = lookups.protected_hosts(t, listed).select("event_id", F.lit(1).alias("kept"))
    return kept.unionByName(lookups.protected_hosts(t, listed, keep=False).select("event_id", F.lit(0).alias("kept")))


@query(
    "calendar_fill",
    with_ctes("tele", f"""
WITH slots AS (SELECT unnest(generate_series(date_trunc('day', min(ts)), date_trunc('day', max(ts)) + INTERVAL 1 DAY - INTERVAL 15 MINUTE, INTERVAL 15 MINUTE)) AS s FROM tele),
w AS (SELECT {wstart('ts', 15)} AS s, count(*) AS n, sum(cnt) AS total FROM tele GROUP BY ALL)
SELECT {plain('s')} AS window_start, coalesce(n, 0) AS n, CAST(coalesce(total, 0) AS BIGINT) AS total FROM slots LEFT JOIN w USING (s)"""),
)
def calendar_fill(spark, sf):
    t = telemetry(spark, sf)
    day = lambda c: F.to_date(c).cast("timestamp_ntz")
    bounds = t.agg(day(F.min("timestamp")).alias("start"), (day(F.max("timestamp")) + F.make_dt_interval(days=F.lit(1))).alias("end"))
    sums = t.groupBy(timing.window_start(F.col("timestamp"), 15).alias("window_start")).agg(
        F.count(F.lit(1)).alias("n"), F.sum("count").alias("total")
    )
    filled = lookups.calendar_fill(window_calendar(bounds, 15), sums, ["n", "total"])
    return texts(filled, "window_start").select("window_start", "n", "total")


def alerted(spark, sf):
    chance = (F.floor(F.max("value") / 5).cast("double") / 100).alias("probability")
    return windowed(telemetry(spark, sf), 360, ["hostname"], chance).where("probability > 0.4")


ALERTED = f"al AS (SELECT {wid('ts', 360)} AS window_id, hostname, floor(max(value) / 5) / 100 AS probability FROM tele GROUP BY ALL HAVING floor(max(value) / 5) / 100 > 0.4)"


@query(
    "alert_context",
    with_ctes("tele", f"""
WITH {ALERTED} SELECT event_id, window_id, hostname, rule_id, cnt AS count, probability
FROM (SELECT *, {wid('ts', 360)} AS window_id FROM tele) JOIN al USING (window_id, hostname)"""),
)
def alert_context(spark, sf):
    found = lookups.alert_context(alerted(spark, sf), telemetry(spark, sf), 360)
    return found.select("event_id", "window_id", "hostname", "rule_id", "count", "probability")


@query(
    "alert_event_stats",
    with_ctes("tele", f"""
WITH {ALERTED} SELECT window_id, {plain('min(ts)')} AS first_time, count(DISTINCT hostname) AS n_hosts, count(*) AS event_count, count(DISTINCT rule_id) AS unique_rules
FROM (SELECT *, {wid('ts', 360)} AS window_id FROM tele) JOIN al USING (window_id, hostname) GROUP BY window_id"""),
)
def alert_event_stats(spark, sf):
    return texts(agg.alert_event_stats(lookups.alert_context(alerted(spark, sf), telemetry(spark, sf), 360)), "first_time")


@query("alert_hosts", with_ctes("tele", f"WITH {ALERTED} SELECT DISTINCT window_id, hostname FROM al"))
def alert_hosts(spark, sf):
    return agg.alert_hosts(lookups.alert_context(alerted(spark, sf), telemetry(spark, sf), 360))


assert naming.NO_FAMILY == "Uncategorized"  # the SQL above spells it out
