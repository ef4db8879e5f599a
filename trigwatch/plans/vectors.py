"""Feature layouts, vectors, scaling, weights, splits and samples."""

from __future__ import annotations

from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from trigwatch.operators import aggregates as agg
from trigwatch.operators import sampling, vectors
from trigwatch.plans.lookups import families
from trigwatch.plans.registry import query
from trigwatch.plans.tables import embeddings_long, rounded, scores, table, telemetry, wid, with_ctes
from trigwatch.session import cut_lineage


def layout_sql(mode: str) -> str:
    plan = vectors.MODES[mode]
    parts = []
    if plan["families"]:
        parts.append("SELECT DISTINCT 0 AS kind, family, NULL::BIGINT AS rule_id FROM fam WHERE family <> 'Uncategorized'")
    if plan["rules"]:
        only = " WHERE family = 'Uncategorized'" if mode == "family_first" else ""
        parts.append(f"SELECT 1, NULL, rule_id FROM fam{only}" if parts else "SELECT 1 AS kind, NULL::VARCHAR AS family, rule_id FROM fam")
    union = " UNION ALL ".join(parts)
    return f"""lay AS (SELECT row_number() OVER (ORDER BY kind, family, rule_id) - 1 AS feature_idx,
  CASE kind WHEN 0 THEN 'family_' || family ELSE 'rule_' || CAST(rule_id AS VARCHAR) END AS feature, family, rule_id FROM ({union}))"""


def slots_sql(mode: str) -> str:
    order = "s.feature_idx, o.feature_idx" if vectors.MODES[mode]["first"] == "family" else "o.feature_idx, s.feature_idx"
    return f"""{layout_sql(mode)},
slots AS (SELECT f.rule_id, coalesce({order}) AS feature_idx FROM fam f
  LEFT JOIN lay o ON o.rule_id = f.rule_id LEFT JOIN lay s ON s.family = f.family WHERE coalesce({order}) IS NOT NULL)"""


def _register_modes():
    for mode in vectors.MODES:

        @query(f"feature_layout_{mode}", with_ctes("fam", f"WITH {layout_sql(mode)} SELECT feature_idx, feature FROM lay"))
        def layout(spark, sf, mode=mode):
            found = vectors.feature_layout(families(spark, sf), mode)
            return found.select(F.col("feature_idx").cast("bigint").alias("feature_idx"), "feature")

        @query(
            f"vectorize_{mode}",
            with_ctes("tele fam", f"""
WITH {slots_sql(mode)},
r AS (SELECT {wid('ts', 1440)} AS window_id, hostname, rule_id, sum(ln(1 + cnt)) AS v FROM tele GROUP BY 1, 2, 3)
SELECT window_id, hostname, feature_idx, round(sum(v), 6) AS value FROM r JOIN slots USING (rule_id) GROUP BY 1, 2, 3"""),
        )
        def vectorize(spark, sf, mode=mode):
            rules = agg.window_rule_counts(telemetry(spark, sf), 1440, ["window_id", "hostname"])
            long = vectors.allocate_features(rules, families(spark, sf), mode, ["window_id", "hostname"])
            return rounded(long.withColumn("feature_idx", F.col("feature_idx").cast("bigint")), "value")


_register_modes()


@query(
    "layout_summary",
    with_ctes("fam", f"WITH {layout_sql('family_first')} SELECT count(*) AS dimension, count(family) AS families, count(rule_id) AS rules FROM lay"),
)
def layout_summary(spark, sf):
    return vectors.layout_summary(vectors.feature_layout(families(spark, sf), "family_first"))


@query("rule_index", with_ctes("cat", "SELECT rule_id, row_number() OVER (ORDER BY rule_id) - 1 AS feature_idx FROM cat"))
def rule_index(spark, sf):
    return vectors.rule_index(families(spark, sf)).withColumn("feature_idx", F.col("feature_idx").cast("bigint"))


@query(
    "family_layout",
    with_ctes("fam", "SELECT family, row_number() OVER (ORDER BY family) - 1 AS feature_idx FROM (SELECT DISTINCT family FROM fam WHERE family <> 'Uncategorized')"),
)
def family_layout(spark, sf):
    return vectors.family_layout(families(spark, sf)).withColumn("feature_idx", F.col("feature_idx").cast("bigint"))


@query(
    "join_feature_index",
    with_ctes("tele fam", f"WITH {slots_sql('hybrid_exclusive')} SELECT event_id, rule_id, feature_idx FROM tele JOIN slots USING (rule_id)"),
)
def join_feature_index(spark, sf):
    from trigwatch.session import settled

    slots = settled(vectors.feature_slots(families(spark, sf), "hybrid_exclusive"))
    return telemetry(spark, sf).join(slots, "rule_id").select("event_id", "rule_id", F.col("feature_idx").cast("bigint").alias("feature_idx"))


def used_families(spark, sf):
    """Catalogue entries of the rules that fired, for vectors of a fixed small width."""
    return cut_lineage(families(spark, sf).join(telemetry(spark, sf).select("rule_id").distinct(), "rule_id", "left_semi"))


def window_vectors(spark, sf, size=1440, mode="family_first"):
    """Labelled ML vectors of the aggregated windows."""
    windows = agg.aggregate_windows(telemetry(spark, sf), size)
    return vectors.vectorize(windows, used_families(spark, sf), mode, list(agg.KEYS), carry=["is_attack"])


@query(
    "window_vectors",
    with_ctes("tele fam", f"""
WITH used AS (SELECT DISTINCT rule_id FROM tele), ufam AS (SELECT fam.* FROM fam JOIN used USING (rule_id)),
{slots_sql('family_first').replace('FROM fam', 'FROM ufam')},
r AS (SELECT {wid('ts', 1440)} AS window_id, hostname, source_label, source_ip, rule_id, sum(ln(1 + cnt)) AS v FROM tele GROUP BY 1, 2, 3, 4, 5)
SELECT window_id, hostname, source_label, source_ip, feature_idx, round(sum(v), 6) AS value FROM r JOIN slots USING (rule_id) GROUP BY 1, 2, 3, 4, 5 HAVING sum(v) <> 0"""),
)
def window_vectors_long(spark, sf):
    dense = window_vectors(spark, sf).select(*agg.KEYS, F.posexplode(vector_to_array("features")).alias("feature_idx", "value"))
    return rounded(dense.where("value <> 0").withColumn("feature_idx", F.col("feature_idx").cast("bigint")), "value")


@query(
    "feature_stats",
    with_ctes("tele fam", f"""
WITH {slots_sql('family_first')},
r AS (SELECT {wid('ts', 1440)} AS window_id, hostname, rule_id, sum(ln(1 + cnt)) AS v FROM tele GROUP BY 1, 2, 3),
l AS (SELECT window_id, hostname, feature_idx, sum(v) AS value FROM r JOIN slots USING (rule_id) GROUP BY 1, 2, 3),
d AS (SELECT (SELECT count(*) FROM (SELECT DISTINCT window_id, hostname FROM r)) * (SELECT count(*) FROM lay) AS cells),
full_cells AS (SELECT value FROM l UNION ALL SELECT 0.0 FROM range((SELECT cells - (SELECT count(*) FROM l) FROM d)))
SELECT min(value) AS min_value, round(max(value), 6) AS max_value, round(avg(value), 9) AS mean_value, round(stddev_pop(value), 6) AS std_value,
  round(avg(CASE WHEN value = 0 THEN 1.0 ELSE 0.0 END), 6) AS zero_share FROM full_cells"""),
)
def feature_stats(spark, sf):
    fam = families(spark, sf)
    rules = agg.window_rule_counts(telemetry(spark, sf), 1440, ["window_id", "hostname"])
    long = vectors.allocate_features(rules, fam, "family_first", ["window_id", "hostname"])
    n_rows = rules.select("window_id", "hostname").distinct().agg(F.count(F.lit(1))).scalar()
    dimension = vectors.feature_layout(fam, "family_first").agg(F.count(F.lit(1))).scalar()
    out = vectors.feature_stats(long, n_rows, dimension)
    return rounded(rounded(out, "max_value", "std_value", "zero_share"), "mean_value", places=9)


@query(
    "scale_features",
    with_ctes("emb", """
SELECT vec_id, pos, round((x - m) / s, 6) AS scaled FROM emb JOIN (SELECT pos, avg(x) AS m, stddev_pop(x) AS s FROM emb GROUP BY pos) USING (pos)"""),
)
def scale_features(spark, sf):
    out = vectors.scale_features(embeddings_long(spark, sf)).select("vec_id", F.col("feature_idx").cast("bigint").alias("pos"), "scaled")
    return rounded(out, "scaled")


@query(
    "class_weights",
    with_ctes("scores", "SELECT event_id, label, (SELECT count(*) FROM scores) / (2 * (count(*) OVER (PARTITION BY label))) AS weight FROM scores"),
)
def class_weights(spark, sf):
    return vectors.class_weights(scores(spark, sf)).select("event_id", "label", "weight")


@query(
    "stratified_split",
    with_ctes("scores", """
SELECT event_id, label, CASE WHEN row_number() OVER (PARTITION BY label ORDER BY md5('42:' || event_id), event_id) <= round(count(*) OVER (PARTITION BY label) * 0.2) THEN 'test' ELSE 'train' END AS split FROM scores"""),
)
def stratified_split(spark, sf):
    return sampling.stratified_split(scores(spark, sf), "label", "event_id").select("event_id", "label", "split")


@query(
    "stratified_folds",
    with_ctes("scores", "SELECT event_id, label, (row_number() OVER (PARTITION BY label ORDER BY md5('42:' || event_id), event_id) - 1) % 5 AS fold FROM scores"),
)
def stratified_folds(spark, sf):
    dealt = sampling.stratified_folds(scores(spark, sf), "label", "event_id")
    return dealt.select("event_id", "label", F.col("fold").cast("bigint").alias("fold"))


@query("sample_rows", "SELECT event_id, value FROM events ORDER BY md5('42:' || event_id), event_id LIMIT 100")
def sample_rows(spark, sf):
    return sampling.sample_rows(table(spark, sf, "events"), 100, "event_id").select("event_id", "value")


@query("save_background", with_ctes("scores", "SELECT event_id, score FROM scores WHERE label = 0 ORDER BY md5('42:' || event_id), event_id LIMIT 50"))
def save_background(spark, sf):
    from trigwatch.operators.store import save_table
    from trigwatch.plans.tables import scratch

    path = scratch(spark, "background")
    save_table(sampling.background_rows(scores(spark, sf), 50, "event_id"), path)
    return spark.read.parquet(path).select("event_id", "score")
