"""Ranking of rules behind alerts, and the alert texts.

Windows here partition by alert; an alert has at most as many features as the catalogue.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trigwatch.functions import naming
from trigwatch.functions.timing import PLAIN_FORMAT


def top_rules_per_window(events: DataFrame, k: int = 5, keys: Sequence[str] = ("window_id",)) -> DataFrame:
    """Top rules by summed count (ties by id), after reducing to one row per window and rule."""
    summed = events.groupBy(*keys, "rule_id").agg(F.sum("count").alias("count"))
    order = Window.partitionBy(*keys).orderBy(F.desc("count"), "rule_id")
    return summed.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def rank_attributions(df: DataFrame, keys: Sequence[str], k: int, value: str = "attribution", position: str = "feature_idx") -> DataFrame:
    """Largest attributions of each alert by absolute value, sign kept."""
    order = Window.partitionBy(*keys).orderBy(F.desc(F.abs(value)), position)
    return (
        df.withColumn("rank", F.row_number().over(order))
        .where(F.col("rank") <= k)
        .withColumn("importance", F.abs(value))
    )


def prioritize_topk(
    df: DataFrame, keys: Sequence[str], k: int, bucket: str = "bucket", rank: str = "rank", mode: str = "compat"
) -> DataFrame:
    """Top k by priority bucket, keeping the old order inside a bucket, with new ranks.

    ``compat``: buckets 0 and 1 lead and the rest stay mixed; an alert without a bucket 0
    or 1 item keeps its unfiltered order, zero importances included. ``strict``: 0, 1, 2, 3.
    """
    inside = Window.partitionBy(*keys)
    positive = F.col("importance") > 0
    if mode == "strict":
        kept = df.where(positive).withColumn("_group", F.col(bucket))
    else:
        special = F.count_if(positive & (F.col(bucket) <= 1)).over(inside) > 0
        any_positive = F.count_if(positive).over(inside) > 0
        kept = (
            df.withColumns({"_special": special, "_any": any_positive})
            .where(F.col("_any") & (positive | ~F.col("_special")))
            .withColumn("_group", F.when(F.col("_special"), F.least(F.col(bucket), F.lit(2))).otherwise(0))
            .drop("_special", "_any")
        )
    order = inside.orderBy("_group", rank)
    return (
        kept.withColumn("new_rank", F.row_number().over(order))
        .where(F.col("new_rank") <= k)
        .drop("_group")
    )


def finalize_rules(df: DataFrame, keys: Sequence[str], n: int, marker: str, tie: str = "rule_id") -> DataFrame:
    """Analyst list: marked names left out, then bucket, then importance, cut to n."""
    shown = df.where(~F.coalesce(F.col("display_name"), F.lit("")).contains(marker))
    order = Window.partitionBy(*keys).orderBy("priority_bucket", F.desc("importance"), tie)
    return shown.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= n)


def top_by_value(long: DataFrame, keys: Sequence[str], n: int) -> DataFrame:
    """Largest positive feature values of each row."""
    order = Window.partitionBy(*keys).orderBy(F.desc("value"), "feature_idx")
    return long.where("value > 0").withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= n)


def importance_top(df: DataFrame, n: int, markers: Sequence[str], name: str = "rule_name") -> DataFrame:
    """Positive importances, names with one of the markers first."""
    lowered = F.lower(F.coalesce(F.col(name), F.lit("")))
    flag = F.lit(False)
    for marker in markers:
        flag = flag | lowered.contains(marker.lower())
    return (
        df.where("importance > 0")
        .withColumn("prior", flag.cast("int"))
        .orderBy(F.desc("prior"), F.desc("importance"), "feature_idx")
        .limit(n)
    )


def top_n_importance(df: DataFrame, n: int = 20, key: str = "rule_id") -> DataFrame:
    return df.orderBy(F.desc("importance"), key).limit(n)


def mean_abs_attribution(df: DataFrame, position: str = "feature_idx", value: str = "attribution") -> DataFrame:
    return df.groupBy(position).agg(F.avg(F.abs(value)).alias("importance"))


def detect(scored: DataFrame, threshold: float) -> DataFrame:
    """Scored windows with their alert flag."""
    return scored.withColumn("is_alert", F.col("probability") > threshold)


def detection_counts(detected: DataFrame) -> DataFrame:
    return detected.agg(
        F.count(F.lit(1)).alias("total_windows"),
        F.count_if("is_alert").alias("alerts"),
        F.count_if(F.col("predicted_label") == 1).alias("predicted_attack"),
        F.avg(F.when(F.col("is_alert"), F.col("probability"))).alias("mean_alert_confidence"),
    )


# --- alert texts ---------------------------------------------------------------------------

# Fixed value: leading fields of the event format, without vendor and product.
LEEF_VERSION = "LEEF:2.0"
LEEF_EVENT = "ATTACK_DETECTION|High"


def leef_header(vendor: str, product: str, version: str = "1.0") -> str:
    return f"{LEEF_VERSION}|{vendor}|{product}|{version}|{LEEF_EVENT}|"


def feature_tokens(features: Column) -> Column:
    """``1:display:0.1234;2:…`` from an array of ``(display, importance)``."""

    def token(item: Column, i: Column) -> Column:
        return F.concat((i + 1).cast("string"), F.lit(":"), _labelled(item))

    return F.concat_ws(";", F.transform(features, token))


def _labelled(item: Column) -> Column:
    # a null argument would be printed, so the missing case is decided first
    shown = F.when(item["importance"].isNull(), F.lit("N/A")).otherwise(F.format_string("%.4f", item["importance"]))
    return F.concat(item["display"], F.lit(":"), shown)


def leef_lines(alerts: DataFrame, header: str, model: str = "RandomForestClassifier") -> DataFrame:
    """One tab-separated text line per alert.

    Expects hostname, window_id, prediction (text), confidence, prediction_time,
    feature_count and ``top_features: array<struct<display, importance>>``.
    """
    features = F.col("top_features")
    has = F.coalesce(F.size(features), F.lit(0)) > 0
    fields = [
        ("name", F.lit("Malicious Threat Detection")),
        ("hostname", F.col("hostname")),
        ("windowId", F.col("window_id")),
        ("model", F.lit(model)),
        ("instances", F.lit("1")),
        ("features", F.coalesce(F.col("feature_count").cast("string"), F.lit("unknown"))),
        ("timestamp", F.date_format("prediction_time", PLAIN_FORMAT)),
        ("prediction", F.concat(F.upper(F.substring(F.trim("prediction"), 1, 1)), F.lower(F.expr("substring(trim(prediction), 2)")))),
        ("confidencePct", naming.confidence_pct(F.col("confidence"))),
        ("topFeatures", F.when(has, feature_tokens(features)).otherwise("n/a")),
        ("mostCritical", F.when(has, _labelled(F.get(features, F.lit(0)))).otherwise("n/a")),
    ]
    pieces = [F.concat(F.lit(f"{key}="), naming.clean_value(value)) for key, value in fields]
    return alerts.withColumn("line", F.concat(F.lit(header), F.concat_ws("\t", *pieces)))


def alert_payload_json(alerts: DataFrame, entries: str = "top_rules") -> DataFrame:
    """Alert details as one JSON object per alert; values rounded to three places."""
    numbered = naming.indexed_keys(F.col(entries))
    body = F.struct(
        "hostname", "source_ip", "window_id", F.round("confidence", 3).alias("confidence"), numbered.alias("top_rules_by_count")
    )
    return alerts.withColumn("payload", F.to_json(body))
