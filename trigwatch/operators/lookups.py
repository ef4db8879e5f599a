"""Joins against the catalogue and its companions, and interval joins of jobs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from trigwatch.functions import naming, timing
from trigwatch.session import checked_broadcast, cut_lineage, is_small, settled


def translate_ids(df: DataFrame, id_map: DataFrame, column: str = "rule_id") -> DataFrame:
    """Replace environment ids by production ids; ids without a translation stay."""
    lookup = checked_broadcast(id_map.select(F.col("uat_rule_id").alias("_from"), F.col("prod_rule_id").alias("_to")))
    return (
        df.join(lookup, F.col(column) == F.col("_from"), "left")
        .withColumn(column, F.coalesce("_to", column))
        .drop("_from", "_to")
    )


def translate_uat_files(df: DataFrame, id_map: DataFrame, path: str, segment: str = "UAT") -> DataFrame:
    """Translation only for rows read below a directory of the given name."""
    lookup = checked_broadcast(id_map.select(F.col("uat_rule_id").alias("_from"), F.col("prod_rule_id").alias("_to")))
    inside = F.array_contains(F.split(F.col(path), "/"), segment)
    return (
        df.join(lookup, inside & (F.col("rule_id") == F.col("_from")), "left")
        .withColumn("rule_id", F.coalesce("_to", "rule_id"))
        .drop("_from", "_to")
    )


def prod_rule_universe(rules: DataFrame, id_map: DataFrame) -> DataFrame:
    """Discovered ids after translation, distinct and sorted."""
    return translate_ids(rules.select("rule_id").distinct(), id_map).distinct().orderBy("rule_id")


def join_family(df: DataFrame, families: DataFrame) -> DataFrame:
    """Family of every rule; ids outside the catalogue are uncategorised."""
    return df.join(checked_broadcast(families.select("rule_id", "family")), "rule_id", "left").withColumn(
        "family", F.coalesce("family", F.lit(naming.NO_FAMILY))
    )


def enrich_rule_names(df: DataFrame, names: DataFrame) -> DataFrame:
    """Optional name of every rule."""
    return df.join(checked_broadcast(names.select("rule_id", "rule_name")), "rule_id", "left")


def catalog_families(
    catalog: DataFrame, patterns: Sequence[tuple[str, str]], overrides: DataFrame | None = None
) -> DataFrame:
    """Family per catalogue rule: explicit override, else name pattern, else none."""
    if overrides is None:
        return catalog.withColumn("family", naming.rule_family(F.col("name"), patterns))
    explicit = overrides.select("rule_id", F.col("family").alias("_explicit"))
    return (
        catalog.join(explicit, "rule_id", "left")
        .withColumn("family", naming.rule_family(F.col("name"), patterns, F.col("_explicit")))
        .drop("_explicit")
    )


def rules_by_family(families: DataFrame, limit: int | None = None) -> DataFrame:
    """Sorted member ids per family, optionally the first few.

    The lists are bounded by the rule catalogue, not by the events.
    """
    members = F.sort_array(F.collect_list("rule_id"))
    grouped = families.groupBy("family").agg(members.alias("rule_ids"), F.count(F.lit(1)).alias("n_rules"))
    if limit is not None:
        grouped = grouped.withColumn("rule_ids", F.slice("rule_ids", 1, limit))
    return grouped


def uncategorized_rules(families: DataFrame) -> DataFrame:
    return families.where(F.col("family") == naming.NO_FAMILY).select("rule_id").orderBy("rule_id")


def rule_coverage(used: DataFrame, universe: DataFrame, id_map: DataFrame | None = None) -> DataFrame:
    """Counts of present, missing and unknown rules.

    Ids are reduced to distinct values map-side before the join, so a rule that fires in a
    third of all rows costs one row.
    """
    ids = used.select("rule_id").distinct()
    if id_map is not None:
        ids = translate_ids(ids, id_map).distinct()
    both = (
        ids.withColumn("_used", F.lit(1))
        .join(universe.select("rule_id").distinct().withColumn("_known", F.lit(1)), "rule_id", "full_outer")
    )
    return both.agg(
        F.count_if(F.col("_used").isNotNull() & F.col("_known").isNotNull()).alias("present_rules"),
        F.count_if(F.col("_used").isNull()).alias("missing_rules"),
        F.count_if(F.col("_known").isNull()).alias("unknown_rules"),
    )


def present_rules(used: DataFrame, universe: DataFrame) -> DataFrame:
    return used.select("rule_id").intersect(universe.select("rule_id"))


def unknown_rules(used: DataFrame, universe: DataFrame) -> DataFrame:
    return used.select("rule_id").subtract(universe.select("rule_id"))


def expand_families(alerts: DataFrame, window_rules: DataFrame, families: DataFrame, names: DataFrame) -> DataFrame:
    """Family features of an alert, replaced by the rules of that family seen in its window.

    ``alerts``: window_id, hostname, feature, importance (and more); ``window_rules``:
    window_id, hostname, rule_id, count. A family without a rule in the window falls back
    to its lowest catalogue rule, and without one to the family's own name. A rule's value
    is the family importance in proportion to its count.
    """
    keyed = alerts.withColumns(
        {"family": naming.feature_family(F.col("feature")), "own_rule": naming.feature_rule_id(F.col("feature"))}
    )
    # alerts are few next to the windows: only their windows are aggregated. One row per window,
    # host and rule: a partition of the window function holds at most the catalogue's rules,
    # and its key is the key of the join that follows
    alerted = checked_broadcast(alerts.select("window_id", "hostname").distinct())
    summed = window_rules.join(alerted, ["window_id", "hostname"], "left_semi").groupBy("window_id", "hostname", "rule_id").agg(F.sum("count").alias("count"))
    inside = Window.partitionBy("window_id", "hostname", "family")
    members = join_family(summed, families).select(
        "window_id", "hostname", "family", F.col("rule_id").alias("child_rule"), F.col("count").alias("child_count"),
        F.sum("count").over(inside).alias("family_count"),
    )
    lowest = settled(families.groupBy("family").agg(F.min("rule_id").alias("fallback_rule")))
    expanded = (
        keyed.join(members, ["window_id", "hostname", "family"], "left")
        .join(lowest, "family", "left")
        .withColumn("rule_id", F.coalesce("own_rule", "child_rule", "fallback_rule"))
    )
    named = enrich_rule_names(expanded, names)
    shown = (
        F.when(F.col("rule_id").isNotNull() & F.col("family").isNotNull(),
               naming.rule_display(F.col("rule_id"), F.coalesce("rule_name", F.col("rule_id").cast("string"))))
        .when(F.col("rule_id").isNotNull(), naming.rule_display(F.col("rule_id"), F.col("rule_name")))
        .otherwise(F.coalesce("family", "feature"))
    )
    value = F.coalesce(
        naming.family_share_value(F.col("importance"), F.col("child_count"), F.col("family_count")), F.col("importance")
    )
    return named.withColumns({"display_name": shown, "value": value}).drop("own_rule", "child_rule", "fallback_rule", "family_count")


def job_windows(windows: DataFrame, jobs: DataFrame, time: str = "window_start") -> DataFrame:
    """Windows of each export job: same host and ``start <= t < end``, all jobs in one join.

    Jobs are spread over the days they touch, so the join has an equality on (host, day)
    and works as a broadcast of few jobs or as a shuffle of many. Windows are keyed by day
    as well, which splits a hot host over the calendar.
    """
    days = jobs.withColumn(
        "_day",
        F.explode(F.sequence(F.to_date("start_time"), F.to_date(F.col("end_time") - F.expr("INTERVAL 1 MICROSECOND")))),
    ).withColumnRenamed("hostname", "_host")
    keyed = windows.withColumn("_day", F.to_date(time))
    return (
        keyed.join(
            checked_broadcast(days),
            (keyed["hostname"] == days["_host"])
            & (keyed["_day"] == days["_day"])
            & (F.col(time) >= F.col("start_time"))
            & (F.col(time) < F.col("end_time")),
        )
        .drop("_host", keyed["_day"], days["_day"])
    )


def host_list(spark: SparkSession, hosts: Sequence[str]) -> DataFrame:
    """Configured host names, trimmed, blanks dropped."""
    listed = [(h,) for h in hosts]
    return (
        spark.createDataFrame(listed, "hostname STRING")
        .select(F.trim("hostname").alias("hostname"))
        .where("hostname <> ''")
        .distinct()
    )


def protected_hosts(df: DataFrame, hosts: DataFrame, keep: bool = True) -> DataFrame:
    """Rows of listed hosts, or of all others."""
    return df.join(checked_broadcast(hosts), "hostname", "left_semi" if keep else "left_anti")


def calendar_fill(calendar: DataFrame, windows: DataFrame, values: Sequence[str]) -> DataFrame:
    """Every calendar slot, with 0 where nothing happened."""
    return calendar.join(windows.select("window_start", *values), "window_start", "left").na.fill(0, list(values))


#: a window and host with more than one event in so many is hot; there are fewer than this
HOT_SHARE = 200


def alert_context(alerts: DataFrame, events: DataFrame, size: int) -> DataFrame:
    """Raw events of each alerted window and host. The alerts give up their id for its start time,
    so no id is formatted per event.

    Alerts are measured: few are broadcast, and events stay where they are. If there are many,
    events of hot (window, host) keys, which are fewer than ``HOT_SHARE``, meet their alerts by
    broadcast, and only the others are shuffled by key.
    """
    keys = ["_start", "hostname"]
    keyed = events.withColumn("_start", timing.window_start(F.col("timestamp"), size))
    started = cut_lineage(alerts.withColumn("_start", timing.start_of_id(F.col("window_id"))))
    if is_small(started):
        return keyed.join(F.broadcast(started), keys).drop("_start")
    counts = keyed.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    counts = cut_lineage(counts.join(started.select(*keys).distinct(), keys))
    total = counts.agg(F.sum("_n")).first()[0] or 0
    hot = F.broadcast(counts.where(F.col("_n") * HOT_SHARE > total).select(*keys))
    few = keyed.join(hot, keys, "left_semi").join(F.broadcast(started.join(hot, keys, "left_semi")), keys)
    rest = keyed.join(hot, keys, "left_anti").join(started.join(hot, keys, "left_anti"), keys)
    return few.unionByName(rest).drop("_start")
