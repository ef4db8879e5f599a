"""Stored tables: keyed upserts, retention, summaries and exports.

Tables are Parquet partitioned by date, with versions (``sources/versioned.py``). A merge reads
and writes the dates of the incoming rows only. Latest-per-key is an aggregate (``max_by``), not a window: it combines map-side, so
a key that was written a billion times is not gathered in one task.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from trigwatch.functions.timing import PLAIN_FORMAT, SIEM_FORMAT
from trigwatch.operators.lookups import protected_hosts
from trigwatch.sources import versioned


def dedupe_latest(df: DataFrame, keys: Sequence[str], version: str) -> DataFrame:
    """Last write per key; equal versions are decided by the other columns, so reruns agree."""
    rest = [c for c in df.columns if c not in keys]
    if not rest:
        return df.distinct()
    comparable = [c for c in rest if not dict(df.dtypes)[c].startswith(("map", "array", "struct")) and c != version]
    latest = F.max_by(F.struct(*rest), F.struct(version, *comparable))
    return df.groupBy(*keys).agg(latest.alias("_r")).select(*keys, "_r.*").select(*df.columns)


def merge_rows(
    existing: DataFrame, incoming: DataFrame, keys: Sequence[str], version: str,
    merge: str = "replace", add: Sequence[str] = (),
) -> DataFrame:
    """Result of an upsert. ``replace``: newest row per key wins. ``sum``: the ``add`` columns
    are summed and the newest version is kept, for partial answers that complement each other.

    A version names one answer: rows of equal key and version are the same contribution and
    count once, so a batch may be repeated. ``existing`` holds contributions, not sums.
    """
    both = existing.unionByName(incoming)
    if merge == "replace":
        return dedupe_latest(both, keys, version)
    return summed(dedupe_latest(both, [*keys, version], version), keys, version, add)


def summed(both: DataFrame, keys: Sequence[str], version: str, add: Sequence[str]) -> DataFrame:
    """Contributions of each key added up; other columns come from the newest version."""
    other = [c for c in both.columns if c not in keys and c not in add and c != version]
    return both.groupBy(*keys).agg(
        *[F.sum(c).alias(c) for c in add],
        F.max(version).alias(version),
        *[F.max_by(c, version).alias(c) for c in other],
    ).select(*both.columns)


def upsert_windows(existing: DataFrame, incoming: DataFrame, version: str = "query_time", merge: str = "replace") -> DataFrame:
    """Replace whole windows: a later fetch of a window overwrites all its rows.

    The rows of a window belong together, so the newest version per window is found first
    (one small row per window, combined map-side) and older rows of that window are dropped. A
    null version is older than any other. Rows repeated by a second write count once.
    """
    keys = ["window_id", "hostname", "rule_id"]
    if merge == "sum":
        return merge_rows(existing, incoming, keys, version, "sum", ["count"])
    both = dedupe_latest(existing.unionByName(incoming), [*keys, version], version)
    newest = both.groupBy("window_id").agg(F.max(version).alias("_newest"))
    return both.join(newest, "window_id").where(F.col(version).eqNullSafe(F.col("_newest"))).drop("_newest")


def upsert_events(existing: DataFrame, incoming: DataFrame, version: str = "version") -> DataFrame:
    return merge_rows(existing, incoming, ["window_id", "hostname", "rule_id"], version)


def upsert_results(existing: DataFrame, incoming: DataFrame, version: str = "prediction_time") -> DataFrame:
    return merge_rows(existing, incoming, ["window_id", "hostname"], version)


def stamp(df: DataFrame, column: str = "prediction_time", at: Column | None = None) -> DataFrame:
    return df.withColumn(column, F.current_timestamp().cast("timestamp_ntz") if at is None else at)


def read_table(spark: SparkSession, path: str, version: int | None = None) -> DataFrame | None:
    """Stored table as of a version (the latest one by default), or None if nothing was written yet."""
    return versioned.read_version(spark, path, version)


def touched_dates(existing: DataFrame, incoming: DataFrame, partition: str) -> DataFrame:
    """Stored rows of the incoming dates. The dates of a batch are few, so they become a
    literal filter that prunes folders before anything is read."""
    dates = [r[0] for r in incoming.select(partition).distinct().collect()]
    wanted = F.col(partition).isin([d for d in dates if d is not None])
    return existing.where(wanted | F.col(partition).isNull() if None in dates else wanted)


def upsert_table(
    incoming: DataFrame, path: str, keys: Sequence[str], version: str, partition: str = "window_date",
    merge: str = "replace", tries: int = 1,
) -> int:
    """Merge rows into a date-partitioned table; only the dates present in them are read and rewritten.

    ``replace`` keeps the newest row per key, ``windows`` replaces whole windows (rules that a
    later fetch lacks go), ``sum`` stores each contribution under its version; readers add
    them up with ``summed``. Repeating a batch gives the same table in every mode.

    The new files of the dates are written beside the old ones and become the table in one step;
    returns the table's new version. A writer that another one has overtaken starts again from the
    newer table, up to ``tries`` times, and then raises ``TableConflict``.
    """
    spark = incoming.sparkSession
    while True:
        now = versioned.manifest(spark, path)
        stored = None if now is None else versioned.frame_of(spark, path, now)
        before = incoming.limit(0) if stored is None else touched_dates(stored, incoming, partition).select(incoming.columns)
        if merge == "windows":
            merged = upsert_windows(before, incoming, version).select(incoming.columns)
        else:
            merged = dedupe_latest(before.unionByName(incoming), [*keys, version] if merge == "sum" else keys, version)
        try:
            return versioned.replace_partitions(merged, path, partition, now)
        except versioned.TableConflict:
            tries -= 1
            if tries < 1:
                raise


# --- retention ----------------------------------------------------------------------------


def expired(df: DataFrame, cutoff: Column, time: str, keep_hosts: DataFrame | None = None) -> DataFrame:
    """Rows older than the cutoff whose host is not protected."""
    old = df.where(F.col(time) < cutoff)
    return old if keep_hosts is None else protected_hosts(old, keep_hosts, keep=False)


def expired_windows(docs: DataFrame, cutoff: Column, keep_hosts: Sequence[str], time: str = "window_start") -> DataFrame:
    """Old window documents of windows in which no protected host was seen.

    A window may be spread over several documents (shards), so it is judged by its id.
    """
    old = docs.where(F.col(time) < cutoff)
    listed = [h.strip() for h in keep_hosts if h.strip()]
    if not listed:
        return old
    protected = F.arrays_overlap(F.map_keys("host_triggers"), F.array(*[F.lit(h) for h in listed]))
    return old.join(old.where(protected).select("_id").distinct(), "_id", "left_anti")


def survivors(df: DataFrame, cutoff: Column, time: str, keep_hosts: DataFrame | None = None) -> DataFrame:
    """What retention leaves: young rows, and protected hosts of any age."""
    young = df.where(F.col(time) >= cutoff)
    if keep_hosts is None:
        return young
    return young.unionByName(protected_hosts(df.where(F.col(time) < cutoff), keep_hosts))


def cutoff_from(df: DataFrame, time: str, days: int) -> Column:
    """``days`` before the newest row; jobs pass the current time instead."""
    newest = df.agg(F.max(time)).scalar()
    return newest - F.make_dt_interval(days=F.lit(days))


def delete_range(df: DataFrame, start: str, end: str, time: str) -> DataFrame:
    """Rows outside ``[start, end)``; rows without a time stay."""
    inside = (F.col(time) >= F.lit(start).cast("timestamp_ntz")) & (F.col(time) < F.lit(end).cast("timestamp_ntz"))
    return df.where(~F.coalesce(inside, F.lit(False)))


def retention_dry_run(tables: Mapping[str, tuple[DataFrame, str]], cutoff: Column, keep_hosts: DataFrame | None = None) -> DataFrame:
    """Rows retention would delete, per table."""
    counts = None
    for name, (df, time) in tables.items():
        one = expired(df, cutoff, time, keep_hosts).agg(F.count(F.lit(1)).alias("expired")).select(F.lit(name).alias("table_name"), "expired")
        counts = one if counts is None else counts.unionByName(one)
    return counts


# --- summaries ----------------------------------------------------------------------------


def table_summary(events: DataFrame, windows: DataFrame, results: DataFrame) -> DataFrame:
    """Rows, hosts, rules, labels and time bounds per table, one row each."""

    def line(df: DataFrame, name: str, rule: Column, time_from: Column, time_to: Column, label: Column) -> DataFrame:
        return df.agg(
            F.lit(name).alias("table_name"),
            F.count(F.lit(1)).alias("n_rows"),
            F.count_distinct("hostname").alias("n_hosts"),
            F.count_distinct(rule).alias("n_rules"),
            F.count_if(label.isNotNull()).alias("n_labelled"),
            F.count_if(label == 1).alias("n_attack"),
            F.count_if(label == 0).alias("n_normal"),
            F.min(time_from).alias("first_time"),
            F.max(time_to).alias("last_time"),
        )

    none = F.lit(None)
    return (
        line(events, "events", F.col("rule_id"), F.col("timestamp"), F.col("timestamp"), none.cast("int"))
        .unionByName(line(windows, "windows", none.cast("bigint"), F.col("window_start"), F.col("window_end"), F.col("label")))
        .unionByName(
            line(results, "results", none.cast("bigint"), F.col("prediction_time"), F.col("prediction_time"), F.col("predicted_label"))
        )
        .withColumn("training_ready", ((F.col("table_name") == "windows") & (F.col("n_labelled") > 0)).cast("int"))
    )


def ingest_summary(windows: DataFrame, events: DataFrame) -> DataFrame:
    """Totals and time bounds of what was stored."""
    w = windows.agg(
        F.lit("windows").alias("table_name"), F.count(F.lit(1)).alias("n_rows"),
        F.min("window_start").alias("first_time"), F.max("window_end").alias("last_time"),
    )
    e = events.agg(
        F.lit("events").alias("table_name"), F.count(F.lit(1)).alias("n_rows"),
        F.min("timestamp").alias("first_time"), F.max("timestamp").alias("last_time"),
    )
    return w.unionByName(e)


def detection_summary(windows: DataFrame, results: DataFrame, start: Column, end: Column) -> DataFrame:
    """Windows, anomalies, mean confidence and detection rate of a period; rates are 0 without data."""
    w = windows.where((F.col("window_start") >= start) & (F.col("window_start") < end)).select(
        F.lit(1).alias("w"), F.lit(0).alias("a"), F.lit(None).cast("double").alias("c")
    )
    r = results.where((F.col("prediction_time") >= start) & (F.col("prediction_time") < end)).select(
        F.lit(0).alias("w"), (F.col("predicted_label") == 1).cast("int").alias("a"), F.coalesce("confidence", F.lit(0.0)).alias("c")
    )
    summed = w.unionByName(r).agg(
        F.coalesce(F.sum("w"), F.lit(0)).alias("total_windows"),
        F.coalesce(F.sum("a"), F.lit(0)).alias("total_anomalies"),
        # decimals: the mean must not depend on the order of the sum when it is rounded
        F.coalesce(F.round(F.avg(F.col("c").cast("decimal(18,9)")), 3).cast("double"), F.lit(0.0)).alias("average_confidence"),
    )
    rate = F.when(F.col("total_windows") > 0, F.round(F.col("total_anomalies") / F.col("total_windows"), 3)).otherwise(0.0)
    return summed.withColumn("detection_rate", rate)


# --- exports ------------------------------------------------------------------------------


def union_superset(*tables: DataFrame) -> DataFrame:
    """Rows of tables with different columns; absent ones are null; columns sorted by name."""
    merged = tables[0]
    for table in tables[1:]:
        merged = merged.unionByName(table, allowMissingColumns=True)
    return merged.select(*sorted(merged.columns))


def superset_text(*tables: DataFrame) -> DataFrame:
    """The same with times in ISO form and nested values as JSON, ready for CSV."""
    merged = union_superset(*tables)
    cells = []
    for name, kind in merged.dtypes:
        column = F.col(name)
        if kind.startswith("timestamp"):
            whole = F.date_format(column, "yyyy-MM-dd'T'HH:mm:ss")
            parts = F.date_format(column, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")
            column = F.when(parts.endswith(".000000"), whole).otherwise(parts)
        elif kind.startswith(("map", "array", "struct")):
            column = F.to_json(column)
        cells.append(column.alias(name))
    return merged.select(*cells)


def export_superset_csv(path: str, *tables: DataFrame) -> None:
    superset_text(*tables).write.mode("overwrite").option("header", "true").option("escape", '"').csv(path)


def export_rows(rows: DataFrame) -> DataFrame:
    """Re-bucketed rows in the training-file layout, with their output window."""
    return rows.select(
        F.col("hostname").alias("sysmon_hostname (custom)"),
        F.col("rule_id").cast("string").alias("Custom Rule"),
        F.date_format("first_time", SIEM_FORMAT).alias("Log Source Time (Minimum)"),
        F.col("count").alias("Count"),
        F.col("hostname"),
        F.date_format("bucket", "yyyyMMdd_HHmm").alias("window"),
    )


def export_window_files(rows: DataFrame, path: str) -> None:
    """One folder per host and window; every window is whole in one file.

    Rows go to a writer by (host, window): a window has at most one row per rule, so a
    file is bounded by the catalogue while a busy host is spread over many writers.
    """
    (
        export_rows(rows)
        .repartition("hostname", "window")
        .sortWithinPartitions("hostname", "window", "`Custom Rule`")
        .write.mode("overwrite")
        .partitionBy("hostname", "window")
        .option("header", "true")
        .csv(path)
    )


def save_lines(df: DataFrame, column: str, path: str) -> None:
    df.select(column).write.mode("overwrite").text(path)


def save_table(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").parquet(path)


def ordered_export(rows: DataFrame) -> DataFrame:
    return rows.orderBy("hostname", F.col("rule_id").cast("string"))


def text_time(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: F.date_format(c, PLAIN_FORMAT) for c in columns})
