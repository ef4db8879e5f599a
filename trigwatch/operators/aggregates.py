"""Windows of rule counts: the long form is the working form, maps are built at the edge.

Every aggregate first reduces to one row per (keys, rule). That step combines map-side and
shuffles on a key that includes the rule, so a host or window holding a third of all
events is already small when the second step groups by window and host; what is collected
into a map is bounded by the rule catalogue.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trigwatch.functions import cleaning, timing

KEYS = ("window_id", "hostname", "source_label", "source_ip")
#: the same windows while they are shuffled: a timestamp instead of its formatted id
TIME_KEYS = ("window_start", "hostname", "source_label", "source_ip")


def clean_events(events: DataFrame) -> DataFrame:
    """Cleaned counts, and an address for every event."""
    address = F.coalesce("source_ip", F.lit(cleaning.NO_ADDRESS)) if "source_ip" in events.columns else F.lit(cleaning.NO_ADDRESS)
    return events.withColumns({"count": cleaning.clean_count(F.col("count")), "source_ip": address})


def window_rule_counts(events: DataFrame, size: int, keys: Sequence[str] = KEYS) -> DataFrame:
    """``rule_counts`` of clock windows. The window travels as its start time and gets its id
    after the aggregate, so the id is formatted per group and not per event."""
    timed = clean_events(events).withColumn("window_start", timing.window_start(F.col("timestamp"), size))
    counted = rule_counts(timed, ["window_start", *[k for k in keys if k != "window_id"]])
    return counted.withColumn("window_id", timing.window_id(F.col("window_start"), size)).select(
        *keys, "rule_id", "total_count", "total_log", "n_rows", "first_time", "last_time"
    )


def rule_counts(events: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """One row per keys and rule: summed count, summed log counts, events and time bounds."""
    return events.groupBy(*keys, "rule_id").agg(
        F.sum("count").alias("total_count"),
        F.sum(cleaning.log_count(F.col("count"))).alias("total_log"),
        F.count(F.lit(1)).alias("n_rows"),
        F.min("timestamp").alias("first_time"),
        F.max("timestamp").alias("last_time"),
    )


def window_totals(rules: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """Totals per keys from the long form; distinct rules are its row count."""
    return rules.groupBy(*keys).agg(*_totals())


def _totals() -> list[Column]:
    return [
        F.sum("total_count").alias("total_events"),
        F.sum("total_log").alias("total_events_log1p"),
        F.count("rule_id").alias("unique_rules"),
        F.min("first_time").alias("first_time"),
        F.max("last_time").alias("last_time"),
    ]


def rules_to_map(value: str) -> Column:
    """Rule-sorted map of the group's rows."""
    entries = F.sort_array(F.collect_list(F.struct("rule_id", value)))
    return F.map_from_entries(
        F.transform(entries, lambda e: F.struct(e["rule_id"].cast("string"), e[value]))
    )


def aggregate_windows(events: DataFrame, size: int = 30, mode: str = "train", window_by: str = "time") -> DataFrame:
    """One row per window, host, label and address, with sparse rule maps and totals.

    ``window_by='file'`` takes the window id read from the file name. ``train`` bounds a
    window by its first and last event and adds the label; ``detect`` uses the grid.
    """
    cleaned = clean_events(events)
    if window_by == "file":
        keys = KEYS
    else:
        keys = TIME_KEYS
        cleaned = cleaned.withColumn("window_start", timing.window_start(F.col("timestamp"), size))
    grouped = rule_counts(cleaned, keys).groupBy(*keys).agg(
        rules_to_map("total_count").alias("aggregated_rules"),
        rules_to_map("total_log").alias("aggregated_rules_log1p_sum"),
        *_totals(),
    )
    if window_by != "file":
        grouped = grouped.withColumn("window_id", timing.window_id(F.col("window_start"), size))
    if mode == "train":
        bounds = {"window_start": F.col("first_time"), "window_end": F.col("last_time")}
        bounds["is_attack"] = cleaning.label_binary(F.col("source_label"))
    else:
        bounds = {
            "window_start": timing.window_start(F.col("first_time"), size),
            "window_end": timing.window_end(F.col("first_time"), size),
        }
    return grouped.withColumns(bounds).drop("first_time", "last_time")


def window_stats(windows: DataFrame) -> DataFrame:
    """Nine figures over all windows, and the label split."""
    return windows.agg(
        F.count(F.lit(1)).alias("total_windows"),
        F.count_distinct("hostname").alias("unique_hosts"),
        F.sum("total_events").alias("total_events"),
        F.avg("total_events").alias("avg_events_per_window"),
        F.avg("unique_rules").alias("avg_rules_per_window"),
        F.max("total_events").alias("max_events_per_window"),
        F.min("total_events").alias("min_events_per_window"),
        F.max("unique_rules").alias("max_rules_per_window"),
        F.min("unique_rules").alias("min_rules_per_window"),
        F.count_if(F.col("source_label") == "attack").alias("attack_windows"),
        F.count_if(F.col("source_label") == "normal").alias("normal_windows"),
        F.avg((F.col("source_label") == "attack").cast("double")).alias("attack_ratio"),
    )


def common_rules(windows: DataFrame, top: int | None = 10, rules: str = "aggregated_rules") -> DataFrame:
    """Number of windows each rule occurs in; the top ones, ties by id."""
    counted = (
        windows.select(F.explode(F.map_keys(rules)).alias("rule_text"))
        .groupBy(F.col("rule_text").cast("bigint").alias("rule_id"))
        .agg(F.count(F.lit(1)).alias("n_windows"))
    )
    return counted if top is None else counted.orderBy(F.desc("n_windows"), "rule_id").limit(top)


# --- stored window documents -------------------------------------------------------------


def ingest_windows(events: DataFrame, size: int) -> DataFrame:
    """Hour-anchored windows of ingested events, known by their start until they are stored."""
    return events.withColumn("window_start", timing.window_start_hour(F.col("timestamp"), size))


def named(df: DataFrame) -> DataFrame:
    """Window id of rows that carry a window start."""
    return df.withColumn("window_id", F.date_format("window_start", timing.WINDOW_ID_FORMAT))


def host_rule_counts(events: DataFrame) -> DataFrame:
    """Stored long form: one row per window, host and rule over all addresses."""
    return events.groupBy("window_start", "hostname", "rule_id").agg(F.sum("count").alias("count"))


def majority_ip(events: DataFrame) -> DataFrame:
    """Per window and host the address with most triggers (smallest on ties); totals over all."""
    per_ip = events.groupBy("window_start", "hostname", "source_ip").agg(F.sum("count").alias("ip_total"))
    return per_ip.groupBy("window_start", "hostname").agg(
        F.min(F.struct((-F.col("ip_total")).alias("minus"), F.col("source_ip").alias("ip")))["ip"].alias("source_ip"),
        F.sum("ip_total").alias("total_triggers"),
    )


def window_feature_vector(events: DataFrame) -> DataFrame:
    """Rule totals per window over all hosts, long form."""
    return events.groupBy("window_start", "rule_id").agg(F.sum("count").alias("count"))


def window_documents(events: DataFrame, size: int, shards: int = 1) -> DataFrame:
    """Nested documents ``_id, shard, feature_vector, host_triggers, totals`` for exchange.

    The long forms above are the store. Every window has ``shards`` documents at most (hosts
    are dealt by hash, a shard without hosts has none); ``_id`` and ``shard`` are the key, and
    totals and vector are those of the document's own hosts, so they add up over a window.
    All parts are derived from one aggregate over (window, shard, host, address, rule), whose
    shuffle they share.
    """
    base = (
        events.withColumn("shard", F.pmod(F.xxhash64("hostname"), F.lit(shards)).cast("int"))
        .groupBy("window_start", "shard", "hostname", "source_ip", "rule_id").agg(F.sum("count").alias("count"))
    )
    host, document = ["window_start", "shard", "hostname"], ["window_start", "shard"]

    def rules(rows, keys, name):
        summed = rows.groupBy(*keys, "rule_id").agg(F.sum("count").alias("count"))
        entries = F.sort_array(F.collect_list(F.struct(F.col("rule_id").cast("string"), "count")))
        return summed.groupBy(*keys).agg(
            F.map_from_entries(entries).alias(name), F.sum("count").alias("total_triggers"), F.count(F.lit(1)).alias("total_rules_triggered")
        )

    per_ip = base.groupBy(*host, "source_ip").agg(F.sum("count").alias("ip_total"))
    address = per_ip.groupBy(*host).agg(F.min(F.struct((-F.col("ip_total")).alias("minus"), F.col("source_ip").alias("ip")))["ip"].alias("source_ip"))
    hosts = rules(base, host, "rules").join(address, host)
    entry = F.struct("hostname", F.struct("total_triggers", F.map_entries("rules").alias("r"), "source_ip"))
    nested = hosts.groupBy(*document).agg(F.map_from_entries(F.sort_array(F.collect_list(entry))).alias("hosts"))
    host_triggers = F.transform_values(
        "hosts",
        lambda k, h: F.struct(
            h["total_triggers"].alias("total_triggers"), F.map_from_entries(h["r"]).alias("rules"), h["source_ip"].alias("source_ip")
        ),
    )
    return named(nested.join(rules(base, document, "feature_vector"), document)).select(
        F.col("window_id").alias("_id"),
        "shard",
        "window_start",
        (F.col("window_start") + F.make_dt_interval(mins=F.lit(size))).alias("window_end"),
        "feature_vector",
        host_triggers.alias("host_triggers"),
        "total_triggers",
        "total_rules_triggered",
        F.struct(
            F.lit("siem").alias("source"),
            F.lit("detection").alias("data_type"),
            F.lit(size).alias("window_size_minutes"),
        ).alias("metadata"),
    )


def documents_json(docs: DataFrame) -> DataFrame:
    return docs.select(F.to_json(F.struct(*docs.columns), {"timestampNTZFormat": "yyyy-MM-dd'T'HH:mm:ss"}).alias("doc"))


def reaggregate(rows: DataFrame, size: int, time: str = "window_start") -> DataFrame:
    """Small windows into larger ones: counts summed, earliest time kept."""
    return rows.groupBy(
        timing.window_start(F.col(time), size).alias("bucket"), "hostname", "rule_id"
    ).agg(F.sum("count").alias("count"), F.min(time).alias("first_time"))


def source_trigger_query(events: DataFrame, rules: str = "rules") -> DataFrame:
    """Host, address and rule: first time and number of events, largest first."""
    return (
        events.select("hostname", "source_ip", "timestamp", F.explode(rules).alias("rule_id"))
        .groupBy("hostname", "source_ip", "rule_id")
        .agg(F.min("timestamp").alias("first_time"), F.count(F.lit(1)).alias("count"))
        .orderBy(F.desc("count"), "hostname", "source_ip", "rule_id")
    )


def pivot_rules(events: DataFrame, keys: Sequence[str], rule_ids: Sequence[int]) -> DataFrame:
    """Rules become columns ``rule_<id>``, 0 where a rule did not fire; key columns stay as they are.

    Rules are summed first, so the rows that are spread into columns are one per key and
    rule; listing the rules saves the extra job that finds them.
    """
    summed = events.groupBy(*keys, "rule_id").agg(F.sum("count").alias("count"))
    if not rule_ids:
        return summed.select(*keys).distinct()
    names = {str(r): f"rule_{r}" for r in rule_ids}
    return summed.groupBy(*keys).pivot("rule_id", list(rule_ids)).agg(F.sum("count")).withColumnsRenamed(names).na.fill(0, list(names.values()))


def alert_event_stats(context: DataFrame, keys: Sequence[str] = ("window_id",)) -> DataFrame:
    """First time, rows, distinct hosts and rules of every alert."""
    return context.groupBy(*keys).agg(
        F.min("timestamp").alias("first_time"),
        F.count_distinct("hostname").alias("n_hosts"),
        F.count(F.lit(1)).alias("event_count"),
        F.count_distinct("rule_id").alias("unique_rules"),
    )


def alert_hosts(context: DataFrame) -> DataFrame:
    """Hosts of every alerted window as rows; a list per window would have no size bound."""
    return context.select("window_id", "hostname").distinct()
