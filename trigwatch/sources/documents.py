"""Window documents and search results: nested JSON to one row per host and rule."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from trigwatch.functions import cleaning, nested, timing
from trigwatch.schemas import SEARCH_RESULT, WINDOW_DOC


def parse_window_docs(df: DataFrame, column: str = "doc") -> DataFrame:
    """Parse JSON text into the window-document columns."""
    parsed = F.from_json(F.col(column), WINDOW_DOC, {"timestampNTZFormat": "yyyy-MM-dd'T'HH:mm:ss"})
    return df.select(parsed.alias("d")).select("d.*")


def _host_rows(docs: DataFrame) -> DataFrame:
    return docs.select(
        F.col("_id").alias("window_id"),
        "window_start",
        "window_end",
        F.explode("host_triggers").alias("hostname", "host"),
    ).select("window_id", "window_start", "window_end", "hostname", "host.*")


def scan_window_docs(docs: DataFrame) -> DataFrame:
    """One row per window, host and rule; counts of zero and below are dropped."""
    return (
        _host_rows(docs)
        .select(
            "window_id",
            "window_start",
            "hostname",
            cleaning.normalize_ip(F.col("source_ip")).alias("source_ip"),
            F.explode("rules").alias("rule_text", "count"),
        )
        .withColumn("rule_id", cleaning.coerce_id(F.col("rule_text")))
        .where((F.col("count") > 0) & F.col("rule_id").isNotNull())
        .select("window_id", "window_start", "hostname", "source_ip", "rule_id", "count")
    )


def scan_flat_docs(docs: DataFrame, default_host: str = "global") -> DataFrame:
    """Documents without hosts: rules from the first non-empty of three alternate maps."""
    rules = nested.first_nonempty_map(F.col("rule_counts"), F.col("features"), F.col("feature_vector"))
    return (
        docs.select(
            F.col("_id").alias("window_id"),
            "window_start",
            F.coalesce(F.col("hostname"), F.lit(default_host)).alias("hostname"),
            cleaning.normalize_ip(F.col("source_ip")).alias("source_ip"),
            F.explode(rules).alias("rule_text", "count"),
        )
        .withColumn("rule_id", cleaning.coerce_id(F.col("rule_text")))
        .where((F.col("count") > 0) & F.col("rule_id").isNotNull())
        .drop("rule_text")
    )


def scan_any_docs(docs: DataFrame) -> DataFrame:
    """Host documents where there are hosts, flat documents elsewhere."""
    has_hosts = F.coalesce(F.size("host_triggers"), F.lit(0)) > 0
    return scan_window_docs(docs.where(has_hosts)).unionByName(scan_flat_docs(docs.where(~has_hosts)))


def window_rows_for_host(docs: DataFrame, hostname: str) -> DataFrame:
    """One host's rules; the map lookup also works for hosts with dots in their name."""
    return (
        docs.select(
            F.col("_id").alias("window_id"),
            "window_start",
            nested.safe_map_value(F.col("host_triggers"), F.lit(hostname)).alias("host"),
        )
        .where("host IS NOT NULL")
        .select("window_id", "window_start", F.lit(hostname).alias("hostname"), F.explode("host.rules").alias("rule_text", "count"))
        .withColumn("rule_id", cleaning.coerce_id(F.col("rule_text")))
        .where(F.col("count").isNotNull())
        .drop("rule_text")
    )


def has_host(docs: DataFrame, hostname: str) -> DataFrame:
    return docs.where(F.map_contains_key("host_triggers", hostname))


def unwrap_payload(df: DataFrame, column: str, path: str, into: str = "payload") -> DataFrame:
    """One row per payload object found under a dotted path of a JSON document."""
    return df.withColumn(into, F.explode(nested.payloads(F.col(column), path)))


def scan_search_files(spark: SparkSession, path: str) -> DataFrame:
    """Search-result files, one JSON object each.

    A file is one search answer (one poll interval of one source), which bounds its size.
    """
    return events_from_search(
        spark.read.option("multiLine", "true").schema(SEARCH_RESULT).json(path)
    )


def parse_search_json(df: DataFrame, column: str, keep: Sequence[str] = ()) -> DataFrame:
    """Search results held as text in a column; ``keep`` columns travel along."""
    return events_from_search(df.select(*keep, F.from_json(column, SEARCH_RESULT)["events"].alias("events")), keep)


def events_from_search(results: DataFrame, keep: Sequence[str] = (), default_host: str = "global") -> DataFrame:
    """Rows of search results with the ingest defaults for missing keys."""
    return results.select(*keep, F.inline("events")).select(
        *keep,
        F.coalesce(F.col("sysmon_hostname (custom)"), F.lit(default_host)).alias("hostname"),
        ingest_ip(F.col("Source IP"), F.col("source_ip"), F.col("src_ip")).alias("source_ip"),
        F.coalesce(F.col("Custom Rule").try_cast("bigint"), F.lit(0)).alias("rule_id"),
        F.col("Log Source Time (Minimum)").alias("time_text"),
        F.coalesce(cleaning.coerce_number(F.col("Count")).try_cast("bigint"), F.lit(0)).alias("count"),
    )


def ingest_ip(*candidates: Column) -> Column:
    """First non-empty key; a placeholder there means no address (null)."""
    first = F.coalesce(*[F.nullif(c, F.lit("")) for c in candidates])
    return cleaning.normalize_ip(first, default=None)


def search_events(results: DataFrame, offset_seconds: int = 0) -> DataFrame:
    """Events fit for windowing: with an address and a readable time."""
    ts = timing.parse_ts_any(F.col("time_text"), offset_seconds=offset_seconds)
    return results.withColumn("timestamp", ts).where(
        "source_ip IS NOT NULL AND timestamp IS NOT NULL"
    ).drop("time_text")
