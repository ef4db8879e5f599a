"""Row filters and table checks."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trigwatch.schemas import EVENT_REQUIRED


def drop_incomplete(df: DataFrame, required: Sequence[str] = EVENT_REQUIRED) -> DataFrame:
    return df.na.drop(subset=list(required))


def positive_counts(df: DataFrame, count: str = "count") -> DataFrame:
    return df.where(F.col(count) > 0)


def check_events(df: DataFrame, labels: Sequence[str] = ("normal", "attack", "detection")) -> DataFrame:
    """Number of violations per rule, in one pass; an empty table has none.

    Missing columns and wrong types are reported as one violation each, from the schema.
    """
    wanted = {"hostname": "string", "rule_id": "bigint", "timestamp": "timestamp", "count": "bigint", "source_label": "string"}
    have = dict(df.dtypes)
    numeric = {"tinyint", "smallint", "int", "bigint", "float", "double"}
    structural = {}
    for name, kind in wanted.items():
        got = have.get(name)
        fits = got is not None and (
            got in numeric if kind == "bigint" else got.startswith("timestamp") if kind == "timestamp" else got == kind
        )
        structural[f"column_{name}"] = 0 if fits else 1
    checks: dict[str, Column] = {}
    if not structural["column_rule_id"]:
        checks["rule_id_null"] = F.col("rule_id").isNull()
    if not structural["column_count"]:
        checks["count_null"] = F.col("count").isNull()
        checks["count_negative"] = F.col("count") < 0
    if not structural["column_hostname"]:
        checks["hostname_null"] = F.col("hostname").isNull()
    if not structural["column_timestamp"]:
        checks["timestamp_null"] = F.col("timestamp").isNull()
    if not structural["column_source_label"]:
        checks["label_unknown"] = ~F.coalesce(F.col("source_label").isin(*labels), F.lit(False))
    counted = df.agg(
        *[F.lit(n).cast("bigint").alias(name) for name, n in structural.items()],
        *[F.count_if(c).alias(name) for name, c in checks.items()],
    )
    return counted.unpivot([], list(counted.columns), "check", "violations")


def check_windows(df: DataFrame) -> DataFrame:
    """Violations of the aggregated-window layout; here an empty table is one."""
    needed = ("window_id", "hostname", "aggregated_rules", "total_events", "unique_rules")
    have = dict(df.dtypes)
    structural = {f"column_{n}": 0 if n in have else 1 for n in needed}
    structural["rules_not_a_map"] = 0 if have.get("aggregated_rules", "").startswith("map") else 1
    for name in ("total_events", "unique_rules"):
        structural[f"{name}_not_integer"] = 0 if have.get(name) in ("int", "bigint") else 1
    checks = {"empty_table": F.when(F.count(F.lit(1)) == 0, 1).otherwise(0).cast("bigint")}
    if "total_events" in have:
        checks["total_negative"] = F.count_if(F.col("total_events") < 0)
    if "is_attack" in have:
        checks["label_unknown"] = F.count_if(~F.coalesce(F.col("is_attack").isin(0, 1), F.lit(False)))
    counted = df.agg(
        *[F.lit(n).cast("bigint").alias(name) for name, n in structural.items()],
        *[c.alias(name) for name, c in checks.items()],
    )
    return counted.unpivot([], list(counted.columns), "check", "violations")


def time_range(df: DataFrame, start: str, end: str, column: str = "timestamp", hostname: str | None = None) -> DataFrame:
    """Half-open ``[start, end)``, optionally one host. Literals, so the filter reaches the scan."""
    ts = F.col(column)
    kept = df.where(
        (ts >= F.lit(start).cast("timestamp_ntz")) & (ts < F.lit(end).cast("timestamp_ntz"))
    )
    return kept if hostname is None else kept.where(F.col("hostname") == hostname)


def query_results(
    results: DataFrame, start: str | None = None, end: str | None = None,
    label: int | None = None, min_confidence: float | None = None,
) -> DataFrame:
    """Stored detections, newest first."""
    if start is not None and end is not None:
        results = time_range(results, start, end, "prediction_time")
    if label is not None:
        results = results.where(F.col("predicted_label") == label)
    if min_confidence is not None:
        results = results.where(F.col("confidence") >= min_confidence)
    return results.orderBy(F.desc("prediction_time"), "window_id", "hostname")


def query_events(
    events: DataFrame, start: str | None = None, end: str | None = None, rule_id: int | None = None,
    hostname: str | None = None, limit: int | None = None, key: str = "event_id",
) -> DataFrame:
    """Matching events, newest first; with a limit a top-k report."""
    if start is not None and end is not None:
        events = time_range(events, start, end)
    if rule_id is not None:
        events = events.where(F.col("rule_id") == rule_id)
    if hostname is not None:
        events = events.where(F.col("hostname") == hostname)
    found = events.orderBy(F.desc("timestamp"), key)
    return found if limit is None else found.limit(limit)


def query_windows(
    windows: DataFrame, start: str | None = None, end: str | None = None,
    hostname: str | None = None, limit: int | None = None,
) -> DataFrame:
    """Windows of a time range that saw a host, newest first; with a limit a top-k report."""
    if start is not None and end is not None:
        windows = time_range(windows, start, end, "window_start")
    if hostname is not None:
        windows = windows.where(F.map_contains_key("host_triggers", hostname))
    found = windows.orderBy(F.desc("window_start"), F.desc("window_id"))
    return found if limit is None else found.limit(limit)


def labelled_windows(windows: DataFrame, start: str, end: str, label: str = "label") -> DataFrame:
    return time_range(windows, start, end, "window_start").where(
        (F.col("window_end") <= F.lit(end).cast("timestamp_ntz")) & F.col(label).isNotNull()
    )


def windows_contained(windows: DataFrame, start: str, end: str, label: str = "label") -> DataFrame:
    """Unlabelled windows strictly inside the range; swapped bounds are put in order."""
    a, b = F.lit(start).cast("timestamp_ntz"), F.lit(end).cast("timestamp_ntz")
    return windows.where(
        (F.col("window_start") > F.least(a, b)) & (F.col("window_end") < F.greatest(a, b)) & F.col(label).isNull()
    )


def latest_windows(windows: DataFrame, n: int = 2, key: str = "window_id") -> DataFrame:
    return windows.orderBy(F.desc(key)).limit(n)


def window_by_id(windows: DataFrame, window_id: str) -> DataFrame:
    return windows.where(F.col("window_id") == window_id)


def source_event_filter(
    events: DataFrame,
    not_null: Sequence[str],
    equal: dict[str, object],
    any_of: dict[str, Sequence[object]],
    start: str,
    end: str,
) -> DataFrame:
    """The alert source's predicate: not-null, equality and IN-list tests inside a time range."""
    tests = [F.col(c).isNotNull() for c in not_null]
    tests += [F.col(c) == v for c, v in equal.items()]
    tests += [F.col(c).isin(*values) for c, values in any_of.items()]
    return time_range(events.where(reduce(lambda a, b: a & b, tests)), start, end)


def nonfinite(value: Column) -> Column:
    return F.isnan(value) | (F.abs(value) == float("inf"))


def nonfinite_rows(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return df.where(reduce(lambda a, b: a | b, [nonfinite(F.col(c)) for c in columns]))


def drop_zero_importance(df: DataFrame, importance: str = "importance") -> DataFrame:
    value = F.col(importance)
    return df.where(value.isNotNull() & ~F.isnan(value) & (value > 0))


def exclude_names(df: DataFrame, marker: str, name: str = "display_name") -> DataFrame:
    return df.where(~F.coalesce(F.col(name), F.lit("")).contains(marker))


def threshold_flag(probability: Column, threshold: float) -> Column:
    """Strictly above the threshold, whatever label the model predicts."""
    return probability > threshold
