"""Batch-job lists, window calendars, feature tables and saved aggregates."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trigwatch.functions import cleaning, nested, timing
from trigwatch.schemas import JOBS_CSV

JOB_TIME_FORMATS = ("yyyy-MM-dd'T'HH:mm:ss", "yyyy-MM-dd HH:mm:ss")


def check_jobs(raw: DataFrame) -> DataFrame:
    """Typed jobs with the reason a row is unusable in ``error`` (null = good); blank rows skipped."""
    text = {c: F.coalesce(F.trim(F.col(c)), F.lit("")) for c in raw.columns}
    rows = raw.select([value.alias(name) for name, value in text.items()]).where(
        "hostname <> '' OR start_time <> '' OR end_time <> '' OR output_dir <> ''"
    )
    start = timing.parse_ts_any(F.col("start_time"), JOB_TIME_FORMATS)
    end = timing.parse_ts_any(F.col("end_time"), JOB_TIME_FORMATS)
    size_text = F.nullif(F.col("window_size_minutes"), F.lit(""))
    size = size_text.try_cast("int")
    error = (
        F.when(F.col("hostname") == "", "missing hostname")
        .when((F.col("start_time") == "") | (F.col("end_time") == ""), "missing time")
        .when(F.col("output_dir") == "", "missing output_dir")
        .when(start.isNull() | end.isNull(), "bad time")
        .when(size_text.isNotNull() & size.isNull(), "bad window size")
        .when(end <= start, "end not after start")
    )
    optional = [F.nullif(F.col(c), F.lit("")).alias(c) for c in ("db_name", "collection", "source_schema")]
    return rows.select(
        "hostname",
        start.alias("start_time"),
        end.alias("end_time"),
        "output_dir",
        *optional,
        size.alias("window_size_minutes"),
        error.alias("error"),
    )


def scan_jobs(spark: SparkSession, path: str, on_error: str = "raise") -> DataFrame:
    """Job file; ``on_error='raise'`` fails the query on the first bad row, ``'keep'`` reports them."""
    jobs = check_jobs(spark.read.option("header", "true").schema(JOBS_CSV).csv(path))
    if on_error == "keep":
        return jobs
    failed = F.raise_error(F.concat(F.lit("job list: "), F.col("error")))
    checked = F.when(F.col("error").isNull(), F.col("hostname")).otherwise(failed.cast("string"))
    return jobs.withColumn("hostname", checked).drop("error")


def window_calendar(bounds: DataFrame, minutes: int) -> DataFrame:
    """Regular slots covering ``[start, end)`` of every bounds row."""
    step = F.make_dt_interval(mins=F.lit(minutes))
    slots = F.sequence("start", F.col("end") - step, step)
    return bounds.where(F.col("start") + step <= F.col("end")).select(
        F.explode(slots).alias("window_start")
    ).withColumn("window_end", F.col("window_start") + step)


def scan_calendar(spark: SparkSession, path: str) -> DataFrame:
    """Calendar file with ``d/M/yyyy H:mm`` bounds."""
    raw = spark.read.option("header", "true").schema("`start time` STRING, `end time` STRING").csv(path)
    return raw.select(
        *[
            F.try_to_timestamp(F.trim(F.col(f"`{name} time`")), F.lit("d/M/yyyy H:mm"))
            .cast("timestamp_ntz")
            .alias(f"window_{name}")
            for name in ("start", "end")
        ]
    )


# Descriptive columns of a saved feature table that are not features.
FEATURE_TABLE_METADATA = ("window_id", "hostname", "source_ip", "source_label", "window_start", "window_end")


def scan_feature_csv(
    raw: DataFrame, label_col: str = "label", metadata: Sequence[str] = FEATURE_TABLE_METADATA
) -> DataFrame:
    """Numeric features and label of a wide table; what is not a number becomes 0."""
    features = [c for c in raw.columns if c != label_col and c not in metadata]
    return raw.select(
        F.col(f"`{label_col}`").try_cast("int").alias("label"),
        *[F.coalesce(cleaning.coerce_number(F.col(f"`{c}`")), F.lit(0.0)).alias(c) for c in features],
    )


def save_aggregates(windows: DataFrame, path: str) -> None:
    """Windows as CSV: maps as JSON text, bounds as text."""
    texts = {
        name: nested.rules_text(F.col(name))
        for name in ("aggregated_rules", "aggregated_rules_log1p_sum")
        if name in windows.columns
    }
    bounds = {name: F.date_format(name, timing.PLAIN_FORMAT) for name in ("window_start", "window_end")}
    windows.withColumns({**texts, **bounds}).write.mode("overwrite").option("header", "true").option(
        "escape", '"'
    ).csv(path)


def load_aggregates(spark: SparkSession, path: str) -> DataFrame:
    """Saved windows with their maps and times restored."""
    raw = spark.read.option("header", "true").option("escape", '"').csv(path)
    typed = {
        "aggregated_rules": nested.rules_map(F.col("aggregated_rules")),
        "total_events": F.col("total_events").try_cast("bigint"),
        "unique_rules": F.col("unique_rules").try_cast("bigint"),
        "window_start": timing.parse_ts_any(F.col("window_start"), (timing.PLAIN_FORMAT,)),
        "window_end": timing.parse_ts_any(F.col("window_end"), (timing.PLAIN_FORMAT,)),
    }
    if "aggregated_rules_log1p_sum" in raw.columns:
        typed["aggregated_rules_log1p_sum"] = F.from_json("aggregated_rules_log1p_sum", "map<string,double>")
    return raw.withColumns(typed)
