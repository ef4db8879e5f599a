"""Trigger events from exported files: scan, type, label, quarantine."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from trigwatch.functions import cleaning, timing
from trigwatch.operators.filters import drop_incomplete
from trigwatch.schemas import EVENT, EVENT_REQUIRED, TRIGGER_CSV_COLUMNS


def window_id_from_file(file_name: Column) -> Column:
    """File base name without its extension."""
    return F.regexp_replace(F.regexp_extract(file_name, r"([^/]*)$", 1), r"\.[^.]*$", "")


def path_has_segment(path: Column, segment: str) -> Column:
    """True if a directory of the path has exactly this name."""
    return F.array_contains(F.split(path, "/"), segment)


def type_trigger_rows(
    raw: DataFrame, label: str, strict_count: bool = False, null_host: str | None = None
) -> DataFrame:
    """Typed events from text columns; unreadable values become null.

    ``strict_count`` treats '294,516' as unreadable instead of stripping the separator.
    """
    count = (
        cleaning.coerce_number(F.col("count")).try_cast("bigint")
        if strict_count
        else cleaning.normalize_count(F.col("count"))
    )
    return raw.withColumns(
        {
            "hostname": cleaning.normalize_host(F.col("hostname"), null_host),
            "rule_id": cleaning.coerce_id(F.col("rule_id")),
            "timestamp": timing.parse_siem_ts(F.col("timestamp")),
            "count": count,
            "source_label": F.lit(label),
        }
    )


def quarantine_files(df: DataFrame, file_col: str, bad: Column) -> DataFrame:
    """Drop every row of a file that holds at least one bad row.

    The bad files are found by a map-side aggregate and removed with an anti join, so no
    file, however large, is gathered in one task.
    """
    bad_files = df.where(F.coalesce(bad, F.lit(True))).select(file_col).distinct()
    return df.join(bad_files, file_col, "left_anti")


def scan_trigger_csv(
    spark: SparkSession,
    path: str,
    label: str,
    bad_rows: str = "drop_row",
    strict_count: bool = False,
    null_host: str | None = None,
) -> DataFrame:
    """Recursive scan of exported trigger files, one window per file.

    ``bad_rows='quarantine_file'`` skips a whole file on one unparsable timestamp. A folder
    without files gives an empty typed table.
    """
    text_schema = ", ".join(f"`{name}` STRING" for name in TRIGGER_CSV_COLUMNS)
    # the header is checked against the schema, so a file in another layout fails loudly
    reader = (
        spark.read.option("header", "true")
        .option("recursiveFileLookup", "true")
        .option("pathGlobFilter", "*.csv")
        .option("enforceSchema", "false")
        .schema(text_schema)
    )
    try:
        raw = reader.csv(path)
    except AnalysisException as missing:
        if missing.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], EVENT)
    raw = raw.withColumn("_file", F.col("_metadata.file_path")).withColumnsRenamed(TRIGGER_CSV_COLUMNS)
    typed = type_trigger_rows(raw, label, strict_count, null_host).withColumns(
        {"window_id": window_id_from_file(F.col("_file")), "source_ip": F.lit(None).cast("string")}
    )
    if bad_rows == "quarantine_file":
        typed = quarantine_files(typed, "_file", F.col("timestamp").isNull())
    return drop_incomplete(typed, EVENT_REQUIRED).select(
        "hostname", "source_ip", "rule_id", "timestamp", "count", "source_label", "window_id"
    )


def scan_labelled(normal: DataFrame, attack: DataFrame) -> DataFrame:
    """Both training sets with their label."""
    return normal.withColumn("source_label", F.lit("normal")).unionByName(
        attack.withColumn("source_label", F.lit("attack"))
    )
