"""Rule catalogue, id translation, family overrides and rule names."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trigwatch.functions import cleaning
from trigwatch.schemas import CATALOG_CSV, ID_MAP_CSV


def read_catalog_files(spark: SparkSession, path: str) -> DataFrame:
    """Raw catalogue rows with their file name. Spark's CSV reader skips a byte-order mark."""
    return (
        spark.read.option("header", "true")
        .schema(CATALOG_CSV)
        .csv(path)
        .select("*", F.col("_metadata.file_name").alias("file"))
    )


def clean_catalog(raw: DataFrame) -> DataFrame:
    """One row per readable id; on duplicates the last file by name wins."""
    typed = raw.select(
        cleaning.coerce_id(F.col("id")).alias("rule_id"),
        F.col("name"),
        F.col("type"),
        (F.lower(F.trim("enabled")) == "true").alias("enabled"),
        F.col("origin"),
        F.col("file"),
    ).where("rule_id IS NOT NULL")
    return (
        typed.groupBy("rule_id")
        .agg(F.max_by(F.struct("name", "type", "enabled", "origin"), F.struct("file", "name")).alias("r"))
        .select("rule_id", "r.*")
    )


def scan_catalog(spark: SparkSession, path: str) -> DataFrame:
    return clean_catalog(read_catalog_files(spark, path))


def clean_id_map(raw: DataFrame) -> DataFrame:
    """Translation rows with both ids readable, one per source id (last production id wins)."""
    return (
        raw.select(
            F.trim("uat_rule_id").try_cast("bigint").alias("uat_rule_id"),
            F.trim("prod_rule_id").try_cast("bigint").alias("prod_rule_id"),
            F.nullif(F.trim("rule_name"), F.lit("")).alias("rule_name"),
        )
        .where("uat_rule_id IS NOT NULL AND prod_rule_id IS NOT NULL")
        .groupBy("uat_rule_id")
        .agg(F.max(F.struct("prod_rule_id", "rule_name")).alias("m"))
        .select("uat_rule_id", "m.*")
    )


def scan_id_map(spark: SparkSession, path: str) -> DataFrame:
    return clean_id_map(spark.read.option("header", "true").schema(ID_MAP_CSV).csv(path))


def family_overrides(text: DataFrame, column: str = "value") -> DataFrame:
    """``{"family_mapping": {"100221": "family", …}}`` to rows; keys that are no ids are notes."""
    mapping = F.from_json(F.get_json_object(F.col(column), "$.family_mapping"), "map<string,string>")
    return (
        text.select(F.explode(mapping).alias("id_text", "family"))
        .select(F.col("id_text").try_cast("bigint").alias("rule_id"), "family")
        .where("rule_id IS NOT NULL")
    )


def scan_family_overrides(spark: SparkSession, path: str) -> DataFrame:
    return family_overrides(spark.read.text(path, wholetext=True))


def rule_names(*sources: DataFrame) -> DataFrame:
    """Names by source precedence: the first source that names an id wins; ties by name."""
    stacked = None
    for priority, source in enumerate(sources):
        named = source.select(
            F.col("rule_id").cast("bigint"), F.trim("rule_name").alias("rule_name"), F.lit(priority).alias("priority")
        ).where("rule_id IS NOT NULL AND rule_name <> ''")
        stacked = named if stacked is None else stacked.unionByName(named)
    return stacked.groupBy("rule_id").agg(F.min_by("rule_name", F.struct("priority", "rule_name")).alias("rule_name"))


def first_seen(df: DataFrame, key: str, value: str, order: str) -> DataFrame:
    """First value per key over ordered sources, map-side combined so hot keys stay small."""
    return df.groupBy(key).agg(F.min_by(value, F.struct(order, value)).alias(value))


def discover_features(*sources: DataFrame) -> DataFrame:
    """Sorted distinct rule ids over all sources."""
    ids = None
    for source in sources:
        part = source.select(F.col("rule_id").cast("bigint")).where("rule_id IS NOT NULL")
        ids = part if ids is None else ids.unionByName(part)
    return ids.distinct().orderBy("rule_id")
