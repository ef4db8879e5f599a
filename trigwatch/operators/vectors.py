"""Fixed feature layouts and sparse rule maps turned into vectors."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trigwatch.functions.naming import FAMILY_PREFIX, NO_FAMILY, RULE_PREFIX
from trigwatch.session import settled

#: mode -> which features exist, and which wins for a rule that has both
MODES = {
    "per_rule_only": {"families": False, "rules": True, "first": "rule"},
    "family_only": {"families": True, "rules": False, "first": "family"},
    "family_first": {"families": True, "rules": True, "first": "family"},
    "hybrid_exclusive": {"families": True, "rules": True, "first": "rule"},
}


def rule_index(rules: DataFrame) -> DataFrame:
    """Position of every id in sorted order; the table is the rule catalogue, not the events."""
    ordered = Window.orderBy("rule_id")
    return rules.select("rule_id").distinct().withColumn("feature_idx", F.row_number().over(ordered) - 1)


def family_layout(families: DataFrame) -> DataFrame:
    """Sorted families of the catalogue with their positions; uncategorised is none."""
    ordered = Window.orderBy("family")
    return (
        families.where(F.col("family") != NO_FAMILY)
        .select("family")
        .distinct()
        .withColumn("feature_idx", F.row_number().over(ordered) - 1)
    )


def feature_layout(families: DataFrame, mode: str) -> DataFrame:
    """``feature_idx, feature`` of a mode: sorted families first, then sorted rules.

    ``family_first`` leaves out the rules that belong to a family.
    """
    plan = MODES[mode]
    parts = []
    if plan["families"]:
        parts.append(
            families.where(F.col("family") != NO_FAMILY)
            .select(F.lit(0).alias("kind"), F.col("family"), F.lit(None).cast("bigint").alias("rule_id"))
            .distinct()
        )
    if plan["rules"]:
        rules = families if mode != "family_first" else families.where(F.col("family") == NO_FAMILY)
        parts.append(
            rules.select(F.lit(1).alias("kind"), F.lit(None).cast("string").alias("family"), "rule_id").distinct()
        )
    features = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
    ordered = Window.orderBy("kind", "family", "rule_id")
    name = F.when(F.col("kind") == 0, F.concat(F.lit(FAMILY_PREFIX), "family")).otherwise(
        F.concat(F.lit(RULE_PREFIX), F.col("rule_id").cast("string"))
    )
    return features.select(
        (F.row_number().over(ordered) - 1).alias("feature_idx"), name.alias("feature"), "family", "rule_id"
    )


def layout_summary(layout: DataFrame) -> DataFrame:
    return layout.agg(
        F.count(F.lit(1)).alias("dimension"),
        F.count("family").alias("families"),
        F.count("rule_id").alias("rules"),
    )


def feature_slots(families: DataFrame, mode: str) -> DataFrame:
    """``rule_id -> feature_idx`` of a mode, resolved once on the catalogue.

    A rule takes its own position or its family's, whichever the mode prefers, else the
    other; rules with neither get no row and drop out of the vectors.
    """
    layout = feature_layout(families, mode)
    own = layout.where("rule_id IS NOT NULL").select("rule_id", F.col("feature_idx").alias("own_idx"))
    shared = layout.where("family IS NOT NULL").select("family", F.col("feature_idx").alias("family_idx"))
    both = families.select("rule_id", "family").join(own, "rule_id", "left").join(shared, "family", "left")
    order = ["family_idx", "own_idx"] if MODES[mode]["first"] == "family" else ["own_idx", "family_idx"]
    return both.select("rule_id", F.coalesce(*order).alias("feature_idx")).where("feature_idx IS NOT NULL")


def allocate_features(rules: DataFrame, families: DataFrame, mode: str, keys: Sequence[str], value: str = "total_log") -> DataFrame:
    """Long-form vectors: one row per keys and position. One small join, one aggregate."""
    slots = settled(feature_slots(families, mode))
    return rules.join(slots, "rule_id").groupBy(*keys, "feature_idx").agg(F.sum(value).alias("value"))


def entries_to_array(entries: Column, dimension: int) -> Column:
    """Position-sorted ``(feature_idx, value)`` entries to a dense array, linear in its length:
    each entry is preceded by the run of zeros since the one before."""

    def piece(entry: Column, i: Column) -> Column:
        previous = F.when(i > 0, F.get(entries, i - 1)["feature_idx"]).otherwise(F.lit(-1))
        gap = entry["feature_idx"] - previous - 1
        return F.concat(F.array_repeat(F.lit(0.0), gap.cast("int")), F.array(entry["value"].cast("double")))

    last = F.when(F.size(entries) > 0, F.get(entries, F.size(entries) - 1)["feature_idx"]).otherwise(F.lit(-1))
    tail = F.array_repeat(F.lit(0.0), (F.lit(dimension) - 1 - last).cast("int"))
    return F.concat(F.flatten(F.transform(entries, piece)), tail)


def to_vectors(long: DataFrame, keys: Sequence[str], dimension: int, output: str = "features") -> DataFrame:
    """One ML vector per keys, sparse where that is smaller. A group holds at most
    ``dimension`` entries; rows without a position only keep their group, which may become all
    zeros."""
    entry = F.when(F.col("feature_idx").isNotNull(), F.struct("feature_idx", "value"))
    wide = (
        long.groupBy(*keys)
        .agg(F.sort_array(F.collect_list(entry)).alias("_entries"))  # collect_list skips nulls
        .withColumn("_dense", array_to_vector(entries_to_array(F.col("_entries"), dimension)))
    )
    # the assembler compresses what it puts out, so nothing dense leaves the row's own task
    return VectorAssembler(inputCols=["_dense"], outputCol=output).transform(wide).drop("_entries", "_dense")


def vectorize(
    windows: DataFrame, families: DataFrame, mode: str, keys: Sequence[str], carry: Sequence[str] = (),
    rules: str = "aggregated_rules_log1p_sum",
) -> DataFrame:
    """Vectors of aggregated windows, also of those without a known rule (all zeros).

    ``carry`` columns depend on the keys (a label) and are kept by grouping on them too, so
    the windows are read once and not joined to themselves.
    """
    dimension = feature_layout(families, mode).count()
    slots = settled(feature_slots(families, mode))
    kept = [*keys, *carry]
    long = (
        windows.select(*kept, F.explode_outer(rules).alias("rule_text", "part"))
        .withColumn("rule_id", F.col("rule_text").try_cast("bigint"))
        .join(slots, "rule_id", "left")
        .groupBy(*kept, "feature_idx")
        .agg(F.sum("part").alias("value"))
    )
    return to_vectors(long, kept, dimension)


def feature_stats(long: DataFrame, n_rows: Column, dimension: Column) -> DataFrame:
    """Min, max, mean, population deviation and zero share of a matrix given by its non-zeros."""
    cells = n_rows * dimension
    filled = F.count_if(F.col("value") != 0)
    mean = F.sum("value") / cells
    gaps = cells > F.count(F.lit(1))
    return long.agg(
        F.when(gaps, F.least(F.min("value"), F.lit(0.0))).otherwise(F.min("value")).alias("min_value"),
        F.when(gaps, F.greatest(F.max("value"), F.lit(0.0))).otherwise(F.max("value")).alias("max_value"),
        mean.alias("mean_value"),
        F.sqrt(F.sum(F.col("value") * F.col("value")) / cells - mean * mean).alias("std_value"),
        ((cells - filled) / cells).alias("zero_share"),
    )


def scaling_stats(long: DataFrame, position: str, value: str) -> DataFrame:
    """Mean and population deviation per feature of a dense long form."""
    return long.groupBy(position).agg(F.avg(value).alias("mean"), F.stddev_pop(value).alias("std"))


def scale_features(long: DataFrame, position: str = "feature_idx", value: str = "value") -> DataFrame:
    """Zero mean, unit population variance; constant features are only centred."""
    stats = settled(scaling_stats(long, position, value))
    deviation = F.when(F.col("std") == 0, 1.0).otherwise(F.col("std"))
    return (
        long.join(stats, position)
        .withColumn("scaled", (F.col(value) - F.col("mean")) / deviation)
        .drop("mean", "std")
    )


def class_weights(df: DataFrame, label: str = "label", weight: str = "weight") -> DataFrame:
    """Balanced weights ``n / (classes * n_class)``; the table of classes is tiny."""
    counts = df.groupBy(label).agg(F.count(F.lit(1)).alias("_n"))
    every = Window.partitionBy()  # over the few classes
    weights = counts.select(label, (F.sum("_n").over(every) / (F.count(F.lit(1)).over(every) * F.col("_n"))).alias(weight))
    return df.join(settled(weights), label)
