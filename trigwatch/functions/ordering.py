"""Global ranks, running totals and exact order statistics without a one-task window.

A window without PARTITION BY, or with one hot partition value, sorts everything in a
single task. Here rows are range-partitioned on the full ordering instead, each slice is
scanned on its own, and the slice totals (one row per slice) supply the offsets.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trigwatch.session import cut_lineage, settled


def running_totals(
    df: DataFrame,
    order_by: Sequence[Column],
    totals: Mapping[str, Column],
    grand: Mapping[str, str] | None = None,
    slices: int | None = None,
) -> DataFrame:
    """Add an inclusive running sum per entry of ``totals`` along one global ordering, and
    for each entry of ``grand`` (output name -> entry) its sum over all rows.

    ``order_by`` must be unique per row (end it with a key, or aggregate equal values
    first); then no slice can be larger than its share, whatever the skew. The
    range-partitioned rows are checkpointed: the range bounds come from a sample, so the
    slice numbers must be fixed before they are used twice.
    """
    spark = df.sparkSession
    slices = slices or int(spark.conf.get("spark.sql.shuffle.partitions"))
    grand = grand or {}
    sliced = cut_lineage(
        df.withColumns({f"_add_{name}": value for name, value in totals.items()})
        .repartitionByRange(slices, *order_by)
        .withColumn("_slice", F.spark_partition_id())
    )
    # one row per slice: these windows are bounded by the number of slices
    before = Window.orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.orderBy("_slice").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    offsets = (
        sliced.groupBy("_slice")
        .agg(*[F.sum(f"_add_{name}").alias(f"_sum_{name}") for name in totals])
        .select(
            "_slice",
            *[F.coalesce(F.sum(f"_sum_{name}").over(before), F.lit(0)).alias(f"_before_{name}") for name in totals],
            *[F.sum(f"_sum_{name}").over(everything).alias(out) for out, name in grand.items()],
        )
    )
    inside = Window.partitionBy("_slice").orderBy(*order_by).rowsBetween(Window.unboundedPreceding, 0)
    return (
        sliced.withColumns({name: F.sum(f"_add_{name}").over(inside) for name in totals})
        .join(F.broadcast(offsets), "_slice")
        .withColumns({name: F.col(name) + F.col(f"_before_{name}") for name in totals})
        .drop("_slice", *[f"_add_{n}" for n in totals], *[f"_before_{n}" for n in totals])
    )


def ranked_within(
    df: DataFrame, group: str, order_by: Sequence[Column], rank: str = "rank", size: str = "group_size"
) -> DataFrame:
    """1-based rank of every row inside its group, and the group size, for groups of any size.

    The order must be unique per row. Groups are few (labels, clusters) next to the rows.
    """
    ranked = running_totals(df, [F.col(group), *order_by], {"_global": F.lit(1)})
    firsts = ranked.groupBy(group).agg(F.min("_global").alias("_first"), F.count(F.lit(1)).alias(size))
    return (
        ranked.join(settled(firsts), group)
        .withColumn(rank, F.col("_global") - F.col("_first") + 1)
        .drop("_global", "_first")
    )


def exact_percentile_by(
    df: DataFrame, group: str, value: str, key: str, q: float, name: str = "threshold"
) -> DataFrame:
    """Exact linearly interpolated percentile per group, also for a group that holds most rows."""
    ranked = ranked_within(df.select(group, value, key), group, [F.col(value), F.col(key)])
    place = F.lit(q) * (F.col("group_size") - 1)
    low = F.floor(place) + 1
    return (
        ranked.withColumns({"_low": low, "_part": place - F.floor(place)})
        .where((F.col("rank") == F.col("_low")) | (F.col("rank") == F.col("_low") + 1))
        .groupBy(group)
        .agg(
            F.max(F.when(F.col("rank") == F.col("_low"), F.col(value))).alias("_a"),
            F.max(F.when(F.col("rank") == F.col("_low") + 1, F.col(value))).alias("_b"),
            F.max("_part").alias("_part"),
        )
        .select(
            group,
            (F.col("_a") + F.coalesce(F.col("_b") - F.col("_a"), F.lit(0.0)) * F.col("_part")).alias(name),
        )
    )
