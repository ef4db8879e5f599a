"""Helpers shared by the corpus operators."""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from trigwatch.session import ensure_checkpoint_dir
from trigwatch.sources.versioned import delete_folder

#: a group is hot when it holds more than one row in so many; there are fewer hot groups than this
HOT_SHARE = 200
#: rows that a Python worker gets at a time
BATCH_ROWS = 1024


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder below ``spark.checkpoint.dir``, which driver and executors share."""
    return f"{ensure_checkpoint_dir(spark)}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str, folder: str | None = None) -> DataFrame:
    """``df`` written once to the shared folder and read back: it is computed once, and a
    lost executor costs no more than its own tasks."""
    path = shared_folder(df.sparkSession, name) if folder is None else f"{folder}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


class Scratch:
    """Tables that an operator stores on its way, in one shared folder that goes when it is done."""

    def __init__(self, spark: SparkSession, name: str) -> None:
        self.spark, self.folder = spark, shared_folder(spark, name)

    def stored(self, df: DataFrame, name: str) -> DataFrame:
        return stored(df, name, self.folder)

    def clear(self) -> None:
        delete_folder(self.spark, self.folder)


def batched(df: DataFrame) -> DataFrame:
    """``df``, whose session from now on hands at most ``BATCH_ROWS`` rows to a Python worker at
    a time (Spark itself bounds the bytes): rows with texts are long, and workers keep the
    memory that their largest batch took."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(df.sparkSession.conf.get(key)) <= BATCH_ROWS:
        df.sparkSession.conf.set(key, str(BATCH_ROWS))
    return df


def fresh(df: DataFrame, *names: str) -> list[str]:
    """The names, with underscores in front until none is a column of ``df``."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name = f"_{name}"
        out.append(name)
    return out


def filled(text: str = "text") -> Column:
    """A text column, null read as the empty text."""
    return F.coalesce(F.col(f"`{text}`"), F.lit(""))


def hash_sample(df: DataFrame, text: str, n: int, most_chars: int = 1 << 15) -> list[str]:
    """``n`` distinct texts in hash order, at most ``most_chars`` of each; only hashes are sorted."""
    keyed = df.select(F.xxhash64(text).alias("at"), F.col(text).alias("text"))
    chosen = keyed.select("at").distinct().orderBy("at").limit(n)
    found = keyed.join(F.broadcast(chosen), "at").dropDuplicates(["at"]).select("at", F.substring("text", 1, most_chars))
    return [r[1] for r in sorted(found.collect())]


def attach_groups(rows: DataFrame, groups: DataFrame, key: str, size: str, spread: Sequence[str]) -> DataFrame:
    """Left join of ``rows`` with ``groups`` (one row per ``key``, which has ``size`` rows) that
    no large group can slow down.

    Groups with more than 1 / ``HOT_SHARE`` of all rows are fewer than ``HOT_SHARE``, so they
    are broadcast and their rows stay where they are; all others meet in a shuffle join, in
    which rows of hot groups are dealt by ``spread`` columns. ``groups`` is read twice.
    """
    others = [c for c in groups.columns if c != key]
    hot_col, cold_col, deal_col = fresh(rows, "hot_group", "cold_group", "deal")
    total = groups.agg(F.sum(size)).first()[0] or 0
    hot = groups.where(F.col(size) * HOT_SHARE > total).select(F.col(key), F.struct(*others).alias(hot_col))
    cold = groups.where(F.col(size) * HOT_SHARE <= total).select(
        F.col(key), F.lit(0).cast("long").alias(deal_col), F.struct(*others).alias(cold_col)
    )
    deal = F.when(F.col(hot_col).isNull(), F.lit(0).cast("long")).otherwise(
        1 + F.pmod(F.xxhash64(*spread), F.lit(9973))
    )
    joined = rows.join(F.broadcast(hot), key, "left").withColumn(deal_col, deal).join(cold, [key, deal_col], "left")
    return joined.select(
        *[F.col(f"`{c}`") for c in rows.columns],
        *[F.coalesce(F.col(hot_col)[c], F.col(cold_col)[c]).alias(c) for c in others],
    )
