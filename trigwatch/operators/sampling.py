"""Deterministic samples, splits and folds. Ranks are global, so labels may be of any size."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trigwatch.functions.ordering import ranked_within


def shuffle_order(key: str, seed: int | None) -> list[Column]:
    """Row order of a shuffle: by md5 of key and seed (the same in any engine), or by key for a fixed order."""
    return [F.col(key)] if seed is None else [shuffled(key, seed), F.col(key)]


def shuffled(key: str, seed: int) -> Column:
    return F.md5(F.concat_ws(":", F.lit(str(seed)), F.col(key).cast("string")))


def stratified_split(df: DataFrame, label: str, key: str, test_share: float = 0.2, seed: int | None = 42) -> DataFrame:
    """Adds ``split``: per label the first ``round(share * n)`` rows of the order are the test set."""
    ranked = ranked_within(_with_order(df, key, seed), label, [F.col(c) for c in _order_names(seed)] + [F.col(key)])
    test = F.col("rank") <= F.round(F.col("group_size") * test_share)
    return ranked.withColumn("split", F.when(test, "test").otherwise("train")).drop("rank", "group_size", *_order_names(seed))


def stratified_folds(df: DataFrame, label: str, key: str, folds: int = 5, seed: int | None = 42) -> DataFrame:
    """Adds ``fold``: rows of a label are dealt to the folds in turn."""
    ranked = ranked_within(_with_order(df, key, seed), label, [F.col(c) for c in _order_names(seed)] + [F.col(key)])
    fold = ((F.col("rank") - 1) % folds).cast("int")
    return ranked.withColumn("fold", fold).drop("rank", "group_size", *_order_names(seed))


def _order_names(seed: int | None) -> Sequence[str]:
    return () if seed is None else ("_shuffle",)


def _with_order(df: DataFrame, key: str, seed: int | None) -> DataFrame:
    return df if seed is None else df.withColumn("_shuffle", shuffled(key, seed))


def sample_rows(df: DataFrame, n: int, key: str, seed: int | None = 42) -> DataFrame:
    """``n`` rows without replacement; a distributed top-n by hash, repeatable on retry."""
    return df.orderBy(*shuffle_order(key, seed)).limit(n)


def background_rows(df: DataFrame, n: int, key: str, label: str = "label", fewest: int = 0, seed: int | None = 42) -> DataFrame:
    """Sample of benign rows for explanations; of all rows if fewer than ``fewest`` are benign."""
    enough = df.agg(F.count_if(F.col(label) == 0) >= fewest).scalar()
    return sample_rows(df.where(~enough | (F.col(label) == 0)), n, key, seed)
