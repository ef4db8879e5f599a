"""Session helpers shared by jobs, tests and the bench."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def local_session(cores: str = "8", app: str = "trigwatch", **conf: str) -> SparkSession:
    """A local session for tests and the bench; a cluster brings its own."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", os.environ.get("SPARK_DRIVER_MEMORY", "12g"))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.checkpoint.dir", os.environ.get("SPARK_CHECKPOINT_DIR") or tempfile.mkdtemp(prefix="trigwatch-checkpoint-"))
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
    )
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The shared checkpoint folder named by ``spark.checkpoint.dir``.

    Only a plain local session that names none falls back to a fresh folder of its own: on a
    cluster a machine-local folder is lost with its executor, so there a name is required.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    named = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    if not named:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a shared folder")
        named = tempfile.mkdtemp(prefix="trigwatch-checkpoint-")
    sc.setCheckpointDir(named)
    return sc.getCheckpointDir()


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint: fixes non-repeatable columns and shortens iterative plans."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


#: largest lookup table that is shipped to every executor
BROADCAST_ROWS = 200_000
BROADCAST_BYTES = 64 * 1024 * 1024


def is_small(df: DataFrame, max_rows: int = BROADCAST_ROWS, max_bytes: int = BROADCAST_BYTES) -> bool:
    """Whether ``df`` has few rows, and as text few bytes. Rows are counted where they are; only
    if they are few is their size summed up."""
    if df.count() > max_rows:
        return False
    size = F.sum(F.octet_length(F.to_json(F.struct(*[F.col(f"`{c}`") for c in df.columns]))))
    return (df.agg(size).first()[0] or 0) <= max_bytes


def checked_broadcast(df: DataFrame, max_rows: int = BROADCAST_ROWS, max_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """Hint a broadcast only after measuring that ``df`` is small; else leave the join to AQE.

    Use it for tables read from small files (catalogue, id map, jobs), where that is cheap,
    and ``settled`` for derived ones.
    """
    return F.broadcast(df) if is_small(df, max_rows, max_bytes) else df


def settled(df: DataFrame, max_rows: int = BROADCAST_ROWS) -> DataFrame:
    """A small derived table computed once, then joined by broadcast if its count allows it."""
    return checked_broadcast(cut_lineage(df), max_rows)
