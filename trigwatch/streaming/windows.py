"""Continuous ingest, detection and retention with Structured Streaming.

Watermarks need TIMESTAMP, so wall-clock event time is read in the session zone (UTC)
while it is in a stream and written back as TIMESTAMP_NTZ.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery, StreamingQueryListener

from trigwatch.functions import cleaning, timing
from trigwatch.operators import lookups, store
from trigwatch.operators.ranking import detect
from trigwatch.session import cut_lineage
from trigwatch.sources import versioned

#: how often a sink that another writer has overtaken merges its batch again
SINK_TRIES = 5


def stream_time(df: DataFrame, slack: str) -> DataFrame:
    """Event time with a watermark. Rows later than ``slack`` never reach a stateful window;
    ``store_counts`` keeps no state and takes rows of any age."""
    return df.withColumn("timestamp", F.col("timestamp").cast("timestamp")).withWatermark("timestamp", slack)


def _watermarked(events: DataFrame, slack: str | None) -> DataFrame:
    if not events.isStreaming:
        return events
    if slack is None:
        raise ValueError("a stream needs a slack: say how late its rows may be")
    return stream_time(events, slack)


def tumbling_counts(events: DataFrame, size_minutes: int, keys: Sequence[str], slack: str | None = None) -> DataFrame:
    """Rule counts per window and keys; works on a stream and on a table alike."""
    events = _watermarked(events, slack)
    slot = F.window("timestamp", f"{size_minutes} minutes")
    return _flat(events.groupBy(slot, *keys).agg(*_sums()), keys)


def sliding_counts(events: DataFrame, length: str, step: str, keys: Sequence[str], slack: str | None = None) -> DataFrame:
    """Overlapping windows: every event counts in each window that covers it."""
    events = _watermarked(events, slack)
    return _flat(events.groupBy(F.window("timestamp", length, step), *keys).agg(*_sums()), keys)


def _sums():
    return [
        F.sum("count").alias("count"),
        F.sum(cleaning.log_count(F.col("count"))).alias("log_count"),
        F.count(F.lit(1)).alias("n_rows"),
    ]


def _flat(grouped: DataFrame, keys: Sequence[str]) -> DataFrame:
    return grouped.select(
        F.col("window.start").cast("timestamp_ntz").alias("window_start"),
        F.col("window.end").cast("timestamp_ntz").alias("window_end"),
        *keys, "count", "log_count", "n_rows",
    )


def snapped(events: DataFrame, size: int, tolerance_seconds: int = 5) -> DataFrame:
    """Events moved to their snapped boundary, for sources whose query times jitter."""
    return events.withColumn("timestamp", timing.snap_window(F.col("timestamp").cast("timestamp_ntz"), size, tolerance_seconds))


def upsert_sink(path: str, keys: Sequence[str], partition_time: str) -> Callable:
    """Batch writer that replaces rows by key. The version is the start of the run, then the
    batch number: a replayed batch changes nothing, and a later run wins over an earlier one
    also if its checkpoint, and with it the batch number, begins anew."""
    started = int(time.time() * 1000) * 1_000_000

    def write(batch: DataFrame, batch_id: int) -> None:
        # written once: the merge reads the batch twice, and its state should be updated once
        dated = cut_lineage(
            batch.withColumns({"version": F.lit(started + batch_id).cast("bigint"), "window_date": F.to_date(partition_time)})
        )
        if not dated.isEmpty():
            store.upsert_table(dated, path, keys, "version", tries=SINK_TRIES)

    return write


def store_counts(
    events: DataFrame, path: str, checkpoint: str, size_minutes: int, keys: Sequence[str], once: bool = True, interval: str = "15 minutes"
) -> StreamingQuery:
    """Window counts of a stream in which rows may be late by any time: none is dropped.

    Each batch is summed by itself and stored as a contribution under its checkpoint and batch
    number, so a replay counts once; ``stored_counts`` adds the contributions up. The checkpoint
    names the source: a new one over rows that were already counted counts them again, so start
    anew with a new table.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        counted = tumbling_counts(batch, size_minutes, keys)
        dated = cut_lineage(
            counted.withColumns({"source": F.lit(checkpoint), "version": F.lit(batch_id).cast("bigint"), "window_date": F.to_date("window_start")})
        )
        if not dated.isEmpty():
            store.upsert_table(dated, path, ["window_start", "window_end", *keys, "source"], "version", merge="sum", tries=SINK_TRIES)

    writer = events.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    writer = writer.trigger(availableNow=True) if once else writer.trigger(processingTime=interval)
    return writer.start()


def stored_counts(spark: SparkSession, path: str, keys: Sequence[str]) -> DataFrame:
    """The window counts that ``store_counts`` has stored so far."""
    return store.read_table(spark, path).groupBy("window_start", "window_end", *keys).agg(*[F.sum(c).alias(c) for c in ("count", "log_count", "n_rows")])


def stream_upsert(
    stream: DataFrame, path: str, checkpoint: str, keys: Sequence[str], partition_time: str = "window_start",
    once: bool = True, interval: str = "15 minutes",
) -> StreamingQuery:
    """Updated windows of a stream written over the stored ones."""
    writer = stream.writeStream.outputMode("update").foreachBatch(upsert_sink(path, keys, partition_time)).option("checkpointLocation", checkpoint)
    writer = writer.trigger(availableNow=True) if once else writer.trigger(processingTime=interval)
    return writer.start()


def detect_sink(score: Callable[[DataFrame], DataFrame], threshold: float, path: str) -> Callable:
    """Batch writer that scores closed windows and stores each verdict by window and host.

    A window that is no alert is stored too, as a withdrawal: scored again, an alert takes the
    new confidence, or goes. As in ``upsert_sink`` a version is the start of the run and then the
    batch, so the latest scoring wins, whatever its figures, and a replayed batch changes nothing.
    """
    started = int(time.time() * 1000) * 1_000_000

    def write(batch: DataFrame, batch_id: int) -> None:
        results = cut_lineage(
            detect(score(batch), threshold).select(
                "window_id", "hostname", "predicted_label", F.col("probability").alias("confidence"),
                F.col("window_end").alias("prediction_time"), F.coalesce("is_alert", F.lit(False)).alias("is_alert"),
                F.lit(started + batch_id).cast("bigint").alias("version"), F.to_date("window_start").alias("window_date"),
            )
        )
        if not results.isEmpty():
            store.upsert_table(results, path, ["window_id", "hostname"], "version", tries=SINK_TRIES)

    return write


def stored_alerts(spark: SparkSession, path: str, version: int | None = None) -> DataFrame:
    """The alerts that stand: the latest verdict on each window and host, without withdrawn ones."""
    return store.read_table(spark, path, version).where("is_alert").drop("is_alert", "version")


def incremental_detect(
    windows: DataFrame, score: Callable[[DataFrame], DataFrame], threshold: float, path: str, checkpoint: str,
    once: bool = True, interval: str = "15 minutes",
) -> StreamingQuery:
    """Score windows once they are closed (append mode), write verdicts idempotently; read them
    with ``stored_alerts``."""
    writer = windows.writeStream.outputMode("append").foreachBatch(detect_sink(score, threshold, path)).option("checkpointLocation", checkpoint)
    writer = writer.trigger(availableNow=True) if once else writer.trigger(processingTime=interval)
    return writer.start()


def drop_expired_days(spark: SparkSession, path: str, cutoff: str, keep_hosts: DataFrame | None = None, partition: str = "window_date") -> int:
    """Drop the days older than the cutoff date; days with protected hosts keep those rows.

    Works on the table's manifest (one entry per day), never on the rows of expired days unless
    hosts are protected. All days go in one step; their files go with ``versioned.vacuum``.
    """
    now = versioned.manifest(spark, path)
    if now is None:
        return 0
    old = [day for day in now["folders"] if day != versioned.NULL_FOLDER and day < cutoff]
    if not old:
        return 0
    if keep_hosts is None:
        versioned.drop_partitions(spark, path, now, old)
        return len(old)
    stale = versioned.frame_of(spark, path, now).where(F.col(partition) < F.lit(cutoff).cast("date"))
    saved = cut_lineage(lookups.protected_hosts(stale, keep_hosts))
    kept = {str(r[0]) for r in saved.select(partition).distinct().collect()}  # one row per day
    if kept:
        versioned.replace_partitions(saved, path, partition, now, drop=old)
    else:
        versioned.drop_partitions(spark, path, now, old)
    return len(set(old) - kept)


PROGRESS = "query STRING, run STRING, state STRING, at STRING, batch_id BIGINT, input_rows BIGINT, max_event_time STRING"


class ProgressLog(StreamingQueryListener):
    """Attempts, states and figures of every query, until they are stored in a progress table."""

    def __init__(self) -> None:
        self.rows: list[tuple] = []

    def onQueryStarted(self, event) -> None:
        self.rows.append((str(event.id), str(event.runId), "started", event.timestamp, None, None, None))

    def onQueryProgress(self, event) -> None:
        p = event.progress
        self.rows.append((str(p.id), str(p.runId), "progress", p.timestamp, p.batchId, p.numInputRows, p.eventTime.get("max")))

    def onQueryIdle(self, event) -> None:
        self.rows.append((str(event.id), str(event.runId), "idle", event.timestamp, None, None, None))

    def onQueryTerminated(self, event) -> None:
        self.rows.append((str(event.id), str(event.runId), "failed" if event.exception else "finished", None, None, None, None))

    def ended(self, query: StreamingQuery) -> bool:
        """Whether the end of the query's present run was reported; that comes after the end itself."""
        return any(r[1] == str(query.runId) and r[2] in ("finished", "failed") for r in self.rows)

    def table(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame(self.rows, PROGRESS)

    def store(self, spark: SparkSession, path: str) -> int:
        """Append what came since the last call to the progress table, and forget it.

        Jobs call it now and then and at their end. Rows are appended, never changed, and a row
        that is appended twice counts once when it is read.
        """
        new = list(self.rows)
        if new:
            spark.createDataFrame(new, PROGRESS).coalesce(1).write.mode("append").parquet(path)
            del self.rows[: len(new)]
        return len(new)


def stored_progress(spark: SparkSession, path: str) -> DataFrame:
    """One row per query and batch: a query keeps its id over restarts from its checkpoint, and a batch
    that a later run had to repeat counts as that run saw it."""
    done = spark.read.schema(PROGRESS).parquet(path).where("state = 'progress'")
    return store.dedupe_latest(done, ["query", "batch_id"], "at")


def run_progress(spark: SparkSession, log: ProgressLog, query: StreamingQuery) -> DataFrame:
    """Every progress event of one query, from a listener that was added before it started."""
    return log.table(spark).where((F.col("query") == str(query.id)) & (F.col("state") == "progress"))
