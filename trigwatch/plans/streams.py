"""Streaming jobs, drained once over the whole event table; the end state equals the batch result."""

from __future__ import annotations

import time

from pyspark.sql import functions as F

from trigwatch.functions import timing
from trigwatch.operators import lookups, store
from trigwatch.plans.registry import query
from trigwatch.plans.tables import plain, rounded, scratch, table, texts, wid, with_ctes, wstart
from trigwatch.streaming import windows as live


SLACK = "45 seconds"


def event_stream(spark, sf):
    """The event table as a file stream, projected like the telemetry."""
    schema = table(spark, sf, "events").schema
    return projected(spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf))


def projected(raw):
    return raw.select(
        "event_id", "event_type", "value",
        F.concat(F.lit("host-"), (F.col("user_id") % 5).cast("string")).alias("hostname"),
        (100000 + F.get_json_object("props", "$.k").cast("bigint") % 20).alias("rule_id"),
        F.col("ts").alias("timestamp"),
        F.floor("value").cast("bigint").alias("count"),
    )


def drained(query_handle):
    query_handle.awaitTermination()
    return query_handle


@query(
    "stream_trigger_windows",
    with_ctes("tele", f"""
SELECT {plain(wstart('ts', 60))} AS window_start, hostname, rule_id, CAST(sum(cnt) AS BIGINT) AS count, round(sum(ln(1 + cnt)), 6) AS log_count, count(*) AS n_rows
FROM tele GROUP BY 1, 2, 3"""),
)
def stream_trigger_windows(spark, sf):
    path, marks = scratch(spark, "stream-table"), scratch(spark, "stream-marks")
    counted = live.tumbling_counts(event_stream(spark, sf), 60, ["hostname", "rule_id"], SLACK)
    drained(live.stream_upsert(counted, path, marks, ["window_start", "hostname", "rule_id"]))
    return rounded(texts(store.read_table(spark, path), "window_start").select("window_start", "hostname", "rule_id", "count", "log_count", "n_rows"), "log_count")


@query(
    "stream_sliding_windows",
    with_ctes("tele", f"""
SELECT strftime(b - back, '%Y-%m-%d %H:%M:%S') AS window_start, hostname, CAST(sum(cnt) AS BIGINT) AS count FROM (
  SELECT {wstart('ts', 15)} AS b, hostname, cnt, unnest([INTERVAL 0 MINUTE, INTERVAL 15 MINUTE]) AS back FROM tele) GROUP BY 1, 2"""),
)
def stream_sliding_windows(spark, sf):
    path, marks = scratch(spark, "stream-table"), scratch(spark, "stream-marks")
    counted = live.sliding_counts(event_stream(spark, sf), "30 minutes", "15 minutes", ["hostname"], SLACK)
    drained(live.stream_upsert(counted, path, marks, ["window_start", "hostname"]))
    return texts(store.read_table(spark, path), "window_start").select("window_start", "hostname", "count")


@query(
    "stream_upsert",
    with_ctes("tele", f"""
SELECT {plain(wstart('ts', 1440))} AS window_start, hostname, CAST(sum(cnt) AS BIGINT) AS count FROM tele GROUP BY 1, 2"""),
)
def stream_upsert(spark, sf):
    # the drained stream is started again on the same marks and on fresh ones: neither changes the table
    path, marks = scratch(spark, "stream-table"), scratch(spark, "stream-marks")
    for place in (marks, marks, scratch(spark, "stream-marks")):
        counted = live.tumbling_counts(event_stream(spark, sf), 1440, ["hostname"], SLACK)
        drained(live.stream_upsert(counted, path, place, ["window_start", "hostname"]))
    return texts(store.read_table(spark, path), "window_start").select("window_start", "hostname", "count")


@query(
    "late_slack",
    with_ctes("tele", f"""
WITH s AS (SELECT {wstart("(ts + INTERVAL 5 SECOND)", 15)} AS late, ts, hostname, cnt, {wstart('ts', 15)} AS early FROM tele),
m AS (SELECT hostname, cnt, CASE WHEN ts - early <= INTERVAL 5 SECOND THEN early WHEN late > early THEN late
  WHEN (extract('minute' FROM ts) * 60 + extract('second' FROM ts)) % 900 < 450 THEN early ELSE early + INTERVAL 15 MINUTE END AS t FROM s)
SELECT {plain('t')} AS window_start, hostname, CAST(sum(cnt) AS BIGINT) AS count FROM m GROUP BY 1, 2"""),
)
def late_slack(spark, sf):
    path, marks = scratch(spark, "stream-table"), scratch(spark, "stream-marks")
    counted = live.tumbling_counts(live.snapped(event_stream(spark, sf), 15), 15, ["hostname"], SLACK)
    drained(live.stream_upsert(counted, path, marks, ["window_start", "hostname"]))
    return texts(store.read_table(spark, path), "window_start").select("window_start", "hostname", "count")


def window_score(windows):
    """A fixed score on window totals; jobs pass a fitted pipeline's transform instead."""
    chance = F.least(F.col("count") / 500, F.lit(1.0))
    return windows.withColumns(
        {
            "window_id": timing.window_id(F.col("window_start"), 360),
            "probability": chance,
            "predicted_label": (chance > 0.5).cast("int"),
        }
    )


@query(
    "incremental_detect",
    with_ctes("tele", f"""
WITH w AS (SELECT {wstart('ts', 360)} AS s, hostname, sum(cnt) AS c FROM tele GROUP BY 1, 2), closed AS (SELECT max(ts) - INTERVAL 45 SECOND AS mark FROM tele)
SELECT {wid('s', 360)} AS window_id, hostname, CASE WHEN least(c / 500, 1.0) > 0.5 THEN 1 ELSE 0 END AS predicted_label, least(c / 500, 1.0) AS confidence
FROM w, closed WHERE least(c / 500, 1.0) > 0.4 AND s + INTERVAL 6 HOUR <= mark"""),
)
def incremental_detect(spark, sf):
    path, marks = scratch(spark, "alerts-table"), scratch(spark, "stream-marks")
    counted = live.tumbling_counts(event_stream(spark, sf), 360, ["hostname"], SLACK)
    drained(live.incremental_detect(counted, window_score, 0.4, path, marks))
    return live.stored_alerts(spark, path).select("window_id", "hostname", "predicted_label", "confidence")


def second_score(windows):
    """A later model: other chances, for three of the five hosts only."""
    chance = F.least(F.col("count") / F.when(F.col("hostname") == "host-1", 250).otherwise(900), F.lit(1.0))
    return window_score(windows.where("hostname IN ('host-1', 'host-2', 'host-3')")).withColumns(
        {"probability": chance, "predicted_label": (chance > 0.5).cast("int")}
    )


@query(
    "incremental_rescored",
    with_ctes("tele", f"""
WITH w AS (SELECT {wstart('ts', 360)} AS s, hostname, sum(cnt) AS c FROM tele GROUP BY 1, 2), closed AS (SELECT max(ts) - INTERVAL 45 SECOND AS mark FROM tele),
scored AS (SELECT s, hostname, least(c / CASE WHEN hostname = 'host-1' THEN 250 WHEN hostname IN ('host-2', 'host-3') THEN 900 ELSE 500 END, 1.0) AS p
  FROM w, closed WHERE s + INTERVAL 6 HOUR <= mark)
SELECT {wid('s', 360)} AS window_id, hostname, CASE WHEN p > 0.5 THEN 1 ELSE 0 END AS predicted_label, p AS confidence FROM scored WHERE p > 0.4"""),
)
def incremental_rescored(spark, sf):
    # all windows are scored, then those of three hosts again: alerts change, come and go
    path = scratch(spark, "alerts-table")
    for score in (window_score, second_score):
        counted = live.tumbling_counts(event_stream(spark, sf), 360, ["hostname"], SLACK)
        drained(live.incremental_detect(counted, score, 0.4, path, scratch(spark, "stream-marks")))
    return live.stored_alerts(spark, path).select("window_id", "hostname", "predicted_label", "confidence")


@query(
    "stream_retention",
    with_ctes("tele", f"""
SELECT {plain(wstart('ts', 1440))} AS window_start, hostname, CAST(sum(cnt) AS BIGINT) AS count FROM tele
WHERE ts >= TIMESTAMP '2024-01-15' OR hostname = 'host-1' GROUP BY 1, 2"""),
)
def stream_retention(spark, sf):
    path, marks = scratch(spark, "stream-table"), scratch(spark, "stream-marks")
    counted = live.tumbling_counts(event_stream(spark, sf), 1440, ["hostname"], SLACK)
    drained(live.stream_upsert(counted, path, marks, ["window_start", "hostname"]))
    live.drop_expired_days(spark, path, "2024-01-15", lookups.host_list(spark, ["host-1"]))
    return texts(store.read_table(spark, path), "window_start").select("window_start", "hostname", "count")


@query(
    "stream_new_checkpoint",
    with_ctes("tele", f"""
SELECT {plain(wstart('ts', 1440))} AS window_start, hostname, CAST(sum(cnt) AS BIGINT) AS count FROM tele GROUP BY 1, 2"""),
)
def stream_new_checkpoint(spark, sf):
    # a first run stores half of the counts, over several batches; a second one, whose batches count from 0 again, corrects them
    arrivals, path = scratch(spark, "arrivals"), scratch(spark, "stream-table")
    raw = table(spark, sf, "events")
    raw.repartitionByRange(3, "ts").write.parquet(arrivals)
    halves = projected(spark.readStream.schema(raw.schema).option("maxFilesPerTrigger", 1).parquet(arrivals)).withColumn("count", F.col("count") - F.floor(F.col("count") / 2))
    for stream in (halves, event_stream(spark, sf)):
        counted = live.tumbling_counts(stream, 1440, ["hostname"], "60 days")
        drained(live.stream_upsert(counted, path, scratch(spark, "stream-marks"), ["window_start", "hostname"]))
    return texts(store.read_table(spark, path), "window_start").select("window_start", "hostname", "count")


@query(
    "stream_late_rows",
    with_ctes("tele", f"""
SELECT {plain(wstart('ts', 1440))} AS window_start, hostname, CAST(sum(cnt) AS BIGINT) AS count, count(*) AS n_rows FROM tele GROUP BY 1, 2"""),
)
def stream_late_rows(spark, sf):
    # the table arrives newest rows first, one file per batch, and the drained stream is started again
    arrivals, path, marks = (scratch(spark, name) for name in ("arrivals", "stream-table", "stream-marks"))
    raw = table(spark, sf, "events")
    raw.repartitionByRange(4, F.desc("ts")).sortWithinPartitions(F.desc("ts")).write.parquet(arrivals)
    for _ in range(2):
        source = spark.readStream.schema(raw.schema).option("maxFilesPerTrigger", 1).parquet(arrivals)
        drained(live.store_counts(projected(source), path, marks, 1440, ["hostname"]))
    return texts(live.stored_counts(spark, path, ["hostname"]), "window_start").select("window_start", "hostname", "count", "n_rows")


@query("run_progress", "SELECT count(*) AS input_rows FROM events")
def run_progress(spark, sf):
    """Input rows over the restarts of one job, from the stored progress."""
    arrivals, path, marks, kept = (scratch(spark, name) for name in ("arrivals", "stream-table", "stream-marks", "progress"))
    raw = table(spark, sf, "events")
    parts = raw.randomSplit([1.0, 1.0], 5)
    for part in parts:  # a second run takes up what has arrived since
        part.write.mode("append").parquet(arrivals)
        log = live.ProgressLog()
        spark.streams.addListener(log)
        try:
            source = projected(spark.readStream.schema(raw.schema).parquet(arrivals))
            done = drained(live.store_counts(source, path, marks, 1440, ["hostname"]))
            while not log.ended(done):
                time.sleep(0.05)
        finally:
            spark.streams.removeListener(log)
        log.store(spark, kept)
    return live.stored_progress(spark, kept).where(F.col("query") == str(done.id)).agg(F.sum("input_rows").alias("input_rows"))
