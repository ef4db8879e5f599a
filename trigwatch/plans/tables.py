"""Telemetry, catalogue, windows, scores and vectors as projections of the test tables.

Each has a Spark form and the same definition as SQL (``CTES``), so a query and its oracle
start from the same rows.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trigwatch.functions import timing
from trigwatch.session import ensure_checkpoint_dir

# Arguments of the operators under test: name prefix, keyword, marker and family patterns.
PREFIX, KEYWORD, MARKER = "ORB_", "Beacon", "ORB_NightShift"
FAMILY_PATTERNS = ((r"^ORB_700\d{2}", "ORB_700xx"), (r"^ORB_7\d{2}", "ORB_7xx"))

PLAIN = "yyyy-MM-dd HH:mm:ss"


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared scratch folder."""
    return f"{ensure_checkpoint_dir(spark)}/{name}-{uuid.uuid4().hex}"


def telemetry(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "events").select(
        "event_id",
        "user_id",
        "event_type",
        "value",
        F.concat(F.lit("host-"), (F.col("user_id") % 5).cast("string")).alias("hostname"),
        F.concat(
            F.lit("10.0."), (F.col("user_id") % 5).cast("string"), F.lit("."), (F.col("event_id") % 3).cast("string")
        ).alias("source_ip"),
        (100000 + F.get_json_object("props", "$.k").cast("bigint") % 20).alias("rule_id"),
        F.col("ts").cast("timestamp_ntz").alias("timestamp"),
        F.floor("value").cast("bigint").alias("count"),
        F.when(F.col("event_type") == "error", "attack").otherwise("normal").alias("source_label"),
    )


def windowed(events: DataFrame, size: int, keys: list[str], *sums) -> DataFrame:
    """Aggregates per clock window; the id is formatted per group."""
    grouped = events.groupBy(timing.window_start(F.col("timestamp"), size).alias("_start"), *keys).agg(*sums)
    return grouped.withColumn("window_id", timing.window_id(F.col("_start"), size)).drop("_start")


def catalog(spark: SparkSession, sf: str) -> DataFrame:
    """The ``part`` table as rule catalogue; ids ending in 19 (mod 20) stay unknown."""
    k = F.col("p_partkey") % 20
    key = F.lpad((F.col("p_partkey") % 100).cast("string"), 2, "0")
    name = (
        F.when(k < 5, F.concat(F.lit("ORB_7"), key, F.lit(" "), "p_name"))
        .when(k < 7, F.concat(F.lit("ORB_700"), key, F.lit(" "), "p_name"))
        .when(k < 9, F.concat(F.lit("Beacon "), "p_name"))
        .when(k == 9, F.concat(F.lit("ORB_709 "), "p_name", F.lit(" Beacon")))
        .when(k == 10, F.concat(F.lit("ORB_NightShift "), "p_name"))
        .otherwise(F.col("p_name"))
    )
    return (
        table(spark, sf, "part")
        .where(k != 19)
        .select(
            (100000 + F.col("p_partkey")).alias("rule_id"), name.alias("name"), F.col("p_type").alias("type"),
            (F.col("p_size") % 2 == 0).alias("enabled"), F.col("p_brand").alias("origin"),
        )
    )


def id_map(spark: SparkSession, sf: str) -> DataFrame:
    """Translations ``200000 + key -> 100000 + key`` for even part keys."""
    return (
        table(spark, sf, "part")
        .where(F.col("p_partkey") % 2 == 0)
        .select(
            (200000 + F.col("p_partkey")).alias("uat_rule_id"),
            (100000 + F.col("p_partkey")).alias("prod_rule_id"),
            F.concat(F.lit("prod "), "p_name").alias("rule_name"),
        )
    )


def scores(spark: SparkSession, sf: str) -> DataFrame:
    """Score table with ties: truth is an error event, the score steps by 0.01."""
    return table(spark, sf, "events").select(
        "event_id",
        (F.col("event_type") == "error").cast("int").alias("label"),
        (F.floor(F.col("value") / 5).cast("double") / 100).alias("score"),
    )


def predictions(spark: SparkSession, sf: str) -> DataFrame:
    return scores(spark, sf).withColumn("prediction", (F.col("score") > 0.1).cast("int"))


def stored_windows(spark: SparkSession, sf: str) -> DataFrame:
    """Window table at six hours per host, some of it labelled."""
    t = telemetry(spark, sf).withColumn("window_start", timing.window_start(F.col("timestamp"), 360))
    grouped = t.groupBy("window_start", "hostname").agg(
        F.sum("count").alias("total_events"), F.count_if(F.col("event_type") == "error").alias("errors"), F.max("value").alias("top")
    )
    label = F.when(F.col("total_events") % 3 == 0, None).when(F.col("errors") > 0, 1).otherwise(0)
    return grouped.select(
        F.concat(F.date_format("window_start", timing.WINDOW_ID_FORMAT), F.lit("_W"), (F.hour("window_start") / 6).cast("int").cast("string")).alias("window_id"),
        "hostname",
        "window_start",
        (F.col("window_start") + F.make_dt_interval(hours=F.lit(6))).alias("window_end"),
        "total_events",
        label.alias("label"),
        "top",
    )


def stored_results(spark: SparkSession, sf: str) -> DataFrame:
    confidence = F.floor(F.col("top") / 5).cast("double") / 100
    return stored_windows(spark, sf).select(
        "window_id",
        "hostname",
        (confidence > 0.3).cast("int").alias("predicted_label"),
        confidence.alias("confidence"),
        (F.col("window_start") + F.make_dt_interval(hours=F.lit(1))).alias("prediction_time"),
    )


def embeddings(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "embeddings").select(
        "vec_id", F.col("label").cast("bigint").alias("cluster"), F.col("embedding").cast("array<double>").alias("features")
    )


def embeddings_long(spark: SparkSession, sf: str) -> DataFrame:
    return embeddings(spark, sf).select("vec_id", "cluster", F.posexplode("features").alias("feature_idx", "value"))


def texts(df: DataFrame, *columns: str) -> DataFrame:
    """Times as text, the form in which results are compared."""
    return df.withColumns({c: F.date_format(c, PLAIN) for c in columns})


def rounded(df: DataFrame, *columns: str, places: int = 6) -> DataFrame:
    # adding 0.0 turns a negative zero into zero
    return df.withColumns({c: F.round(F.col(c), places) + F.lit(0.0) for c in columns})


# --- the same definitions as SQL -----------------------------------------------------------


def minute_of(ts: str) -> str:
    return f"(extract('hour' FROM {ts}) * 60 + extract('minute' FROM {ts}))"


def wnum(ts: str, size: int) -> str:
    return f"({minute_of(ts)} // {size})"


def wstart(ts: str, size: int) -> str:
    return f"(date_trunc('day', {ts}) + to_minutes(CAST({wnum(ts, size)} * {size} AS BIGINT)))"


def wend(ts: str, size: int) -> str:
    return f"(date_trunc('day', {ts}) + to_minutes(CAST(({wnum(ts, size)} + 1) * {size} AS BIGINT)))"


def wid(ts: str, size: int) -> str:
    return f"(strftime({wstart(ts, size)}, '%Y-%m-%d_%H-%M-%S') || '_W' || CAST({wnum(ts, size)} AS VARCHAR))"


def hstart(ts: str, size: int) -> str:
    return f"(date_trunc('hour', {ts}) + to_minutes(CAST((extract('minute' FROM {ts}) // {size}) * {size} AS BIGINT)))"


def plain(ts: str) -> str:
    return f"strftime({ts}, '%Y-%m-%d %H:%M:%S')"


def siem(ts: str) -> str:
    return f"strftime({ts}, '%b %-d, %Y, %-I:%M:%S %p')"


CTES = {
    "tele": """
SELECT event_id, user_id, event_type, value, 'host-' || CAST(user_id % 5 AS VARCHAR) AS hostname,
  '10.0.' || CAST(user_id % 5 AS VARCHAR) || '.' || CAST(event_id % 3 AS VARCHAR) AS source_ip,
  100000 + CAST(json_extract_string(props, '$.k') AS BIGINT) % 20 AS rule_id, ts,
  CAST(floor(value) AS BIGINT) AS cnt,
  CASE WHEN event_type = 'error' THEN 'attack' ELSE 'normal' END AS source_label
FROM events""",
    "cat": """
SELECT 100000 + p_partkey AS rule_id,
  CASE WHEN p_partkey % 20 < 5 THEN 'ORB_7' || lpad(CAST(p_partkey % 100 AS VARCHAR), 2, '0') || ' ' || p_name
       WHEN p_partkey % 20 < 7 THEN 'ORB_700' || lpad(CAST(p_partkey % 100 AS VARCHAR), 2, '0') || ' ' || p_name
       WHEN p_partkey % 20 < 9 THEN 'Beacon ' || p_name
       WHEN p_partkey % 20 = 9 THEN 'ORB_709 ' || p_name || ' Beacon'
       WHEN p_partkey % 20 = 10 THEN 'ORB_NightShift ' || p_name
       ELSE p_name END AS name,
  p_type AS type, p_size % 2 = 0 AS enabled, p_brand AS origin
FROM part WHERE p_partkey % 20 <> 19""",
    "fam": """
SELECT rule_id, name, CASE WHEN regexp_matches(name, '^ORB_700[0-9]{2}') THEN 'ORB_700xx'
  WHEN regexp_matches(name, '^ORB_7[0-9]{2}') THEN 'ORB_7xx' ELSE 'Uncategorized' END AS family
FROM cat""",
    "idmap": """
SELECT 200000 + p_partkey AS uat_rule_id, 100000 + p_partkey AS prod_rule_id, 'prod ' || p_name AS rule_name
FROM part WHERE p_partkey % 2 = 0""",
    "scores": """
SELECT event_id, CASE WHEN event_type = 'error' THEN 1 ELSE 0 END AS label, floor(value / 5) / 100 AS score FROM events""",
    "pts": """
SELECT score, pos, neg, sum(pos) OVER (ORDER BY score DESC) AS tp, sum(neg) OVER (ORDER BY score DESC) AS fp,
  row_number() OVER (ORDER BY score DESC) AS place, sum(pos) OVER () AS p, sum(neg) OVER () AS n
FROM (SELECT score, sum(label) AS pos, sum(1 - label) AS neg FROM scores GROUP BY score)""",
    "windows": f"""
SELECT {wid('w', 360)} AS window_id, hostname, w AS window_start, w + INTERVAL 6 HOUR AS window_end, total_events,
  CASE WHEN total_events % 3 = 0 THEN NULL WHEN errors > 0 THEN 1 ELSE 0 END AS label, top
FROM (SELECT {wstart('ts', 360)} AS w, hostname, CAST(sum(cnt) AS BIGINT) AS total_events,
        sum(CASE WHEN event_type = 'error' THEN 1 ELSE 0 END) AS errors, max(value) AS top
      FROM tele GROUP BY ALL)""",
    "results": """
SELECT window_id, hostname, CASE WHEN floor(top / 5) / 100 > 0.3 THEN 1 ELSE 0 END AS predicted_label,
  floor(top / 5) / 100 AS confidence, window_start + INTERVAL 1 HOUR AS prediction_time
FROM windows""",
    "emb": """
SELECT vec_id, CAST(label AS BIGINT) AS cluster, CAST(unnest(embedding) AS DOUBLE) AS x,
  generate_subscripts(embedding, 1) - 1 AS pos FROM embeddings""",
}

NEEDS = {"fam": ("cat",), "pts": ("scores",), "windows": ("tele",), "results": ("tele", "windows")}


def with_ctes(names: str, body: str) -> str:
    """``WITH`` clause of the named definitions and what they need, before a query body."""
    wanted: list[str] = []
    for name in names.split():
        for one in (*NEEDS.get(name, ()), name):
            if one not in wanted:
                wanted.append(one)
    clause = ",\n".join(f"{n} AS ({CTES[n].strip()})" for n in wanted)
    body = body.strip()
    if body.upper().startswith("WITH RECURSIVE "):
        return f"WITH RECURSIVE {clause},\n{body[len('WITH RECURSIVE '):]}"
    if body.upper().startswith("WITH "):
        return f"WITH {clause},\n{body[5:]}"
    return f"WITH {clause}\n{body}"
