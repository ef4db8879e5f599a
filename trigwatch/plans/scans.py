"""Sources: files, documents, catalogue, jobs."""

from __future__ import annotations

from pyspark.sql import functions as F

from trigwatch.functions import nested, timing
from trigwatch.operators import aggregates as agg
from trigwatch.plans.registry import query
from trigwatch.plans.tables import (
    catalog, hstart, id_map, plain, scratch, siem, table, telemetry, texts, wid, with_ctes,
)
from trigwatch.session import settled
from trigwatch.sources import catalog as cat
from trigwatch.sources import documents as docs
from trigwatch.sources import jobs, triggers

#: events of one search answer, about
ANSWER_EVENTS = 5000


def _write_trigger_files(spark, sf, path):
    """The telemetry in the layout of exported trigger files, one folder per host."""
    t = telemetry(spark, sf).select(
        F.when(F.col("event_id") % 11 == 0, "N/A").otherwise(F.col("hostname")).alias("sysmon_hostname (custom)"),
        F.col("rule_id").cast("string").alias("Custom Rule"),
        timing.format_siem_ts(F.col("timestamp")).alias("Log Source Time (Minimum)"),
        F.format_number(F.col("count") * 1000, 0).alias("Count"),
        F.col("hostname").alias("folder"),
    )
    t.write.partitionBy("folder").option("header", "true").csv(path)


@query(
    "scan_trigger_csv",
    with_ctes("tele", f"""
SELECT hostname, rule_id, {siem('ts')} AS time_text, CAST(sum(cnt * 1000) AS BIGINT) AS total, count(*) AS n
FROM tele WHERE event_id % 11 <> 0 GROUP BY ALL"""),
)
def scan_trigger_csv(spark, sf):
    path = scratch(spark, "triggers")
    _write_trigger_files(spark, sf, path)
    read = triggers.scan_trigger_csv(spark, path, "normal")
    return read.groupBy("hostname", "rule_id", timing.format_siem_ts(F.col("timestamp")).alias("time_text")).agg(
        F.sum("count").alias("total"), F.count(F.lit(1)).alias("n")
    )


@query(
    "scan_labelled",
    with_ctes("tele", """
SELECT source_label, hostname, count(*) AS n, CAST(sum(cnt) AS BIGINT) AS total FROM tele GROUP BY ALL"""),
)
def scan_labelled(spark, sf):
    t = telemetry(spark, sf)
    both = triggers.scan_labelled(t.where("event_type <> 'error'"), t.where("event_type = 'error'"))
    return both.groupBy("source_label", "hostname").agg(F.count(F.lit(1)).alias("n"), F.sum("count").alias("total"))


@query(
    "quarantine_files",
    with_ctes("tele", """
SELECT event_id, user_id, rule_id FROM tele
WHERE user_id NOT IN (SELECT user_id FROM tele WHERE event_id % 97 = 0)"""),
)
def quarantine_files(spark, sf):
    t = telemetry(spark, sf).withColumn(
        "time_text", F.when(F.col("event_id") % 97 == 0, "no time").otherwise(timing.format_siem_ts(F.col("timestamp")))
    )
    bad = timing.parse_siem_ts(F.col("time_text")).isNull()
    return triggers.quarantine_files(t, "user_id", bad).select("event_id", "user_id", "rule_id")


@query(
    "window_id_from_file",
    """SELECT page_id, regexp_replace(regexp_extract(url || '/a' || CAST(page_id AS VARCHAR) || '.csv', '[^/]*$'), '[.][^.]*$', '') AS window_id
FROM pages""",
)
def window_id_from_file(spark, sf):
    path = F.concat("url", F.lit("/a"), F.col("page_id").cast("string"), F.lit(".csv"))
    return table(spark, sf, "pages").select("page_id", triggers.window_id_from_file(path).alias("window_id"))


@query(
    "path_has_segment",
    """SELECT page_id, CASE WHEN list_contains(string_split(url, '/'), 'en') THEN 1 ELSE 0 END AS inside FROM pages""",
)
def path_has_segment(spark, sf):
    return table(spark, sf, "pages").select("page_id", triggers.path_has_segment(F.col("url"), "en").cast("int").alias("inside"))


def window_docs(spark, sf, size=60):
    """Window documents of the whole telemetry, as parsed back from their JSON text."""
    ingested = agg.ingest_windows(telemetry(spark, sf), size)
    return docs.parse_window_docs(agg.documents_json(agg.window_documents(ingested, size)))


MAJORITY = f"""
per_ip AS (SELECT {hstart('ts', 60)} AS w, hostname, source_ip, sum(cnt) AS ip_total FROM tele GROUP BY ALL),
maj AS (SELECT w, hostname, source_ip, total FROM (
  SELECT w, hostname, source_ip, sum(ip_total) OVER (PARTITION BY w, hostname) AS total,
    row_number() OVER (PARTITION BY w, hostname ORDER BY ip_total DESC, source_ip) AS rn FROM per_ip) WHERE rn = 1)"""


@query(
    "scan_window_docs",
    with_ctes("tele", f"""
WITH {MAJORITY},
hr AS (SELECT {hstart('ts', 60)} AS w, hostname, rule_id, sum(cnt) AS cnt FROM tele GROUP BY ALL)
SELECT strftime(w, '%Y-%m-%d_%H-%M-%S') AS window_id, {plain('w')} AS window_start, hostname, source_ip, rule_id, CAST(cnt AS BIGINT) AS count
FROM hr JOIN maj USING (w, hostname) WHERE cnt > 0"""),
)
def scan_window_docs(spark, sf):
    return texts(docs.scan_window_docs(window_docs(spark, sf)), "window_start")


@query(
    "first_nonempty_map",
    with_ctes("tele", """
SELECT 'd' || CAST(event_id AS VARCHAR) AS window_id, 'global' AS hostname, '0.0.0.0' AS source_ip,
  CASE WHEN event_id % 3 = 0 THEN rule_id WHEN event_id % 3 = 1 THEN rule_id + 1 ELSE rule_id + 2 END AS rule_id, cnt AS count
FROM tele WHERE cnt > 0"""),
)
def first_nonempty_map(spark, sf):
    t = telemetry(spark, sf)
    name = F.col("rule_id").cast("string")
    empty = F.create_map().cast("map<string,bigint>")
    flat = t.select(
        F.concat(F.lit("d"), F.col("event_id").cast("string")).alias("_id"),
        F.col("timestamp").alias("window_start"),
        F.lit(None).cast("string").alias("hostname"),
        F.lit("").alias("source_ip"),
        F.when(F.col("event_id") % 3 == 0, F.create_map(name, "count")).otherwise(empty).alias("rule_counts"),
        F.when(F.col("event_id") % 3 == 1, F.create_map((F.col("rule_id") + 1).cast("string"), "count")).alias("features"),
        F.create_map((F.col("rule_id") + 2).cast("string"), "count").alias("feature_vector"),
    )
    return docs.scan_flat_docs(flat).select("window_id", "hostname", "source_ip", "rule_id", "count")


@query(
    "scan_search_json",
    with_ctes("tele", f"""
SELECT event_id, hostname, CASE WHEN event_id % 4 = 0 THEN NULL ELSE source_ip END AS source_ip, rule_id, {plain('ts')} AS event_time, cnt AS count FROM tele
UNION ALL
SELECT event_id, 'global', '9.9.9.9', 0, {plain('ts')}, 0 FROM tele"""),
)
def scan_search_json(spark, sf):
    t = telemetry(spark, sf)
    text = timing.format_siem_ts(F.col("timestamp"))
    full = F.struct(
        F.col("hostname").alias("sysmon_hostname (custom)"),
        F.when(F.col("event_id") % 4 == 0, "N/A").otherwise(F.col("source_ip")).alias("Source IP"),
        F.lit(None).cast("string").alias("src_ip"),
        F.col("rule_id").alias("Custom Rule"),
        text.alias("Log Source Time (Minimum)"),
        F.col("count").alias("Count"),
    )
    bare = F.struct(
        F.lit(None).cast("string").alias("sysmon_hostname (custom)"),
        F.lit(None).cast("string").alias("Source IP"),
        F.lit("9.9.9.9").alias("src_ip"),
        F.lit(None).cast("bigint").alias("Custom Rule"),
        text.alias("Log Source Time (Minimum)"),
        F.lit(None).cast("bigint").alias("Count"),
    )
    answers = t.select("event_id", F.to_json(F.struct(F.array(full, bare).alias("events"))).alias("answer"))
    return docs.parse_search_json(answers, "answer", keep=["event_id"]).select(
        "event_id", "hostname", "source_ip", "rule_id",
        F.date_format(timing.parse_ts_any(F.col("time_text")), "yyyy-MM-dd HH:mm:ss").alias("event_time"), "count",
    )


@query(
    "search_events_to_windows",
    with_ctes("tele", f"""
SELECT strftime({hstart("(date_trunc('second', ts) + INTERVAL 45 SECOND)", 15)}, '%Y-%m-%d_%H-%M-%S') AS window_id,
  hostname, rule_id, CAST(sum(cnt) AS BIGINT) AS count
FROM tele WHERE event_id % 4 <> 0 GROUP BY ALL"""),
)
def search_events_to_windows(spark, sf):
    t = telemetry(spark, sf)
    entry = F.struct(
        F.col("hostname").alias("sysmon_hostname (custom)"),
        F.when(F.col("event_id") % 4 == 0, "null").otherwise(F.col("source_ip")).alias("Source IP"),
        F.col("rule_id").alias("Custom Rule"),
        timing.format_siem_ts(F.col("timestamp")).alias("Log Source Time (Minimum)"),
        F.col("count").alias("Count"),
    )
    answers = t.select(F.to_json(F.struct(F.array(entry).alias("events"))).alias("answer"))
    events = docs.search_events(docs.parse_search_json(answers, "answer"), offset_seconds=45)
    return agg.named(agg.host_rule_counts(agg.ingest_windows(events, 15))).select("window_id", "hostname", "rule_id", "count")


@query(
    "scan_any_docs",
    with_ctes("tele", f"""
WITH {MAJORITY},
hr AS (SELECT {hstart('ts', 60)} AS w, hostname, rule_id, sum(cnt) AS cnt FROM tele GROUP BY ALL)
SELECT strftime(w, '%Y-%m-%d_%H-%M-%S') AS window_id, hostname, source_ip, rule_id, CAST(cnt AS BIGINT) AS count FROM hr JOIN maj USING (w, hostname) WHERE cnt > 0
UNION ALL SELECT 'd' || CAST(event_id AS VARCHAR), 'global', '0.0.0.0', CASE WHEN event_id % 2 = 0 THEN rule_id ELSE rule_id + 1 END, cnt FROM tele WHERE cnt > 0"""),
)
def scan_any_docs(spark, sf):
    name = F.col("rule_id").cast("string")
    flat = telemetry(spark, sf).select(
        F.concat(F.lit("d"), F.col("event_id").cast("string")).alias("_id"), F.col("timestamp").alias("window_start"),
        F.when(F.col("event_id") % 2 == 0, F.create_map(name, "count")).alias("rule_counts"),
        F.create_map((F.col("rule_id") + 1).cast("string"), "count").alias("features"),
    )
    mixed = window_docs(spark, sf).withColumns({"hostname": F.lit(None).cast("string"), "source_ip": F.lit(None).cast("string")})
    return docs.scan_any_docs(mixed.unionByName(flat, allowMissingColumns=True)).select("window_id", "hostname", "source_ip", "rule_id", "count")


@query(
    "scan_search_files",
    with_ctes("tele", "SELECT hostname, source_ip, rule_id, CAST(sum(cnt) AS BIGINT) AS total, count(*) AS n FROM tele GROUP BY ALL"),
)
def scan_search_files(spark, sf):
    # answers per host and day, each a file of several lines: a search answers in pages of about ANSWER_EVENTS
    path = scratch(spark, "answers")
    entry = F.struct(
        F.col("hostname").alias("sysmon_hostname (custom)"), F.col("source_ip").alias("Source IP"), F.col("rule_id").alias("Custom Rule"),
        timing.format_siem_ts(F.col("timestamp")).alias("Log Source Time (Minimum)"), F.col("count").alias("Count"),
    )
    events, day = telemetry(spark, sf), F.to_date("timestamp")
    pages = events.groupBy(F.col("hostname").alias("of_host"), day.alias("of_day")).agg(F.ceil(F.count(F.lit(1)) / ANSWER_EVENTS).alias("pages"))
    paged = events.withColumn("day", day).join(
        settled(pages), F.col("hostname").eqNullSafe(F.col("of_host")) & F.col("day").eqNullSafe(F.col("of_day"))
    )
    answers = paged.groupBy("hostname", "day", F.pmod(F.xxhash64("event_id", "timestamp", "value"), F.col("pages"))).agg(F.collect_list(entry).alias("events"))
    answers.select(F.to_json(F.struct("events"), {"pretty": "true"})).write.option("maxRecordsPerFile", 1).text(path)
    read = docs.scan_search_files(spark, path)
    return read.groupBy("hostname", "source_ip", "rule_id").agg(F.sum("count").alias("total"), F.count(F.lit(1)).alias("n"))


@query("scan_catalog", with_ctes("cat", "SELECT rule_id, name, type, CASE WHEN enabled THEN 1 ELSE 0 END AS enabled, origin FROM cat"))
def scan_catalog(spark, sf):
    path = scratch(spark, "catalog")
    good = catalog(spark, sf)
    as_text = good.select(
        F.concat(F.col("rule_id").cast("string"), F.when(F.col("rule_id") % 3 == 0, ".0").otherwise("")).alias("id"),
        "name", "type", F.when(F.col("enabled"), "TRUE").otherwise("False").alias("enabled"), "origin",
    )
    broken = good.where("rule_id % 7 = 0").select(F.lit("none").alias("id"), "name", "type", F.lit("True").alias("enabled"), "origin")
    as_text.unionByName(broken).write.option("header", "true").csv(path)
    return cat.scan_catalog(spark, path).withColumn("enabled", F.col("enabled").cast("int"))


@query(
    "save_catalog",
    with_ctes("cat", "SELECT rule_id, name, row_number() OVER (ORDER BY rule_id) - 1 AS feature_idx FROM cat"),
)
def save_catalog(spark, sf):
    from trigwatch.operators.store import save_table
    from trigwatch.operators.vectors import rule_index

    path = scratch(spark, "catalog-table")
    rules = catalog(spark, sf)
    save_table(rules.join(rule_index(rules), "rule_id"), path)
    return spark.read.parquet(path).select("rule_id", "name", F.col("feature_idx").cast("bigint").alias("feature_idx"))


@query("scan_id_map", with_ctes("idmap", "SELECT uat_rule_id, prod_rule_id, rule_name FROM idmap"))
def scan_id_map(spark, sf):
    good = id_map(spark, sf).select(F.concat(F.lit(" "), F.col("uat_rule_id").cast("string")).alias("uat_rule_id"), F.col("prod_rule_id").cast("string"), "rule_name")
    bad = good.select("uat_rule_id", F.lit("n/a").alias("prod_rule_id"), "rule_name")
    path = scratch(spark, "id-map")
    good.unionByName(bad).write.option("header", "true").option("ignoreLeadingWhiteSpace", "false").csv(path)
    return cat.scan_id_map(spark, path)


@query(
    "scan_family_overrides",
    "SELECT 100000 + p_partkey AS rule_id, p_brand AS family FROM part",
)
def scan_family_overrides(spark, sf):
    # an override file per brand: its entries and a note
    path = scratch(spark, "overrides")
    entries = F.collect_list(F.struct((100000 + F.col("p_partkey")).cast("string"), F.col("p_brand")))
    files = table(spark, sf, "part").groupBy("p_brand").agg(F.map_concat(F.map_from_entries(entries), F.create_map(F.lit("comment"), F.lit("a note"))).alias("family_mapping"))
    files.select(F.to_json(F.struct("family_mapping"), {"pretty": "true"})).write.option("maxRecordsPerFile", 1).text(path)
    return cat.scan_family_overrides(spark, path)


@query(
    "rule_names",
    with_ctes("cat idmap", """
SELECT rule_id, arg_min(name, pr) AS rule_name FROM (
  SELECT prod_rule_id AS rule_id, rule_name AS name, 0 AS pr FROM idmap
  UNION ALL SELECT rule_id, trim(name), 1 FROM cat
  UNION ALL SELECT 100000 + p_partkey, p_type, 2 FROM part) GROUP BY rule_id"""),
)
def rule_names(spark, sf):
    return cat.rule_names(
        id_map(spark, sf).select(F.col("prod_rule_id").alias("rule_id"), "rule_name"),
        catalog(spark, sf).select("rule_id", F.col("name").alias("rule_name")),
        table(spark, sf, "part").select((100000 + F.col("p_partkey")).alias("rule_id"), F.col("p_type").alias("rule_name")),
    )


@query(
    "first_seen",
    with_ctes("tele", "SELECT user_id, arg_min(event_type, event_id) AS event_type FROM tele GROUP BY user_id"),
)
def first_seen(spark, sf):
    return cat.first_seen(telemetry(spark, sf), "user_id", "event_type", "event_id")


JOB_ROWS = """
raw AS (SELECT o_orderkey,
  CASE WHEN o_orderkey % 17 = 0 THEN '' ELSE 'host-' || CAST(o_custkey % 5 AS VARCHAR) END AS hostname,
  CASE WHEN o_orderkey % 19 = 0 THEN 'soon' WHEN o_orderkey % 13 = 0 THEN '' ELSE strftime(o_orderdate, '%Y-%m-%dT%H:%M:%S') END AS start_time,
  strftime(o_orderdate + to_days(CAST(o_orderkey % 5 - 1 AS INTEGER)), '%Y-%m-%dT%H:%M:%S') AS end_time,
  CASE WHEN o_orderkey % 23 = 0 THEN '' ELSE 'out/' || o_orderstatus END AS output_dir,
  CASE WHEN o_orderkey % 29 = 0 THEN 'half' WHEN o_orderkey % 2 = 0 THEN '30' ELSE '' END AS size FROM orders)"""


@query(
    "scan_jobs",
    f"""WITH {JOB_ROWS}
SELECT hostname, CASE WHEN start_time IN ('', 'soon') THEN NULL ELSE replace(start_time, 'T', ' ') END AS start_time,
  replace(end_time, 'T', ' ') AS end_time, output_dir,
  CAST(TRY_CAST(nullif(size, '') AS INTEGER) AS BIGINT) AS window_size_minutes,
  CASE WHEN hostname = '' THEN 'missing hostname' WHEN start_time = '' THEN 'missing time' WHEN output_dir = '' THEN 'missing output_dir'
    WHEN start_time = 'soon' THEN 'bad time' WHEN size = 'half' THEN 'bad window size'
    WHEN end_time <= start_time THEN 'end not after start' END AS error
FROM raw""",
)
def scan_jobs(spark, sf):
    key = F.col("o_orderkey")
    iso = "yyyy-MM-dd'T'HH:mm:ss"
    end = F.col("o_orderdate").cast("timestamp_ntz") + F.make_dt_interval(days=(key % 5 - 1).cast("int"))
    raw = table(spark, sf, "orders").select(
        F.when(key % 17 == 0, "").otherwise(F.concat(F.lit("host-"), (F.col("o_custkey") % 5).cast("string"))).alias("hostname"),
        F.when(key % 19 == 0, "soon").when(key % 13 == 0, "").otherwise(F.date_format("o_orderdate", iso)).alias("start_time"),
        F.date_format(end, iso).alias("end_time"),
        F.when(key % 23 == 0, "").otherwise(F.concat(F.lit("out/"), "o_orderstatus")).alias("output_dir"),
        F.lit("").alias("db_name"), F.lit("").alias("collection"), F.lit("").alias("source_schema"),
        F.when(key % 29 == 0, "half").when(key % 2 == 0, "30").otherwise("").alias("window_size_minutes"),
    )
    path = scratch(spark, "jobs")
    raw.write.option("header", "true").csv(path)
    checked = texts(jobs.scan_jobs(spark, path, on_error="keep"), "start_time", "end_time")
    return checked.select(
        "hostname", "start_time", "end_time", "output_dir", F.col("window_size_minutes").cast("bigint").alias("window_size_minutes"), "error"
    )


@query(
    "scan_feature_csv",
    """SELECT o_orderkey % 2 AS label, CAST(o_totalprice AS DOUBLE) AS price,
  CAST(CASE WHEN o_orderkey % 3 = 0 THEN 0 ELSE o_custkey END AS DOUBLE) AS customer, 0.0::DOUBLE AS priority FROM orders""",
)
def scan_feature_csv(spark, sf):
    path = scratch(spark, "features")
    table(spark, sf, "orders").select(
        F.lit("w").alias("window_id"),
        F.col("o_totalprice").alias("price"),
        F.when(F.col("o_orderkey") % 3 == 0, "none").otherwise(F.col("o_custkey").cast("string")).alias("customer"),
        F.col("o_orderpriority").alias("priority"),
        (F.col("o_orderkey") % 2).alias("label"),
    ).write.option("header", "true").csv(path)
    read = jobs.scan_feature_csv(spark.read.option("header", "true").csv(path))
    return read.withColumn("label", F.col("label").cast("bigint"))


AGG_SQL = with_ctes("tele", f"""
SELECT {wid('ts', 1440)} AS window_id, hostname, source_label, source_ip, CAST(sum(cnt) AS BIGINT) AS total_events,
  count(DISTINCT rule_id) AS unique_rules, {plain('min(ts)')} AS window_start, {plain('max(ts)')} AS window_end,
  min(rule_id) AS first_rule
FROM tele GROUP BY ALL""")


@query("load_aggregates", AGG_SQL)
def load_aggregates(spark, sf):
    path = scratch(spark, "windows")
    jobs.save_aggregates(agg.aggregate_windows(telemetry(spark, sf), 1440), path)
    back = jobs.load_aggregates(spark, path)
    return texts(back, "window_start", "window_end").select(
        "window_id", "hostname", "source_label", "source_ip", "total_events", "unique_rules", "window_start", "window_end",
        F.array_min(F.map_keys("aggregated_rules")).cast("bigint").alias("first_rule"),
    )


@query(
    "save_aggregates",
    with_ctes("tele", f"""
SELECT {wid('ts', 1440)} AS window_id, hostname, source_label, source_ip, rule_id, CAST(sum(cnt) AS BIGINT) AS total FROM tele GROUP BY ALL"""),
)
def save_aggregates(spark, sf):
    path = scratch(spark, "windows")
    jobs.save_aggregates(agg.aggregate_windows(telemetry(spark, sf), 1440), path)
    raw = spark.read.option("header", "true").option("escape", '"').csv(path)
    return raw.select(
        "window_id", "hostname", "source_label", "source_ip",
        F.explode(F.from_json("aggregated_rules", "map<string,bigint>")).alias("rule_text", "total"),
    ).select("window_id", "hostname", "source_label", "source_ip", F.col("rule_text").cast("bigint").alias("rule_id"), "total")


@query(
    "unwrap_payload",
    with_ctes("tele", """
SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) + d AS k
FROM events, (SELECT unnest([0, 1]) AS d) WHERE d = 0 OR event_id % 3 = 1"""),
)
def unwrap_payload(spark, sf):
    k = F.get_json_object("props", "$.k").cast("bigint")
    one, two = F.to_json(F.struct(k.alias("k"))), F.to_json(F.struct((k + 1).alias("k")))
    document = (
        F.when(F.col("event_id") % 3 == 0, F.concat(F.lit('{"data":{"event":'), one, F.lit("}}")))
        .when(F.col("event_id") % 3 == 1, F.concat(F.lit('{"data":{"event":['), one, F.lit(",5,"), two, F.lit("]}}")))
        .otherwise(one)
    )
    docs_df = table(spark, sf, "events").select("event_id", document.alias("doc"))
    return docs.unwrap_payload(docs_df, "doc", "data.event").select(
        "event_id", nested.get_path(F.col("payload"), "k").cast("bigint").alias("k")
    )


@query(
    "window_rows_for_host",
    with_ctes("tele", f"""
SELECT strftime({hstart('ts', 60)}, '%Y-%m-%d_%H-%M-%S') AS window_id, {plain(hstart('ts', 60))} AS window_start, hostname, rule_id, CAST(sum(cnt) AS BIGINT) AS count
FROM tele WHERE hostname = 'host-3' GROUP BY ALL"""),
)
def window_rows_for_host(spark, sf):
    return texts(docs.window_rows_for_host(window_docs(spark, sf), "host-3"), "window_start").select(
        "window_id", "window_start", "hostname", "rule_id", "count"
    )


@query(
    "window_calendar",
    """SELECT strftime(s, '%Y-%m-%d %H:%M:%S') AS window_start, strftime(s + INTERVAL 30 MINUTE, '%Y-%m-%d %H:%M:%S') AS window_end
FROM (SELECT unnest(generate_series(date_trunc('day', min(ts)), date_trunc('day', max(ts)) + INTERVAL 1 DAY - INTERVAL 30 MINUTE, INTERVAL 30 MINUTE)) AS s FROM events)""",
)
def window_calendar(spark, sf):
    day = lambda c: F.to_date(c).cast("timestamp_ntz")
    bounds = table(spark, sf, "events").agg(
        day(F.min("ts")).alias("start"), (day(F.max("ts")) + F.make_dt_interval(days=F.lit(1))).alias("end")
    )
    return texts(jobs.window_calendar(bounds, 30), "window_start", "window_end")


@query(
    "discover_features",
    with_ctes("tele cat", "SELECT rule_id FROM tele UNION SELECT rule_id FROM cat UNION SELECT 300000 + s_suppkey FROM supplier"),
)
def discover_features(spark, sf):
    return cat.discover_features(
        telemetry(spark, sf), catalog(spark, sf), table(spark, sf, "supplier").select((300000 + F.col("s_suppkey")).alias("rule_id"))
    )
