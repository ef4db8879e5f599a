"""Scalar functions, over every row of a table."""

from __future__ import annotations

from pyspark.sql import functions as F

from trigwatch.functions import cleaning, naming, nested, timing
from trigwatch.operators.filters import threshold_flag
from trigwatch.plans.registry import query
from trigwatch.plans.tables import (
    FAMILY_PATTERNS, KEYWORD, PREFIX, catalog, hstart, minute_of, plain, rounded, scores, siem, table, telemetry,
    texts, wend, wid, with_ctes, wnum, wstart,
)

TS_TEXT = f"CASE WHEN event_id % 7 = 0 THEN 'invalid-timestamp' WHEN event_id % 7 = 1 THEN '  ' || {siem('ts')} ELSE {siem('ts')} END"


def ts_text():
    text = timing.format_siem_ts(F.col("timestamp"))
    return (
        F.when(F.col("event_id") % 7 == 0, "invalid-timestamp")
        .when(F.col("event_id") % 7 == 1, F.concat(F.lit("  "), text))
        .otherwise(text)
    )


@query(
    "parse_siem_ts",
    with_ctes("tele", f"SELECT event_id, CASE WHEN event_id % 7 <> 0 THEN {plain('ts')} END AS parsed FROM tele"),
)
def parse_siem_ts(spark, sf):
    t = telemetry(spark, sf)
    return texts(t.select("event_id", timing.parse_siem_ts(ts_text()).alias("parsed")), "parsed")


@query(
    "parse_ts_any",
    with_ctes("tele", f"""
SELECT event_id, {plain("ts + INTERVAL 45 SECOND")} AS parsed, strftime(ts, '%Y-%m-%d %H:%M:%S.%f') AS iso FROM tele"""),
)
def parse_ts_any(spark, sf):
    t = telemetry(spark, sf)
    ingest = F.when(F.col("event_id") % 2 == 0, timing.format_siem_ts(F.col("timestamp"))).otherwise(
        F.date_format("timestamp", timing.PLAIN_FORMAT)
    )
    stored = (
        F.when(F.col("event_id") % 3 == 0, F.date_format("timestamp", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'"))
        .when(F.col("event_id") % 3 == 1, F.date_format("timestamp", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"))
        .otherwise(F.date_format("timestamp", "yyyy-MM-dd HH:mm:ss.SSSSSS"))
    )
    iso = timing.parse_ts_any(stored, timing.ISO_FORMATS)
    return t.select(
        "event_id",
        F.date_format(timing.parse_ts_any(ingest, offset_seconds=45), timing.PLAIN_FORMAT).alias("parsed"),
        F.date_format(iso, "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("iso"),
    )


@query("format_siem_ts", with_ctes("tele", f"SELECT event_id, {siem('ts')} AS time_text FROM tele"))
def format_siem_ts(spark, sf):
    return telemetry(spark, sf).select("event_id", timing.format_siem_ts(F.col("timestamp")).alias("time_text"))


@query("is_valid_ts", with_ctes("tele", "SELECT event_id, CASE WHEN event_id % 7 = 0 THEN 0 ELSE 1 END AS valid FROM tele"))
def is_valid_ts(spark, sf):
    return telemetry(spark, sf).select("event_id", timing.is_valid_ts(ts_text()).cast("int").alias("valid"))


@query(
    "to_zone",
    with_ctes("tele", f"""
SELECT event_id, {plain('ts + INTERVAL 8 HOUR')} AS hong_kong, {plain('ts')} AS unknown_zone, {plain('ts - INTERVAL 8 HOUR')} || ' UTC' AS from_hong_kong FROM tele"""),
)
def to_zone(spark, sf):
    ts = F.col("timestamp")
    out = telemetry(spark, sf).select(
        "event_id",
        timing.to_zone(ts, "Asia/Hong_Kong").alias("hong_kong"),
        timing.to_zone(ts, "Nowhere/None").alias("unknown_zone"),
        timing.format_utc(ts, "Asia/Hong_Kong").alias("from_hong_kong"),
    )
    return texts(out, "hong_kong", "unknown_zone")


@query(
    "window_id",
    with_ctes("tele", f"SELECT event_id, {wid('ts', 15)} AS w15, {wid('ts', 30)} AS w30, {wid('ts', 45)} AS w45, {wid('ts', 50)} AS w50 FROM tele"),
)
def window_id(spark, sf):
    return telemetry(spark, sf).select("event_id", *[timing.window_id(F.col("timestamp"), s).alias(f"w{s}") for s in (15, 30, 45, 50)])


@query(
    "window_bounds",
    with_ctes("tele", "SELECT event_id, " + ", ".join(
        f"{plain(wstart('ts', s))} AS s{s}, {plain(wend('ts', s))} AS e{s}" for s in (15, 30, 45, 50)) + " FROM tele"),
)
def window_bounds(spark, sf):
    ts = F.col("timestamp")
    out = telemetry(spark, sf).select(
        "event_id",
        *[timing.window_start(ts, s).alias(f"s{s}") for s in (15, 30, 45, 50)],
        *[timing.window_end(ts, s).alias(f"e{s}") for s in (15, 30, 45, 50)],
    )
    return texts(out, *[f"{b}{s}" for b in "se" for s in (15, 30, 45, 50)])


@query(
    "window_bounds_hour",
    with_ctes("tele", "SELECT event_id, " + ", ".join(
        f"strftime({hstart('ts', s)}, '%Y-%m-%d_%H-%M-%S') AS i{s}, {plain(hstart('ts', s) + f' + INTERVAL {s} MINUTE')} AS e{s}" for s in (15, 30, 45, 50)
    ) + " FROM tele"),
)
def window_bounds_hour(spark, sf):
    ts = F.col("timestamp")
    out = telemetry(spark, sf).select(
        "event_id",
        *[timing.window_id_hour(ts, s).alias(f"i{s}") for s in (15, 30, 45, 50)],
        *[timing.window_end_hour(ts, s).alias(f"e{s}") for s in (15, 30, 45, 50)],
    )
    return texts(out, *[f"e{s}" for s in (15, 30, 45, 50)])


def _snap_sql(size: int) -> str:
    start, follow = f"{wnum('ts', size)} * {size}", f"least(({wnum('ts', size)} + 1) * {size}, 1440)"
    micros = f"({minute_of('ts')} * 60000000 + extract('microseconds' FROM ts))"
    whole = f"({minute_of('ts')} * 60 + extract('second' FROM ts))"
    chosen = f"""CASE WHEN {micros} - {start} * 60000000 <= 5000000 THEN {start}
  WHEN {follow} * 60000000 - {micros} <= 5000000 THEN {follow}
  WHEN {whole} % {size * 60} < {size * 30} THEN {start} ELSE {follow} END"""
    return plain(f"(date_trunc('day', ts) + to_minutes(CAST({chosen} AS BIGINT)))")


@query(
    "snap_window",
    with_ctes("tele", "SELECT event_id, " + ", ".join(f"{_snap_sql(s)} AS s{s}" for s in (15, 30, 45, 50)) + " FROM tele"),
)
def snap_window(spark, sf):
    out = telemetry(spark, sf).select(
        "event_id", *[timing.snap_window(F.col("timestamp"), s).alias(f"s{s}") for s in (15, 30, 45, 50)]
    )
    return texts(out, *[f"s{s}" for s in (15, 30, 45, 50)])


COUNT_SQL = """CASE o_orderkey % 5 WHEN 0 THEN format('{:,.2f}', o_totalprice) WHEN 1 THEN CAST(o_custkey AS VARCHAR) || '.0'
  WHEN 2 THEN ' ' WHEN 3 THEN 'none' ELSE '-' || CAST(o_custkey AS VARCHAR) END"""


def count_text():
    kind = F.col("o_orderkey") % 5
    customer = F.col("o_custkey").cast("string")
    return (
        F.when(kind == 0, F.format_number("o_totalprice", 2))
        .when(kind == 1, F.concat(customer, F.lit(".0")))
        .when(kind == 2, " ")
        .when(kind == 3, "none")
        .otherwise(F.concat(F.lit("-"), customer))
    )


@query(
    "normalize_count",
    f"SELECT o_orderkey, CAST(trunc(TRY_CAST(replace(trim({COUNT_SQL}), ',', '') AS DOUBLE)) AS BIGINT) AS count FROM orders",
)
def normalize_count(spark, sf):
    return table(spark, sf, "orders").select("o_orderkey", cleaning.normalize_count(count_text()).alias("count"))


@query(
    "coerce_numeric",
    """SELECT o_orderkey, CASE o_orderkey % 5 WHEN 0 THEN CASE WHEN o_totalprice < 1000 THEN round(o_totalprice, 2) END WHEN 1 THEN CAST(o_custkey AS DOUBLE)
  WHEN 4 THEN -CAST(o_custkey AS DOUBLE) END + 0.0 AS number FROM orders""",
)
def coerce_numeric(spark, sf):
    number = cleaning.coerce_number(count_text()) + F.lit(0.0)
    return table(spark, sf, "orders").select("o_orderkey", number.alias("number"))


@query(
    "clean_count",
    "SELECT o_orderkey, CASE o_orderkey % 3 WHEN 0 THEN 0 WHEN 1 THEN 0 ELSE o_custkey END AS count FROM orders",
)
def clean_count(spark, sf):
    dirty = F.when(F.col("o_orderkey") % 3 == 0, None).when(F.col("o_orderkey") % 3 == 1, -F.col("o_custkey") - 1).otherwise(F.col("o_custkey"))
    return table(spark, sf, "orders").select("o_orderkey", cleaning.clean_count(dirty).alias("count"))


@query("log_count", with_ctes("tele", "SELECT event_id, round(ln(1 + cnt), 9) AS log_count FROM tele"))
def log_count(spark, sf):
    return rounded(telemetry(spark, sf).select("event_id", cleaning.log_count(F.col("count")).alias("log_count")), "log_count", places=9)


@query(
    "normalize_ip",
    with_ctes("tele", """
SELECT event_id, CASE event_id % 5 WHEN 0 THEN '0.0.0.0' WHEN 1 THEN '8.8.8.8' ELSE source_ip END AS ip,
  CASE WHEN event_id % 5 = 0 THEN 0 ELSE 1 END AS has_ip FROM tele"""),
)
def normalize_ip(spark, sf):
    kind = F.col("event_id") % 5
    first = F.when(kind == 0, " Null ").when(kind == 1, "N/A").when(kind == 2, "").when(kind == 3, None).otherwise(
        F.concat(F.lit(" "), "source_ip")
    )
    second = F.when(kind == 0, "").when(kind == 1, "8.8.8.8").otherwise(F.col("source_ip"))
    return telemetry(spark, sf).select(
        "event_id",
        cleaning.normalize_ip(first, second).alias("ip"),
        cleaning.normalize_ip(first, second, default=None).isNotNull().cast("int").alias("has_ip"),
    )


@query("label_binary", with_ctes("tele", "SELECT event_id, CASE WHEN source_label = 'attack' THEN 1 ELSE 0 END AS is_attack FROM tele"))
def label_binary(spark, sf):
    return telemetry(spark, sf).select("event_id", cleaning.label_binary(F.col("source_label")).alias("is_attack"))


@query(
    "rule_family",
    with_ctes("fam", "SELECT rule_id, family, CASE WHEN rule_id % 8 = 0 THEN 'own' ELSE family END AS with_override FROM fam"),
)
def rule_family(spark, sf):
    explicit = F.when(F.col("rule_id") % 8 == 0, "own")
    return catalog(spark, sf).select(
        "rule_id",
        naming.rule_family(F.col("name"), FAMILY_PATTERNS).alias("family"),
        naming.rule_family(F.col("name"), FAMILY_PATTERNS, explicit).alias("with_override"),
    )


BUCKET_SQL = """CASE WHEN (lower(name) LIKE 'orb\\_%' ESCAPE '\\' OR feature LIKE 'family\\_orb\\_%' ESCAPE '\\') AND lower(name) LIKE '%beacon%' THEN 0
  WHEN lower(name) LIKE 'orb\\_%' ESCAPE '\\' OR feature LIKE 'family\\_orb\\_%' ESCAPE '\\' THEN 1
  WHEN lower(name) LIKE '%beacon%' THEN 2 ELSE 3 END"""


@query(
    "priority_bucket",
    with_ctes("cat", f"""
WITH f AS (SELECT rule_id, name, CASE WHEN rule_id % 6 = 0 THEN 'family_orb_3xx' ELSE 'rule_' || CAST(rule_id AS VARCHAR) END AS feature FROM cat)
SELECT rule_id, {BUCKET_SQL} AS bucket FROM f"""),
)
def priority_bucket(spark, sf):
    feature = F.when(F.col("rule_id") % 6 == 0, "family_ORB_7xx").otherwise(F.concat(F.lit("rule_"), F.col("rule_id").cast("string")))
    return catalog(spark, sf).select("rule_id", naming.priority_bucket(F.col("name"), feature, PREFIX, KEYWORD).alias("bucket"))


@query(
    "feature_meta",
    with_ctes("fam", """
SELECT rule_id, CASE WHEN rule_id % 2 = 0 THEN rule_id END AS parsed_rule, CASE WHEN rule_id % 2 = 1 THEN family END AS parsed_family FROM fam"""),
)
def feature_meta(spark, sf):
    rules = catalog(spark, sf).withColumn("family", naming.rule_family(F.col("name"), FAMILY_PATTERNS))
    feature = F.when(F.col("rule_id") % 2 == 0, F.concat(F.lit("rule_"), F.col("rule_id").cast("string"))).otherwise(
        F.concat(F.lit("family_"), "family")
    )
    return rules.select("rule_id", naming.feature_rule_id(feature).alias("parsed_rule"), naming.feature_family(feature).alias("parsed_family"))




@query(
    "feature_entry",
    """
WITH words AS (SELECT doc_id, n_chars, 'feature_' || CAST(doc_id AS VARCHAR) || ' | ' || array_to_string(list_transform(range(0, 4 + doc_id % 20), lambda i: lang || CAST(i * 37 AS VARCHAR)), ' ') AS t FROM documents),
lens AS (SELECT doc_id, n_chars, t, string_split(t, ' ') AS w FROM words),
fit AS (SELECT doc_id, n_chars, t, list_max(list_filter(range(1, len(w) + 1), lambda i: length(array_to_string(w[1:i], ' ')) <= 77)) AS k, w FROM lens)
SELECT doc_id, t AS display, CASE WHEN length(t) <= 80 THEN t ELSE array_to_string(w[1:k], ' ') || '...' END AS short,
  CAST(CASE doc_id % 3 WHEN 0 THEN n_chars WHEN 1 THEN n_chars + 1 ELSE n_chars + 2 END AS DOUBLE) AS importance FROM fit""",
)
def feature_entry(spark, sf):
    d = table(spark, sf, "documents")
    label = F.concat_ws(" ", F.transform(F.sequence(F.lit(0).cast("bigint"), 3 + F.col("doc_id") % 20), lambda i: F.concat(F.col("lang"), (i * 37).cast("string"))))
    size = F.col("n_chars").cast("double")
    third = F.col("doc_id") % 3
    feature = naming.first_text(F.lit(""), F.concat(F.lit("feature_"), F.col("doc_id").cast("string")))
    return d.select(
        "doc_id", naming.feature_display(feature, label).alias("display"), naming.feature_display(feature, label, 80).alias("short"),
        naming.feature_importance(
            F.when(third == 0, size), F.when(third == 1, size + 1).otherwise(F.lit(0.0)), size + 2
        ).alias("importance"),
    )


@query(
    "confidence_pct",
    with_ctes("scores", "SELECT event_id, CASE event_id % 3 WHEN 0 THEN 'N/A' ELSE printf('%.1f', floor(score * 100)) || '%' END AS pct FROM scores"),
)
def confidence_pct(spark, sf):
    whole = F.floor(F.col("score") * 100).cast("double")
    shown = F.when(F.col("event_id") % 3 == 0, None).when(F.col("event_id") % 3 == 1, F.when(whole > 1, whole).otherwise(whole / 100)).otherwise(whole / 100)
    return scores(spark, sf).select("event_id", naming.confidence_pct(shown).alias("pct"))


@query(
    "sanitize_text",
    """SELECT doc_id, md5(replace(replace(text, chr(13), ' '), chr(10), ' ')) AS message,
  md5(replace(replace(replace(text, chr(9), ' '), chr(10), ' '), '=', ':')) AS value FROM documents""",
)
def sanitize_text(spark, sf):
    return table(spark, sf, "documents").select(
        "doc_id", F.md5(naming.sanitize_text(F.col("text"))).alias("message"), F.md5(naming.clean_value(F.col("text"))).alias("value")
    )


@query(
    "indexed_keys",
    with_ctes("tele", """
SELECT event_id, 'rule_id-1=' || CAST(rule_id AS VARCHAR) || ';value-1=' || CAST(cnt AS VARCHAR) || ';rule_id-2=' || CAST(rule_id + 1 AS VARCHAR) || ';value-2=' || CAST(cnt + 1 AS VARCHAR) AS pairs FROM tele"""),
)
def indexed_keys(spark, sf):
    entries = F.array(
        F.struct(F.col("rule_id").alias("rule_id"), F.col("count").alias("value")),
        F.struct((F.col("rule_id") + 1).alias("rule_id"), (F.col("count") + 1).alias("value")),
    )
    pairs = F.flatten(F.transform(naming.indexed_keys(entries), lambda m: F.map_entries(m)))
    text = F.concat_ws(";", F.transform(pairs, lambda e: F.concat(e["key"], F.lit("="), e["value"])))
    return telemetry(spark, sf).select("event_id", text.alias("pairs"))


@query(
    "resolve_rule_name",
    with_ctes("fam", """
SELECT rule_id, CASE rule_id % 4 WHEN 0 THEN name WHEN 1 THEN 'listed' WHEN 2 THEN 'mapped' ELSE CAST(rule_id AS VARCHAR) END
  || CASE WHEN family = 'Uncategorized' THEN '' ELSE '(' || family || ')' END AS shown FROM fam"""),
)
def resolve_rule_name(spark, sf):
    rid = F.col("rule_id")
    family = naming.rule_family(F.col("name"), FAMILY_PATTERNS)
    return catalog(spark, sf).select(
        "rule_id",
        naming.resolve_rule_name(
            rid,
            F.when(rid % 4 == 0, F.col("name")).when(rid % 4 == 1, "12345"),
            F.when(rid % 4 == 1, "listed"),
            F.when(rid % 4 == 2, "mapped").when(rid % 4 == 1, "not this"),
            F.when(family != naming.NO_FAMILY, family),
        ).alias("shown"),
    )


@query(
    "rule_display",
    with_ctes("cat", "SELECT rule_id, CASE WHEN rule_id % 5 = 0 THEN CAST(rule_id AS VARCHAR) ELSE name || ' (ID:' || CAST(rule_id AS VARCHAR) || ')' END AS shown FROM cat"),
)
def rule_display(spark, sf):
    return catalog(spark, sf).select(
        "rule_id", naming.rule_display(F.col("rule_id"), F.when(F.col("rule_id") % 5 != 0, F.col("name"))).alias("shown")
    )


@query(
    "rules_text",
    with_ctes("tele", """
SELECT event_id, '{"' || CAST(rule_id AS VARCHAR) || '":' || CAST(cnt AS VARCHAR) || '}' AS rules_text, cnt AS back FROM tele"""),
)
def rules_text(spark, sf):
    name = F.col("rule_id").cast("string")
    t = telemetry(spark, sf).withColumn("rules_text", nested.rules_text(F.create_map(name, "count")))
    return t.select("event_id", "rules_text", nested.safe_map_value(nested.rules_map(F.col("rules_text")), name).alias("back"))


@query(
    "get_path",
    """SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS deep, CAST(NULL AS VARCHAR) AS absent FROM events""",
)
def get_path(spark, sf):
    doc = F.concat(F.lit('{"a":{"b":'), "props", F.lit("}}"))
    return table(spark, sf, "events").select(
        "event_id",
        nested.get_path(doc, "a.b.k").cast("bigint").alias("deep"),
        nested.get_path(doc, "a.x.k").alias("absent"),
    )


@query("threshold_flag", with_ctes("scores", "SELECT event_id, CASE WHEN score > 0.25 THEN 1 ELSE 0 END AS is_alert FROM scores"))
def flag(spark, sf):
    return scores(spark, sf).select("event_id", threshold_flag(F.col("score"), 0.25).cast("int").alias("is_alert"))


@query(
    "family_share_value",
    with_ctes("tele", """
SELECT event_id, CASE WHEN s > 0 THEN value * cnt / s ELSE value END AS share
FROM (SELECT event_id, value, cnt, sum(cnt) OVER (PARTITION BY user_id, rule_id) AS s FROM tele)"""),
)
def family_share(spark, sf):
    t = telemetry(spark, sf)
    # totals per group are aggregated and joined back, so a hot group is never sorted in one task
    totals = t.groupBy("user_id", "rule_id").agg(F.sum("count").alias("total"))
    return t.join(totals, ["user_id", "rule_id"]).select(
        "event_id", naming.family_share_value(F.col("value"), F.col("count"), F.col("total")).alias("share")
    )
