"""Small cases with known answers for the scalar functions and the window aggregate."""

from __future__ import annotations

from datetime import datetime

import pytest
from pyspark.sql import functions as F

from trigwatch.functions import cleaning, naming, nested, timing
from trigwatch.operators import aggregates as agg
from trigwatch.operators import filters, lookups
from trigwatch.sources import documents as docs

EVENT = "hostname STRING, rule_id BIGINT, timestamp TIMESTAMP_NTZ, count BIGINT, source_label STRING"


def at(clock: str, day: str = "2031-02-09") -> datetime:
    return datetime.fromisoformat(f"{day} {clock}")


def one(spark, column, **values):
    return spark.range(1).select(column).first()[0]


def stamps(spark, *clocks):
    return spark.createDataFrame([(at(c),) for c in clocks], "ts TIMESTAMP_NTZ")


@pytest.mark.parametrize(
    "clock, want",
    [
        ("10:14:56", "10:15:00"), ("10:15:04", "10:15:00"), ("10:59:56", "11:00:00"), ("11:00:04", "11:00:00"),
        ("10:15:10", "10:15:00"), ("10:45:30", "10:45:00"), ("10:08:00", "10:15:00"), ("10:07:00", "10:00:00"),
    ],
)
def test_snap(spark, clock, want):
    assert stamps(spark, clock).select(timing.snap_window(F.col("ts"), 15)).first()[0] == at(want)


@pytest.mark.parametrize("size", [15, 30, 45, 50])
def test_snap_rolls_over_midnight(spark, size):
    got = stamps(spark, "23:59:58").select(timing.snap_window(F.col("ts"), size)).first()[0]
    assert got == at("00:00:00", "2031-02-10")


def test_window_ids(spark):
    ids = [r[0] for r in stamps(spark, "09:00:00", "09:29:59", "09:30:00", "09:59:00", "10:00:00").select(timing.window_id(F.col("ts"), 30)).collect()]
    assert ids == ["2031-02-09_09-00-00_W18"] * 2 + ["2031-02-09_09-30-00_W19"] * 2 + ["2031-02-09_10-00-00_W20"]


def test_hour_anchored_differs_from_day_anchored(spark):
    row = stamps(spark, "10:50:00").select(timing.window_start(F.col("ts"), 45), timing.window_start_hour(F.col("ts"), 45)).first()
    assert row[0] == at("10:30:00") and row[1] == at("10:45:00")


def test_ingest_window_id(spark):
    row = stamps(spark, "09:41:07").select(timing.window_id_hour(F.col("ts"), 30), timing.window_end_hour(F.col("ts"), 30)).first()
    assert row == ("2031-02-09_09-30-00", at("10:00:00"))


@pytest.mark.parametrize(
    "text, want",
    [
        ("Feb 09, 2031, 9:41:07 AM", at("09:41:07")), ("Mar 03, 2031, 11:07:08 AM", at("11:07:08", "2031-03-03")),
        ("Feb 09, 2031, 12:00:01 AM", at("00:00:01")), ("invalid-timestamp", None), ("", None),
    ],
)
def test_parse(spark, text, want):
    assert one(spark, timing.parse_siem_ts(F.lit(text))) == want


@pytest.mark.parametrize(
    "text, want", [("816.0", 816), ("71,305", 71305), (" 12 ", 12), ("", None), ("many", None), ("-3.9", -3), ("nan", None), ("inf", None)]
)
def test_count(spark, text, want):
    assert one(spark, cleaning.normalize_count(F.lit(text))) == want


def test_strict_count_rejects_separators(spark):
    assert one(spark, cleaning.coerce_number(F.lit("71,305"))) is None


@pytest.mark.parametrize(
    "name, want",
    [("ORB_70012 x", "ORB_700xx"), ("ORB_703 y", "ORB_7xx"), ("ORB_70", "Uncategorized"), ("orb_703", "Uncategorized"), ("a ORB_703", "Uncategorized")],
)
def test_family(spark, name, want):
    patterns = [(r"^ORB_700\d{2}", "ORB_700xx"), (r"^ORB_7\d{2}", "ORB_7xx")]
    assert one(spark, naming.rule_family(F.lit(name), patterns)) == want


@pytest.mark.parametrize(
    "name, feature, want",
    [("ORB_1 Beacon", "", 0), ("orb_1", "", 1), (None, "family_ORB_7xx", 1), ("x beacon", "", 2), ("x", "rule_1", 3), (None, None, 3)],
)
def test_bucket(spark, name, feature, want):
    got = one(spark, naming.priority_bucket(F.lit(name).cast("string"), F.lit(feature).cast("string"), "ORB_", "Beacon"))
    assert got == want


@pytest.mark.parametrize(
    "value, want", [(0.756, "75.6%"), (1.5, "150.0%"), (75.61, "75.6%"), (None, "N/A")]
)
def test_confidence(spark, value, want):
    assert one(spark, naming.confidence_pct(F.lit(value).cast("double"))) == want


def test_shorten_drops_whole_words(spark):
    long = " ".join(["word"] * 30)
    got = one(spark, naming.shorten(F.lit(long), 80))
    assert got == " ".join(["word"] * 15) + "..." and len(got) <= 80
    assert one(spark, naming.shorten(F.lit("x" * 200), 80)) == "..."
    assert one(spark, naming.shorten(F.lit("a  b\n c"))) == "a b c"


def test_payloads(spark):
    get = lambda doc: one(spark, nested.payloads(F.lit(doc), "a.b"))
    assert get('{"a":{"b":{"k":1}}}') == ['{"k":1}']
    assert get('{"a":{"b":[{"k":1},3,{"k":2}]}}') == ['{"k":1}', '{"k":2}']
    assert get('{"x":1}') == ['{"x":1}']


def events(spark, rows):
    return spark.createDataFrame(rows, EVENT)


def test_rule_sums(spark):
    rows = [("h", 1, at("09:00:00"), c, "normal") for c in (3, 2, 4)] + [("h", 2, at("09:01:00"), 1, "normal")]
    got = agg.aggregate_windows(events(spark, rows), 30).first()
    assert got.aggregated_rules == {"1": 9, "2": 1} and got.total_events == 10 and got.unique_rules == 2 and got.is_attack == 0


def test_hosts_and_labels_are_kept_apart(spark):
    rows = [("a", 1, at("09:00:00"), 5, "normal"), ("b", 1, at("09:00:00"), 3, "normal"), ("b", 1, at("09:00:00"), 1, "attack")]
    got = {(r.hostname, r.source_label): (r.total_events, r.is_attack) for r in agg.aggregate_windows(events(spark, rows), 30).collect()}
    assert got == {("a", "normal"): (5, 0), ("b", "normal"): (3, 0), ("b", "attack"): (1, 1)}


def test_empty_single_zero_negative(spark):
    assert agg.aggregate_windows(events(spark, []), 30).count() == 0
    single = agg.aggregate_windows(events(spark, [("h", 1, at("09:00:00"), 1, "normal")]), 30).first()
    assert (single.total_events, single.unique_rules) == (1, 1)
    for bad in (0, -4, None):
        assert agg.aggregate_windows(events(spark, [("h", 1, at("09:00:00"), bad, "normal")]), 30).first().total_events == 0


def test_search_answer_to_windows(spark):
    entry = '{"sysmon_hostname (custom)":"h","Source IP":"1.2.3.4","Custom Rule":7,"Log Source Time (Minimum)":"Feb 09, 2031, %s","Count":%d}'
    parts = ",".join(entry % p for p in (("9:41:07 AM", 50), ("9:55:55 AM", 25), ("10:00:55 AM", 75)))
    # dropped: no address, placeholder address, unreadable time
    parts += ',{"Custom Rule":7,"Count":1,"Log Source Time (Minimum)":"Feb 09, 2031, 9:41:07 AM"}'
    parts += ',{"Source IP":"N/A","src_ip":"1.1.1.1","Custom Rule":7,"Count":1,"Log Source Time (Minimum)":"Feb 09, 2031, 9:41:07 AM"}'
    parts += "," + entry % ("never", 9)
    answer = spark.createDataFrame([('{"events":[%s]}' % parts,)], "a STRING")
    found = agg.named(agg.host_rule_counts(agg.ingest_windows(docs.search_events(docs.parse_search_json(answer, "a")), 30)))
    assert {(r.window_id, r["count"]) for r in found.collect()} == {("2031-02-09_09-30-00", 75), ("2031-02-09_10-00-00", 75)}


def test_documents_keep_hosts_with_dots(spark):
    rows = [("a.b.c", 1, at("09:00:00"), 2, "normal"), ("d", 1, at("09:00:00"), 3, "normal")]
    ingested = agg.ingest_windows(events(spark, rows).withColumn("source_ip", F.lit("1.1.1.1")), 30)
    stored = agg.window_documents(ingested, 30)
    assert [r["count"] for r in docs.window_rows_for_host(stored, "a.b.c").collect()] == [2]
    assert docs.has_host(stored, "a.b.c").count() == 1 and docs.has_host(stored, "a").count() == 0


def test_coverage(spark):
    used = spark.createDataFrame([(1,), (9,), (1,)], "rule_id BIGINT")
    known = spark.createDataFrame([(1,), (2,)], "rule_id BIGINT")
    assert lookups.rule_coverage(used, known).first() == (1, 1, 1)


def test_translation(spark):
    pairs = [(200033, 100033), (200045, 100045), (200099, 100100), (200001, 100001)]
    table = spark.createDataFrame([(a, b, "n") for a, b in pairs], "uat_rule_id BIGINT, prod_rule_id BIGINT, rule_name STRING")
    ids = spark.createDataFrame([(a,) for a, _ in pairs] + [(5,)], "rule_id BIGINT")
    assert {r[0] for r in lookups.translate_ids(ids, table).collect()} == {b for _, b in pairs} | {5}


def test_checks_see_schema_and_values(spark):
    found = {r[0]: r[1] for r in filters.check_events(events(spark, [("h", None, at("09:00:00"), -1, "odd")])).collect()}
    assert found["rule_id_null"] == found["count_negative"] == found["label_unknown"] == 1 and found["hostname_null"] == 0
    wrong = spark.createDataFrame([("h", "x")], "hostname STRING, rule_id STRING")
    found = {r[0]: r[1] for r in filters.check_events(wrong).collect()}
    assert found["column_rule_id"] == found["column_count"] == 1
    assert sum(r[1] for r in filters.check_events(events(spark, [])).collect()) == 0
    empty = agg.aggregate_windows(events(spark, []), 30)
    assert {r[0]: r[1] for r in filters.check_windows(empty).collect()}["empty_table"] == 1
