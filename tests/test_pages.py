"""Search answers are cut into pages, and no event is lost by it."""

from datetime import datetime

from pyspark.sql import functions as F

from trigwatch.plans import scans


def test_answers_are_paged(spark, monkeypatch, tmp_path):
    rows = [(i, datetime(2024, 1, 1, 5, i % 60), None if i % 40 == 39 else 1, "error", float(i), '{"k": %d}' % (i % 3)) for i in range(400)]
    df = spark.createDataFrame(rows, "event_id BIGINT, ts TIMESTAMP_NTZ, user_id BIGINT, event_type STRING, value DOUBLE, props STRING")
    df.write.parquet(str(tmp_path / "events.parquet"))
    sizes, plain = [], scans.docs.scan_search_files

    def read(spark, path):
        text = spark.read.text(path, wholetext=True)
        sizes.extend(r.n for r in text.select(F.regexp_count("value", F.lit("Custom Rule")).alias("n")).where("n > 0").collect())
        return plain(spark, path)

    monkeypatch.setattr(scans.docs, "scan_search_files", read)
    monkeypatch.setattr(scans, "ANSWER_EVENTS", 50)
    got = scans.scan_search_files(spark, str(tmp_path)).collect()
    assert sum(sizes) == sum(r.n for r in got) == 400 and sum(r.total for r in got) == sum(range(400))
    assert max(sizes) <= 100 and any(r.hostname == "global" for r in got)
