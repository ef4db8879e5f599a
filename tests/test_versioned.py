"""Versioned tables: crashes, readers, rival writers, old versions."""

from __future__ import annotations

from datetime import date

import pytest

from trigwatch.operators import store
from trigwatch.plans.tables import scratch
from trigwatch.sources import versioned

KEYS = ["k"]


def frame(spark, *rows):
    return spark.createDataFrame([(k, v, n, date.fromisoformat(d) if d else None) for k, v, n, d in rows], "k STRING, v BIGINT, version BIGINT, window_date DATE")


def rows_of(df):
    return sorted((r.k, r.v) for r in df.collect())


@pytest.fixture
def table(spark):
    path = scratch(spark, "versioned")
    assert store.upsert_table(frame(spark, ("a", 1, 1, "2024-01-01"), ("b", 2, 1, "2024-01-02"), ("c", 3, 1, None)), path, KEYS, "version") == 1
    return path


def test_a_killed_writer_leaves_the_old_rows(spark, table, monkeypatch):
    def killed(*args, **settings):
        raise KeyboardInterrupt

    new = frame(spark, ("a", 9, 2, "2024-01-01"))
    with monkeypatch.context() as patch:
        patch.setattr(versioned, "publish", killed)  # the data are written, the version is not published
        with pytest.raises(KeyboardInterrupt):
            store.upsert_table(new, table, KEYS, "version")
    assert rows_of(store.read_table(spark, table)) == [("a", 1), ("b", 2), ("c", 3)]
    assert store.upsert_table(new, table, KEYS, "version") == 2
    assert rows_of(store.read_table(spark, table)) == [("a", 9), ("b", 2), ("c", 3)]


def test_a_reader_keeps_its_version(spark, table):
    reader = store.read_table(spark, table)
    half = rows_of(reader.where("v < 3"))
    store.upsert_table(frame(spark, ("a", 9, 2, "2024-01-01"), ("d", 4, 2, "2024-01-03"), ("c", 8, 2, None)), table, KEYS, "version")
    assert half + rows_of(reader.where("v >= 3")) == [("a", 1), ("b", 2), ("c", 3)]
    assert rows_of(store.read_table(spark, table, 1)) == [("a", 1), ("b", 2), ("c", 3)]
    assert rows_of(store.read_table(spark, table)) == [("a", 9), ("b", 2), ("c", 8), ("d", 4)]


def overtaken(monkeypatch, rival):
    """Another writer publishes once, right before this one does."""
    plain, turn = versioned.publish, []

    def slow(*args):
        if not turn:
            turn.append(1)
            rival()
        return plain(*args)

    monkeypatch.setattr(versioned, "publish", slow)


def test_of_two_writers_one_is_refused(spark, table, monkeypatch):
    overtaken(monkeypatch, lambda: store.upsert_table(frame(spark, ("a", 5, 2, "2024-01-01")), table, KEYS, "version"))
    with pytest.raises(versioned.TableConflict):
        store.upsert_table(frame(spark, ("a", 6, 3, "2024-01-01")), table, KEYS, "version")
    assert rows_of(store.read_table(spark, table)) == [("a", 5), ("b", 2), ("c", 3)]


def test_an_overtaken_writer_merges_again(spark, table, monkeypatch):
    overtaken(monkeypatch, lambda: store.upsert_table(frame(spark, ("x", 5, 2, "2024-01-01")), table, KEYS, "version"))
    assert store.upsert_table(frame(spark, ("a", 6, 3, "2024-01-01")), table, KEYS, "version", tries=2) == 3
    assert rows_of(store.read_table(spark, table)) == [("a", 6), ("b", 2), ("c", 3), ("x", 5)]


def test_put_if_absent(spark):
    path = scratch(spark, "one") + "/x.json"
    assert versioned.put_if_absent(spark, path, "first") and not versioned.put_if_absent(spark, path, "second")
    assert versioned.read_text(spark, path) == "first"
    assert [name for name, _ in versioned.folder_entries(spark, path.rsplit("/", 1)[0]) if name.endswith("json")] == ["x.json"]
    assert [n for n, _ in versioned.folder_entries(spark, path.rsplit("/", 1)[0]) if ".tmp" in n] == []


def test_old_versions_go(spark, table):
    for n in (2, 3, 4):
        store.upsert_table(frame(spark, ("a", n, n, "2024-01-01")), table, KEYS, "version")
    assert versioned.vacuum(spark, table, keep=1) == 0  # everything is young
    assert versioned.versions(spark, table) == [4]
    assert versioned.vacuum(spark, table, keep=1, min_age_seconds=-5) == 3
    assert rows_of(store.read_table(spark, table)) == [("a", 4), ("b", 2), ("c", 3)]
    assert versioned.vacuum(spark, table, keep=1, min_age_seconds=-5) == 0


def test_no_table_and_empty_table(spark, table):
    assert store.read_table(spark, scratch(spark, "none")) is None
    now = versioned.manifest(spark, table)
    versioned.drop_partitions(spark, table, now, list(now["folders"]))
    empty = store.read_table(spark, table)
    assert empty.count() == 0 and empty.columns == ["k", "v", "version", "window_date"]
    store.upsert_table(frame(spark, ("a", 1, 1, "2024-01-01")), table, KEYS, "version")
    assert rows_of(store.read_table(spark, table)) == [("a", 1)]
