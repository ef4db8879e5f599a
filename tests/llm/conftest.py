from __future__ import annotations

import json

import pytest


@pytest.fixture(scope="session")
def make_docs(spark):
    """Rows (doc_id, text, lang, source) as a documents table, with columns that clash with internal names."""

    def make(rows, extra=True):
        rows = [tuple(r) + (None,) * (4 - len(r)) for r in rows]
        frame = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
        frame = frame.selectExpr("*", "cast(length(text) as int) AS n_chars")
        if extra:
            frame = frame.selectExpr("*", "'x' AS node", "1 AS size", "2.5 AS score", "'y' AS hot_group", "3 AS `group`")
        return frame

    return make


@pytest.fixture(scope="session")
def rows_of():
    """Rows of a frame as sorted tuples; nulls compare."""

    def rows(frame, *columns):
        picked = frame.select(*columns) if columns else frame
        return sorted((tuple(r) for r in picked.collect()), key=lambda r: json.dumps(r, default=str))

    return rows


@pytest.fixture(scope="session")
def odd_rows():
    """Nulls in every column, empty and very long texts, ties and repeated rows."""
    long = " ".join(f"w{i % 977}" for i in range(60_000))
    return [
        (1, "one two three four five six seven eight", "en", "a"), (1, "one two three four five six seven eight", "en", "a"),
        (2, "one two three four five six seven eight", "de", None), (None, "one two three four five six seven eight", None, "b"),
        (3, None, "en", "a"), (4, "", None, ""), (5, "  \n\t ", "en", "b"), (6, long, "en", "c"), (None, None, None, None),
        (7, "x" * 200_000, "en", "c"), (8, "ßé 漢字 \U0001f600 end", "fr", "b"), (8, "another text of the same id", "fr", "b"),
    ]
