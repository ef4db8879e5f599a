from __future__ import annotations

import pytest

from trigwatch.llm.common import Scratch
from trigwatch.llm.files import check_folder, new_file, open_file, plain_path
from trigwatch.sources.versioned import folder_entries


def test_stores_keep_their_place():
    assert plain_path("s3a://bucket/a/b") == plain_path("s3n://bucket/a/b") == "s3://bucket/a/b"
    assert plain_path("abfs://c@account.host/a") == "abfss://c@account.host/a"
    assert plain_path("dbfs:/a/b") == "/dbfs/a/b"
    assert plain_path("file:/a/b") == "file:///a/b" and plain_path("file:///a/b") == "file:///a/b" and plain_path("/a/b") == "/a/b"
    assert plain_path("hdfs://host:1/a") == "hdfs://host:1/a"


def test_unknown_stores_are_refused_before_any_work():
    for path in ("viewfs://store/a", "wasbs://c@h/a", "odd://x", "relative/path"):
        with pytest.raises(ValueError, match="shared folder"):
            check_folder(path)


def test_files(tmp_path):
    folder = f"file:{tmp_path}/x"
    path, out = new_file(folder, 3, "bin")
    out.write(b"abc")
    out.close()
    with open_file(path) as source:
        assert source.read() == b"abc"


def test_scratch_goes(spark):
    work = Scratch(spark, "gone")
    table = work.stored(spark.range(5), "five")
    assert table.count() == 5
    work.clear()
    work.clear()  # nothing is left, and that is no error
    assert folder_entries(spark, work.folder) == []
