from __future__ import annotations

import hashlib
import io

import pytest
import zstandard
from hypothesis import given, settings
from hypothesis import strategies as st

from trigwatch.llm.common import shared_folder
from trigwatch.llm.files import open_file
from trigwatch.llm.warc import ArchiveError, dictionary_frame, parse_record, read_archive, read_archives, record_bytes, train_dictionary, write_archives


def pages(spark, rows):
    return spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "1 AS size", "'d' AS digest", "2 AS _owner")


def brute(rows):
    out = []
    for page_id, _, html in rows:
        data = (html or "").encode()
        ids = [p for p, _, h in rows if (h or "") == (html or "") and p is not None]
        refers = min(ids) if len(data) >= 100 and ids and page_id != min(ids) else None
        out.append((page_id, len(data), hashlib.sha256(data).hexdigest(), "response" if refers is None else "revisit", refers))
    return sorted(map(str, out))


def back(spark, rows):
    manifest = write_archives(pages(spark, rows), shared_folder(spark, "warc"))
    return manifest, read_archives(manifest)


ROWS = [
    (1, "http://a", "<p>" + "x" * 200), (2, None, "<p>" + "x" * 200), (2, "http://c\r\nX: y", "<p>" + "x" * 200), (None, "u", "<p>" + "x" * 200),
    (3, "http://d", None), (4, "", ""), (5, "http://e", "short"), (6, "http://f", "short"), (1, "http://a", "<p>" + "x" * 200),
    (7, "http://g", "é漢" * 300_000), (None, None, "lonely" * 30), (None, None, "lonely" * 30), (8, "http://h", "WARC/1.1\r\n\r\n" * 20),
]


def test_round_trip(spark):
    _, frame = back(spark, ROWS)
    got = frame.collect()
    assert sorted(str((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to)) for r in got) == brute(ROWS)
    texts = {(p, (h or "").encode()) for p, _, h in ROWS}
    assert all((r.page_id, bytes(r.payload)) in texts for r in got if r.record_type == "response")
    assert all(r.payload is None for r in got if r.record_type == "revisit")


def test_empty_table(spark):
    manifest, frame = back(spark, [])
    assert manifest.count() == 0 and frame.count() == 0


def test_hot_payload(spark):
    rows = [(i, "u", "z" * 150) for i in range(50, 700)] + [(i, "u", f"{i}" * 60) for i in range(50)]
    assert sorted(str((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to)) for r in back(spark, rows)[1].collect()) == brute(rows)


def test_one_frame_per_record_and_leading_dictionary(spark):
    manifest, _ = back(spark, [(i, f"http://x/{i}", f"<html><body>some page text {i} and more</body></html>" * 4) for i in range(300)])
    for path, records in manifest.select("path", "records").collect():
        with open_file(path) as stream:
            data = stream.read()
        assert data[:4] == b"\x5d\x2a\x4d\x18"
        assert sum(1 for _ in read_archive(io.BytesIO(data))) == records
        assert zstandard.get_frame_parameters(data[8 + int.from_bytes(data[4:8], "little"):]).dict_id


@settings(max_examples=40, deadline=None)
@given(st.lists(st.binary(max_size=300), max_size=5), st.booleans())
def test_frames(blocks, with_dictionary):
    known = train_dictionary([b"some sample %d" % i * 9 for i in range(50)]) if with_dictionary else b""
    packer = zstandard.ZstdCompressor(dict_data=zstandard.ZstdCompressionDict(known)) if known else zstandard.ZstdCompressor()
    data = (dictionary_frame(known) if known else b"") + b"".join(packer.compress(b) for b in blocks)
    assert list(read_archive(io.BytesIO(data))) == blocks


def good():
    return record_bytes(5, "http://a", hashlib.sha256(b"abc").hexdigest(), 3, None, b"abc", "2020-01-01T00:00:00Z")


@pytest.mark.parametrize(
    "change",
    [
        lambda r: r.replace(b"WARC/1.1", b"WARC/9.9"), lambda r: r.replace(b"Content-Length: 3", b"Content-Length: 4"),
        lambda r: r.replace(b"Content-Length: 3", b"Content-Length: -3"), lambda r: r[:-2], lambda r: r.replace(b"abc\r\n", b"abd\r\n"),
        lambda r: r.replace(b"WARC-Type: response\r\n", b""), lambda r: r.replace(b"WARC-Date", b"no colon here\r\nWARC-Date"),
        lambda r: r.replace(b"X-Payload-Length: 3", b"X-Payload-Length: 9"), lambda r: r.replace(b"response", b"revisit"),
        lambda r: r.replace(b"WARC-Date", b"WARC-Type: response\r\nWARC-Date"), lambda r: b"",
    ],
)
def test_bad_records(change):
    assert parse_record(good())["block"] == b"abc"
    with pytest.raises(ArchiveError):
        parse_record(change(good()))


def test_cut_archives():
    data = zstandard.ZstdCompressor().compress(good())
    with pytest.raises(ArchiveError):
        list(read_archive(io.BytesIO(data[:-3])))
    with pytest.raises(ArchiveError):
        list(read_archive(io.BytesIO(dictionary_frame(b"abc" * 50)[:20])))


def test_missing_records_fail(spark):
    manifest, _ = back(spark, ROWS[:3])
    with pytest.raises(Exception, match="manifest says"):
        read_archives(manifest.selectExpr("path", "records + 1 AS records")).collect()
