"""Zstandard web archives: one frame per record, the dictionary in a leading skippable frame."""

from __future__ import annotations

import hashlib
import re
import struct
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trigwatch.llm.common import attach_groups, batched, filled, hash_sample, shared_folder, stored, table
from trigwatch.llm.files import check_folder, new_file, open_file
from trigwatch.llm.registry import query

#: fixed values of the archive format
DICT_MAGIC, ZSTD_MAGIC, VERSION = 0x184D2A5D, b"\x28\xb5\x2f\xfd", b"WARC/1.1"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

#: payloads below this are never replaced by a revisit
REVISIT_BYTES = 100
#: bound of the sample that the dictionary is trained on, and of the dictionary
DICT_PAGES, DICT_PAGE_BYTES, DICT_BYTES = 400, 8192, 32768
READ_BYTES = 1 << 20


def train_dictionary(samples: list[bytes]) -> bytes:
    """A dictionary from the samples; few or uniform samples serve as raw content, none as no dictionary."""
    if sum(map(len, samples)) < 64:
        return b""
    try:
        return zstandard.train_dictionary(DICT_BYTES, samples).as_bytes()
    except zstandard.ZstdError:
        return b"".join(samples)[-DICT_BYTES:]


def _header(value: str) -> str:
    """A header value on one line: control characters as percent escapes."""
    return re.sub(r"[\x00-\x1f\x7f]", lambda m: f"%{ord(m[0]):02X}", value)


def record_bytes(page_id: int | None, url: str | None, digest: str, size: int, refers_to: int | None, payload: bytes, date: str) -> bytes:
    """One record. A revisit has an empty block and names the record that holds its payload."""
    kind = "response" if refers_to is None else "revisit"
    block = payload if refers_to is None else b""
    lines = [f"WARC-Type: {kind}", f"WARC-Record-ID: <urn:page:{'null' if page_id is None else page_id}>", f"WARC-Date: {date}"]
    if url is not None:
        lines.append(f"WARC-Target-URI: {_header(url)}")
    if refers_to is not None:
        lines += [f"WARC-Refers-To: <urn:page:{refers_to}>", f"WARC-Profile: {REVISIT_PROFILE}"]
    lines += [f"WARC-Payload-Digest: sha256:{digest}", f"X-Payload-Length: {size}", "Content-Type: text/html; charset=utf-8", f"Content-Length: {len(block)}"]
    return VERSION + b"\r\n" + "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


class ArchiveError(ValueError):
    """An archive or a record breaks the format."""


def parse_record(raw: bytes) -> dict:
    """Headers and block of a record, after checking the version, the required headers, the
    length of the block, its end, and the digest and length of a response's payload."""
    head, found, rest = raw.partition(b"\r\n\r\n")
    lines = head.split(b"\r\n")
    if not found or lines[0] not in (b"WARC/1.0", VERSION):
        raise ArchiveError("no record header")
    headers: dict[str, str] = {}
    for line in lines[1:]:
        name, colon, value = line.decode("utf-8").partition(":")
        if not colon or not name.strip():
            raise ArchiveError(f"bad header line {line[:80]!r}")
        if name.lower() in headers:
            raise ArchiveError(f"header {name} occurs twice")
        headers[name.lower()] = value.strip()
    for name in ("warc-type", "warc-record-id", "warc-date", "content-length"):
        if name not in headers:
            raise ArchiveError(f"header {name} is missing")
    if not re.fullmatch(r"[0-9]+", headers["content-length"]):
        raise ArchiveError("bad content length")
    size = int(headers["content-length"])
    if len(rest) != size + 4 or rest[size:] != b"\r\n\r\n":
        raise ArchiveError(f"the block has {len(rest) - 4} bytes, the header says {size}")
    block = rest[:size]
    if headers["warc-type"] == "response" and (digest := headers.get("warc-payload-digest")):
        if digest.lower() != f"sha256:{hashlib.sha256(block).hexdigest()}":
            raise ArchiveError("the payload does not have its digest")
    if headers["warc-type"] == "response" and int(headers.get("x-payload-length", size)) != size:
        raise ArchiveError("the payload does not have its length")
    if headers["warc-type"] == "revisit" and "warc-refers-to" not in headers:
        raise ArchiveError("a revisit refers to no record")
    return headers | {"block": block}


def dictionary_frame(dictionary: bytes) -> bytes:
    """The leading skippable frame; its content is the compressed dictionary."""
    data = zstandard.ZstdCompressor(level=19).compress(dictionary)
    return struct.pack("<II", DICT_MAGIC, len(data)) + data


def read_archive(stream) -> Iterator[bytes]:
    """Bytes of each record of an archive, read in pieces; one record is held at a time."""
    head = stream.read(8)
    unzip, data = zstandard.ZstdDecompressor(), head
    if len(head) == 8 and struct.unpack("<I", head[:4])[0] == DICT_MAGIC:
        (size,) = struct.unpack("<I", head[4:])
        data = stream.read(size)
        if len(data) != size:
            raise ArchiveError("the dictionary frame is cut off")
        if data[:4] == ZSTD_MAGIC:
            data = zstandard.ZstdDecompressor().decompress(data, max_output_size=1 << 27)
        unzip = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(data))
        data = b""
    while data or (data := stream.read(READ_BYTES)):
        frame, parts = unzip.decompressobj(), []
        while True:
            parts.append(frame.decompress(data))
            if frame.eof:
                data = frame.unused_data
                break
            if not (data := stream.read(READ_BYTES)):
                raise ArchiveError("the last frame is cut off")
        yield b"".join(parts)


def payload_owners(pages: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``pages`` with ``_digest, _bytes`` of the payload and ``_owner``, the smallest id of the
    pages with that payload, null unless it is long enough and another page has it too."""
    payload = filled(text_col)
    known = pages.withColumns({"_digest": F.sha2(payload, 256), "_bytes": F.octet_length(payload).cast("long")})
    same = (
        known.where(F.col("_bytes") >= REVISIT_BYTES).groupBy("_digest")
        .agg(F.min(id_col).alias("_owner"), F.count(F.lit(1)).alias("_n")).where("_n > 1")
    )
    return attach_groups(known, stored(same, "payloads"), "_digest", "_n", [id_col]).drop("_n")


def write_archives(pages: DataFrame, folder: str, id_col: str = "page_id", url_col: str = "url", text_col: str = "html", date: str = "1970-01-01T00:00:00Z") -> DataFrame:
    """Write a record per page; returns the manifest ``path, records``, one row per archive.

    The payload is the whole text in UTF-8, null the empty payload. Of pages with equal
    payloads of at least ``REVISIT_BYTES``, the smallest id is the response and the others
    revisit it; rows that repeat the smallest id are responses too, as are null ids of a group
    without any id; other null ids revisit. Null urls have no header, control characters in urls are escaped.
    Other columns are not read; an empty table gives no archive.

    The dictionary comes from a bounded sample (``DICT_PAGES`` pages in hash order, the head
    of each); all pages are compressed with it. A payload that fills a third of all rows is
    found by a map-side aggregate and its pages stay where they are. A repeated task writes another archive;
    only archives of successful tasks enter the stored manifest.
    """
    check_folder(folder)
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), filled(text_col).alias("html"))
    dictionary = train_dictionary([t.encode()[:DICT_PAGE_BYTES] for t in hash_sample(rows, "html", DICT_PAGES) if t])

    def write(batches):
        out, n, part = None, 0, TaskContext.get().partitionId()
        packer = zstandard.ZstdCompressor(level=3, dict_data=zstandard.ZstdCompressionDict(dictionary)) if dictionary else zstandard.ZstdCompressor(level=3)
        for batch in batches:
            for page_id, url, digest, size, refers, html in zip(*(c.to_pylist() for c in batch.columns)):
                if out is None:
                    path, out = new_file(folder, part, "warc.zst")
                    if dictionary:
                        out.write(dictionary_frame(dictionary))
                out.write(packer.compress(record_bytes(page_id, url, digest, size, refers, (html or "").encode(), date)))
                n += 1
        if out is not None:
            out.close()
            yield pa.RecordBatch.from_pydict({"path": [path], "records": [n]}, schema=pa.schema([("path", pa.string()), ("records", pa.int64())]))

    owned = payload_owners(rows, "page_id", "html")
    refers = F.when(F.col("_owner").isNotNull() & (F.col("page_id").isNull() | (F.col("page_id") != F.col("_owner"))), F.col("_owner"))
    records = owned.select("page_id", "url", F.col("_digest").alias("digest"), F.col("_bytes").alias("size"), refers.alias("refers"), "html")
    records = records.withColumn("html", F.when(F.col("refers").isNull(), F.col("html")))
    return stored(batched(records).mapInArrow(write, "path string, records long"), "archives")


READ = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, payload binary"


def _page(urn: str | None) -> int | None:
    found = re.fullmatch(r"<urn:page:(null|-?[0-9]+)>", urn or "")
    if urn is not None and not found:
        raise ArchiveError(f"unknown record id {urn[:80]}")
    return None if not found or found[1] == "null" else int(found[1])


def read_archives(manifest: DataFrame, payload: bool = True) -> DataFrame:
    """Every record of the archives, checked; a file with fewer or more records than its
    manifest row says, or a record that breaks the format, fails the job with its path.

    ``payload`` is null for revisits; length and digest are of the full payload either way.
    """
    n = max(1, min(manifest.count(), 100_000))

    def read(batches):
        for batch in batches:
            for path, records in zip(*(c.to_pylist() for c in batch.columns)):
                rows, held, seen = [], 0, 0
                with open_file(path) as stream:
                    for raw in read_archive(stream):
                        try:
                            r = parse_record(raw)
                            kind, digest = r["warc-type"], r.get("warc-payload-digest", "")
                            size = int(r.get("x-payload-length", r["content-length"]))
                            rows.append((
                                _page(r["warc-record-id"]), r.get("warc-target-uri"), size, digest.removeprefix("sha256:"), kind,
                                _page(r.get("warc-refers-to")), r["block"] if payload and kind == "response" else None,
                            ))
                        except ArchiveError as error:
                            raise ArchiveError(f"{path}, record {seen}: {error}") from error
                        seen += 1
                        held += len(r["block"]) if payload else 200
                        if held > 8 << 20 or len(rows) == 5000:
                            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)
                            rows, held = [], 0
                if seen != records:
                    raise ArchiveError(f"{path} has {seen} records, the manifest says {records}")
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)

    schema = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("payload", pa.binary())])
    return manifest.repartition(n, "path").mapInArrow(read, READ)


@query(
    "op2_warc",
    """WITH p AS (SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest,
       min(page_id) OVER (PARTITION BY coalesce(html, '')) AS owner FROM pages)
       SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN payload_bytes >= 100 AND owner IS NOT NULL AND page_id IS DISTINCT FROM owner THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN payload_bytes >= 100 AND owner IS NOT NULL AND page_id IS DISTINCT FROM owner THEN owner END AS refers_to FROM p""",
)
def op2_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    manifest = write_archives(table(spark, sf_dir, "pages"), shared_folder(spark, "warc"))
    return read_archives(manifest, payload=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
