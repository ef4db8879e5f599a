"""Token ids in binary files of shuffled byte or bit planes."""

from __future__ import annotations

import json
import os
import re
import struct
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from trigwatch.llm.common import batched, filled, shared_folder, stored, table
from trigwatch.llm.files import check_folder, new_file, open_file
from trigwatch.llm.registry import query

MAGIC = b"IDPLANE1"
TRAILER = struct.Struct("<QQQI8s")
BLOCK_IDS = 1 << 16
#: texts that are encoded together
GROUP = 64

#: white space that the chunk pattern does not split at; texts with it are encoded in one go
RARE_SPACE = re.compile("[" + "".join(c for c in map(chr, range(0x3001)) if c.isspace() and c not in " \t\n\r") + "]")
#: Latin letters, and what may follow a word of them that is cut off there: ASCII marks but the
#: apostrophe, which can begin a token that goes on with letters
LETTERS, AFTER = "A-Za-z\xc0-\xd6\xd8-\xf6\xf8-\u024f", r" \t\n\r!-&(-/:-@\[-`{-~"
CHUNK = re.compile(rf"[ \t\n\r]*[{LETTERS}]+(?=[{AFTER}]|\Z)|[ \t\n\r]*[^ \t\n\r]+|[ \t\n\r]+")
#: chunks whose ids a worker remembers, the longest of them, and marks of chunks that came once
CACHE_CHUNKS, CACHE_LENGTH, MARKS = 450_000, 32, 1 << 22


def usual_words(spec: dict) -> bool:
    """Whether a tokenizers file splits texts by the usual byte-level word pattern, as they are."""
    before = spec.get("pre_tokenizer") or {}
    plain = before.get("type") == "ByteLevel" and before.get("use_regex", True) and not before.get("add_prefix_space")
    return plain and spec.get("normalizer") is None


class Encoder:
    """Ids of texts by a tokenizers file, as little-endian unsigned 32-bit integers.

    A byte-level pre-tokenizer always starts a new token where a run of white space begins and
    where a mark follows a letter, so a text may be encoded chunk by chunk, and the ids of
    chunks that come a second time are remembered: most never do. Texts with rare white space or with the text of an added
    token are encoded whole, and so are all texts if the file splits words in another way.
    Truncation and padding of the file are not used.
    """

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # tasks already use every core
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        with open(path, encoding="utf-8") as file:
            self.by_chunk = usual_words(json.load(file))
        self.added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.cache: dict[str, bytes] = {}
        self.once = bytearray(MARKS)

    def _ids(self, texts: list[str]) -> list[bytes]:
        return [array("I", e.ids).tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def encode(self, texts: list[str]) -> list[bytes]:
        cache = self.cache
        found, missing = [], {}
        for text in texts:
            if not self.by_chunk or RARE_SPACE.search(text) or any(a in text for a in self.added):
                found.append(self._ids([text]))
                continue
            chunks = CHUNK.findall(text)
            ids = list(map(cache.get, chunks))
            if None in ids:
                for i in [i for i, known in enumerate(ids) if known is None]:
                    missing.setdefault(chunks[i], []).append((len(found), i))
            found.append(ids)
        for (chunk, places), ids in zip(missing.items(), self._ids(list(missing))):
            mark = hash(chunk) % MARKS
            if self.once[mark] and len(chunk) <= CACHE_LENGTH and len(cache) < CACHE_CHUNKS:
                cache[chunk] = ids
            self.once[mark] = 1
            for text, i in places:
                found[text][i] = ids
        return [b"".join(ids) for ids in found]


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """One encoder per worker and file."""
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


def planes(ids: np.ndarray, bits: bool) -> list[bytes]:
    """A block's ids transposed: plane k has byte (or bit) k of every id."""
    rows = ids.astype("<u4").view(np.uint8).reshape(-1, 4)
    if not bits:
        return [rows[:, k].tobytes() for k in range(4)]
    return [np.packbits(plane).tobytes() for plane in np.unpackbits(rows, axis=1, bitorder="little").T]


def unplanes(parts: list[bytes], n: int, bits: bool) -> np.ndarray:
    if not bits:
        rows = np.stack([np.frombuffer(p, np.uint8, n) for p in parts], axis=1)
    else:
        rows = np.packbits(np.stack([np.unpackbits(np.frombuffer(p, np.uint8), count=n) for p in parts], axis=1), axis=1, bitorder="little")
    return np.ascontiguousarray(rows).view("<u4").ravel()


class PlaneWriter:
    """Writes blocks of ids as compressed planes, then the chunk index and the document index.

    Layout: magic, plane kind (1 byte: 0 bytes, 1 bits), block size (u4); per block its planes,
    one zstd frame each; chunk index: per block first position (u8), ids (u4), planes (u4) and
    plane lengths (u4 each); document index: n, ids (i8 each), null marks (1 byte each),
    lengths (u8 each), compressed; trailer: offset of the chunk index, of the document index,
    of the trailer, crc32 of both indexes, magic.
    """

    def __init__(self, out, bits: bool = False, block: int = BLOCK_IDS, level: int = 1) -> None:
        self.out, self.bits, self.block, self.at = out, bits, block, 0
        self.zstd = zstandard.ZstdCompressor(level=level)
        self.waiting: list[bytes] = []
        self.held = 0
        self.chunks: list[bytes] = []
        self.ids: list[int | None] = []
        self.lengths: list[int] = []
        self._write(MAGIC + struct.pack("<BI", bits, block))

    def _write(self, data: bytes) -> None:
        self.out.write(data)
        self.at += len(data)

    def _flush(self, whole: bool) -> None:
        data, step = b"".join(self.waiting), self.block * 4
        end = len(data) if whole else len(data) - len(data) % step
        for start in range(0, end, step):
            ids = np.frombuffer(data[start : min(start + step, end)], "<u4")
            parts = [self.zstd.compress(p) for p in planes(ids, self.bits)]
            self.chunks.append(struct.pack(f"<QII{len(parts)}I", self.at, len(ids), len(parts), *map(len, parts)))
            for part in parts:
                self._write(part)
        self.waiting, self.held = [data[end:]], len(data) - end

    def add(self, doc_id: int | None, ids: bytes) -> None:
        self.ids.append(doc_id)
        self.lengths.append(len(ids) // 4)
        self.waiting.append(ids)
        self.held += len(ids)
        if self.held >= self.block * 4:
            self._flush(False)

    def close(self) -> int:
        """Returns the ids written."""
        self._flush(True)
        n, chunk_at = len(self.ids), self.at
        chunk_index = b"".join(self.chunks)
        docs = self.zstd.compress(
            struct.pack("<Q", n) + np.array([i or 0 for i in self.ids], "<i8").tobytes()
            + np.array([i is None for i in self.ids], np.uint8).tobytes() + np.array(self.lengths, "<u8").tobytes()
        )
        self._write(chunk_index)
        doc_at = self.at
        self._write(docs)
        self._write(TRAILER.pack(chunk_at, doc_at, self.at, zlib.crc32(docs, zlib.crc32(chunk_index)), MAGIC))
        self.out.close()
        return sum(self.lengths)


class PlaneReader:
    """Reads what ``PlaneWriter`` has written, block by block, and checks it."""

    def __init__(self, source) -> None:
        self.source = source
        head = source.read(len(MAGIC) + 5)
        size = source.size()
        source.seek(size - TRAILER.size)
        chunk_at, doc_at, end, crc, magic = TRAILER.unpack(source.read(TRAILER.size))
        if head[: len(MAGIC)] != MAGIC or magic != MAGIC or end != size - TRAILER.size:
            raise ValueError("not a finished plane file")
        self.bits, self.block = struct.unpack("<BI", head[len(MAGIC):])
        source.seek(chunk_at)
        index = source.read(doc_at - chunk_at)
        docs = source.read(end - doc_at)
        if zlib.crc32(docs, zlib.crc32(index)) != crc:
            raise ValueError("the index is damaged")
        self.chunks, at = [], 0
        while at < len(index):
            where, n, k = struct.unpack_from("<QII", index, at)
            self.chunks.append((where, n, struct.unpack_from(f"<{k}I", index, at + 16)))
            at += 16 + 4 * k
        raw = zstandard.ZstdDecompressor().decompress(docs)
        (n,) = struct.unpack_from("<Q", raw)
        self.ids = np.frombuffer(raw, "<i8", n, 8)
        self.nulls = np.frombuffer(raw, np.uint8, n, 8 + 8 * n).astype(bool)
        self.lengths = np.frombuffer(raw, "<u8", n, 8 + 9 * n).astype(np.int64)

    def blocks(self, first: int = 0) -> Iterator[np.ndarray]:
        """Ids of each block from block ``first`` on."""
        unzip = zstandard.ZstdDecompressor()
        for where, n, sizes in self.chunks[first:]:
            self.source.seek(where)
            yield unplanes([unzip.decompress(self.source.read(s), max_output_size=4 * self.block + 64) for s in sizes], n, bool(self.bits))

    def documents(self) -> Iterator[tuple[int | None, bytes]]:
        """Id and little-endian ids of each document, in file order; one block is held at a time."""
        blocks, data, at = self.blocks(), b"", 0
        for doc_id, null, n in zip(self.ids.tolist(), self.nulls.tolist(), self.lengths.tolist()):
            parts, need = [], 4 * n
            while need:
                if at == len(data):
                    data, at = next(blocks).tobytes(), 0
                part = data[at : at + need]
                parts.append(part)
                at += len(part)
                need -= len(part)
            yield (None if null else doc_id), b"".join(parts)


def write_ids(
    docs: DataFrame, folder: str, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", end_id: int = 2,
    bits: bool = False, shards: int | None = None,
) -> DataFrame:
    """Encode every whole text and write the ids in ascending id order; returns the manifest.

    Manifest: ``shard, path, n_docs, n_ids``, one row per file; the files in shard order hold
    all documents in ascending id, null ids first, equal ids in the order of a hash of the
    text. Null text counts as empty; every document ends with ``end_id``. Repeated rows are
    written as often as they occur, an empty table gives no files. Other columns are not read.

    Range partitions make the order global without one task seeing more than its slice; each
    task encodes and writes block by block. A repeated task writes another file, and only
    files of successful tasks enter the manifest, which is stored before it is returned.
    """
    check_folder(folder)
    shards = shards or int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), filled(text_col).alias("text"), F.xxhash64(filled(text_col)).alias("tie"))
    rows = rows.repartitionByRange(shards, "doc_id", "tie").sortWithinPartitions("doc_id", "tie").select("doc_id", "text")
    end = struct.pack("<I", end_id)

    def write(batches):
        writer, part = None, TaskContext.get().partitionId()
        for batch in batches:
            if writer is None:
                path, out = new_file(folder, part, "planes")
                writer, code = PlaneWriter(out, bits), encoder(tokenizer)
            for at in range(0, batch.num_rows, GROUP):
                some = batch.slice(at, GROUP)
                for doc_id, ids in zip(some.column(0).to_pylist(), code.encode(some.column(1).to_pylist())):
                    writer.add(doc_id, ids + end)
        if writer is not None:
            n = writer.close()
            yield pa.RecordBatch.from_pydict({"shard": [part], "path": [path], "n_docs": [len(writer.ids)], "n_ids": [n]}, schema=schema)

    schema = pa.schema([("shard", pa.int32()), ("path", pa.string()), ("n_docs", pa.int64()), ("n_ids", pa.int64())])
    return stored(batched(rows).mapInArrow(write, "shard int, path string, n_docs long, n_ids long"), "id-files")


def read_ids(manifest: DataFrame) -> DataFrame:
    """``doc_id, start, n_tokens, ids_crc32`` of every document, from the files alone.

    ``start`` counts the ids of all documents before it: the running sum over files (one row
    each) plus the running sum inside the file.
    """
    before = F.sum("n_ids").over(Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1))
    files = manifest.select("path", F.coalesce(before, F.lit(0)).cast("long").alias("start"))
    n = max(1, min(manifest.count(), 100_000))

    def read(batches):
        for batch in batches:
            for path, start in zip(*(c.to_pylist() for c in batch.columns)):
                rows = []
                with open_file(path) as source:
                    for doc_id, ids in PlaneReader(source).documents():
                        rows.append((doc_id, start, len(ids) // 4, zlib.crc32(ids)))
                        start += len(ids) // 4
                        if len(rows) == 5000:
                            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows)], schema=schema)
                            rows = []
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows)], schema=schema)

    schema = pa.schema([(c, pa.int64()) for c in ("doc_id", "start", "n_tokens", "ids_crc32")])
    return files.repartition(n, "path").mapInArrow(read, "doc_id long, start long, n_tokens long, ids_crc32 long")


def tokenizer_file(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


@query("op9_token_ids")
def op9_token_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_ids(write_ids(table(spark, sf_dir, "documents"), shared_folder(spark, "ids"), tokenizer_file()))
