from __future__ import annotations

import io
import json
import os
import random
import struct
import zlib

import numpy as np
import pytest

from trigwatch.llm.common import shared_folder
from trigwatch.llm.tokens import Encoder, PlaneReader, PlaneWriter, planes, read_ids, tokenizer_file, unplanes, write_ids


@pytest.fixture(scope="module")
def code():
    return Encoder(tokenizer_file())


def whole(code, text):
    return np.array(code.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()


def test_chunks_give_the_same_ids(code):
    rng = random.Random(5)
    alphabet = ["a", "b", " ", "Z", "é", ",", ".", "'", '"', "!", "?", "-", "_", "0", "12", "\n", "\t", "\r", "\x0b", "\x85", "\xa0", "s", "'ll", "'d", "’", "中", "ß", "\x1c", "  ", "***", "<|endoftext|>", "　", "́", "ｆ", "×"]
    texts = ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 14))) for _ in range(6000)]
    for at in range(0, len(texts), 100):
        assert code.encode(texts[at : at + 100]) == [whole(code, t) for t in texts[at : at + 100]]


@pytest.mark.parametrize("change", [
    {"pre_tokenizer": {"type": "ByteLevel", "add_prefix_space": True, "trim_offsets": True, "use_regex": True}},
    {"pre_tokenizer": {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False}},
    {"normalizer": {"type": "Prepend", "prepend": "x"}},
    {"truncation": {"direction": "Right", "max_length": 3, "strategy": "LongestFirst", "stride": 0}},
])
def test_files_that_split_otherwise_are_not_cut(tmp_path, change):
    with open(tokenizer_file(), encoding="utf-8") as file:
        spec = json.load(file) | change
    path = tmp_path / "other.json"
    path.write_text(json.dumps(spec), encoding="utf-8")
    other = Encoder(str(path))
    assert other.by_chunk == ("truncation" in change)
    texts = ["several words, in a row; it's long enough", "a b", "", " x  y\n", "word"] * 2
    assert other.encode(texts) == [whole(other, t) for t in texts] and len(other.encode(texts[:1])[0]) > 12


def test_file_of_word_ends():
    other = Encoder(os.path.join(os.path.dirname(tokenizer_file()), "word_bpe_49k.json"))
    texts = ["Several Words, in a row; it's long", "a  b\n", "", "é中 x"]
    assert not other.by_chunk and other.encode(texts) == [whole(other, t) for t in texts]


class Kept(io.BytesIO):
    def close(self):
        pass

    def size(self):
        return len(self.getvalue())


@pytest.mark.parametrize("bits", [False, True])
@pytest.mark.parametrize("block", [1, 7, 1 << 16])
def test_file_round_trip(bits, block):
    rng = np.random.default_rng(1)
    docs = [(i if i % 5 else None, rng.integers(0, 2**32, int(rng.integers(0, 40)), dtype=np.uint32).astype("<u4").tobytes()) for i in range(50)]
    out = Kept()
    writer = PlaneWriter(out, bits, block)
    for doc_id, ids in docs:
        writer.add(doc_id, ids)
    assert writer.close() == sum(len(ids) for _, ids in docs) // 4
    out.seek(0)
    assert list(PlaneReader(out).documents()) == docs
    every = np.frombuffer(b"".join(ids for _, ids in docs), "<u4")
    out.seek(0)
    reader = PlaneReader(out)
    assert len(reader.chunks) == -(-len(every) // block)
    if len(reader.chunks) > 2:  # the index finds a block in the middle
        assert (next(reader.blocks(2)) == every[2 * block : 3 * block]).all()


def test_planes():
    ids = np.array([1, 256, 2**32 - 1, 50256, 0], "<u4")
    assert planes(ids, False)[0] == bytes([1, 0, 255, 80, 0])
    assert planes(ids, True)[0] == bytes([0b10100000])
    for bits in (False, True):
        assert (unplanes(planes(ids, bits), len(ids), bits) == ids).all()


def test_damage_is_found():
    out = Kept()
    writer = PlaneWriter(out)
    writer.add(1, b"\x01\0\0\0" * 9)
    writer.close()
    data = bytearray(out.getvalue())
    with pytest.raises(Exception):
        PlaneReader(Kept(bytes(data[:-1])))
    data[-40] ^= 255
    with pytest.raises(ValueError):
        PlaneReader(Kept(bytes(data)))


def brute(code, rows):
    """Per document in ascending id, null first: ids of the text and the end id."""
    out, start = [], 0
    for doc_id, text in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)):
        ids = whole(code, text or "") + struct.pack("<I", 2)
        out.append((doc_id, start, len(ids) // 4, zlib.crc32(ids)))
        start += len(ids) // 4
    return out


def test_query(spark, make_docs, code):
    rng = random.Random(2)
    rows = [(i * 11 % 301, " ".join(rng.choice(["alpha", "Beta,", "don't", "é\xa0x", "\n\n"]) for _ in range(rng.randint(0, 50)))) for i in range(301)]
    for bits in (False, True):
        manifest = write_ids(make_docs(rows).repartition(5), shared_folder(spark, "ids"), tokenizer_file(), bits=bits)
        assert sorted(tuple(r) for r in read_ids(manifest).collect()) == brute(code, rows)


def test_odd_rows(spark, make_docs, odd_rows, code):
    manifest = write_ids(make_docs(odd_rows), shared_folder(spark, "ids"), tokenizer_file())
    got = [tuple(r) for r in read_ids(manifest).collect()]
    rows = [r[:2] for r in odd_rows]
    assert sorted(str((d, n, c)) for d, _, n, c in got) == sorted(str((d, n, c)) for d, _, n, c in brute(code, rows))
    got.sort(key=lambda r: r[1])
    assert [r[0] for r in got] == [r[0] for r in brute(code, rows)]  # ascending ids, null first
    assert all(a[1] + a[2] == b[1] for a, b in zip(got, got[1:]))


def test_empty_table(spark, make_docs):
    manifest = write_ids(make_docs([]), shared_folder(spark, "ids"), tokenizer_file())
    assert manifest.count() == 0 and read_ids(manifest).count() == 0
