from __future__ import annotations

import hashlib
import random

import numpy as np
import pytest

from trigwatch.llm import bpe
from trigwatch.llm.bpe import Codec, decode_ids, encode_texts, forced_cuts, op13_bpe
from trigwatch.llm.tokens import tokenizer_file


@pytest.fixture(scope="module")
def code():
    return Codec(tokenizer_file())


def whole(code, text):
    return code.tokenizer.encode(text, add_special_tokens=False).ids


def ids(code, texts):
    return [np.frombuffer(found, np.uint32).tolist() for found in code.encode(texts)]


def test_forced_cuts():
    cut = forced_cuts([b"ab", b"bca", b"d"])
    assert [(a, b) for a in b"abcd" for b in b"abcd" if not cut[a, b]] == [(97, 98), (98, 99), (99, 97)]


def test_no_token_crosses_a_cut(code):
    cut = code.cuts[0].reshape(256, 256)
    for piece in code.pieces[:50256]:
        assert not any(cut[a, b] for a, b in zip(piece, piece[1:]))
    assert len(list(code.fragments("one two, three"))[0]) >= 3


SIGNS = ["a", "b", " ", "Z", "é", ",", ".", "'", '"', "!", "-", "_", "0", "12", "\n", "\t", "\r", "\x0b", "\x85", "\xa0", "s", "'ll", "'d", "re", "’", "中", "ß", "\x1c", "\x00", "  ", "***", "<|endoftext|>", "　", "́", "ｆ", "×", " ", "᠎", "​", "﻿", "\U0001f600", "٣", "Ⅷ", "ǅ", "\xad"]


def test_fragments_give_the_same_ids(code):
    rng = random.Random(3)
    texts = ["".join(rng.choice(SIGNS) for _ in range(rng.randint(0, 16))) for _ in range(5000)]
    texts += ["".join(chr(rng.choice([rng.randint(0, 0x2FF), rng.randint(0x300, 0xD7FF), rng.randint(0xE000, 0x1FFFF)])) for _ in range(30)) for _ in range(2000)]
    for at in range(0, len(texts), 50):
        some = texts[at : at + 50]
        assert ids(code, some) == [whole(code, t) for t in some]


def test_decoding_any_ids(code):
    rng = random.Random(4)
    for _ in range(2000):
        some = [rng.randint(0, 50256) for _ in range(rng.randint(0, 8))]
        assert code.decode(some) == code.tokenizer.decode(some, skip_special_tokens=False)


def test_long_texts_go_slab_by_slab(code, monkeypatch):
    rng = random.Random(6)
    text = "".join(rng.choice(SIGNS[:30]) for _ in range(3000)) + "x" * 500
    for slab in (1, 7, 64, 1000):
        monkeypatch.setattr(bpe, "SLAB", slab)
        parts = [f for some in code.fragments(text) for f in some]
        assert b"".join(parts) == text.encode()
        assert ids(code, [text]) == [whole(code, text)]


def test_other_files_are_encoded_whole():
    other = Codec(tokenizer_file("word_bpe_49k.json"))
    assert other.cuts is None
    for text in ("One two  THREE", "", "é 中"):
        assert ids(other, [text]) == [whole(other, text)]
        assert other.decode(whole(other, text)) == other.tokenizer.decode(whole(other, text), skip_special_tokens=False)


def test_odd_rows(spark, make_docs, odd_rows, code):
    docs = make_docs(odd_rows)
    encoded = encode_texts(docs, tokenizer_file(), keep=("doc_id", "node"), ids_col="n")
    out = decode_ids(encoded, tokenizer_file(), "n", "text")
    assert out.columns == ["doc_id", "node", "n", "text"]
    got = sorted((str(r.doc_id), list(r.n), r.text) for r in out.collect())
    assert got == sorted((str(d), whole(code, t or ""), t or "") for d, t, *_ in (tuple(r) + (None,) for r in odd_rows))
    assert decode_ids(encode_texts(make_docs([]), tokenizer_file()), tokenizer_file()).count() == 0


def test_null_and_unknown_ids(spark, code):
    rows = spark.createDataFrame([(1, [64, None, 65]), (2, None), (3, []), (4, [64, 10**6, 65])], "doc_id int, ids array<int>")
    got = {r.doc_id: r.decoded for r in decode_ids(rows, tokenizer_file()).collect()}
    want = code.tokenizer.decode([64, 65], skip_special_tokens=False)
    assert got == {1: want, 2: "", 3: "", 4: want}


def test_query(spark, code):
    sf = "/root/testdata/sf0.001"
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    got = op13_bpe(spark, sf).collect()
    assert sorted(r.doc_id for r in got) == sorted(texts)
    for r in got:
        found = whole(code, texts[r.doc_id])
        back = code.tokenizer.decode(found, skip_special_tokens=False)
        sha = [hashlib.sha256(t.encode()).hexdigest() for t in (",".join(map(str, found)), back)]
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(found), *sha)
