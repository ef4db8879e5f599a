"""The registered queries on the small tables: against SQL, or against brute force on whole tables."""

from __future__ import annotations

import hashlib
import struct
import zlib

import numpy as np
import pytest

from oracle_check import compare

from trigwatch.llm import load_llm

SF = "/root/testdata/sf0.001"
QUERIES, ORACLES = load_llm()


def table(spark, name):
    return [tuple(r) for r in spark.read.parquet(f"{SF}/{name}.parquet").collect()]


def texts(spark):
    return {r.doc_id: r.text or "" for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}


def test_every_operator_is_registered():
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES if n.startswith("op")) == list(range(1, 14))
    assert "pipeline" in QUERIES and set(ORACLES) < set(QUERIES)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_against_sql(spark, duck, name):
    assert compare(QUERIES[name](spark, SF), duck, ORACLES[name]) is None


@pytest.mark.parametrize("name,label,fold,rest,cut", [("op1_quality", 1, 5, 0, 0.3), ("op8_toxicity", 2, 3, 1, 0.7)])
def test_classifiers(spark, name, label, fold, rest, cut):
    out = QUERIES[name](spark, SF).collect()
    known = {r[0]: r[label] for r in table(spark, "labels")}
    assert sorted(r.doc_id for r in out) == sorted(texts(spark))
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % fold == rest) for r in out)
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= cut) for r in out)
    held = [r for r in out if r.held_out and r.doc_id in known]
    good, bad = ([r.score for r in held if known[r.doc_id] == y] for y in (1, 0))
    assert np.median(good) > np.median(bad)


def test_secrets_and_personal_data(spark):
    from llm.test_pii import brute as personal
    from llm.test_pii import joined as personal_text
    from llm.test_secrets import brute as secrets
    from llm.test_secrets import joined as secret_text

    all_ = texts(spark)
    for name, brute, joined in (("op3_secrets", secrets, secret_text), ("op5_pii", personal, personal_text)):
        out = QUERIES[name](spark, SF).collect()
        assert len(out) == len(all_)
        assert all(r.base_sha256 == hashlib.sha256(joined(brute(all_[r.doc_id])).encode()).hexdigest() for r in out)


def test_token_ids(spark):
    from trigwatch.llm.tokens import encoder, tokenizer_file

    tokenizer, start, all_ = encoder(tokenizer_file()).tokenizer, 0, texts(spark)
    out = {r.doc_id: r for r in QUERIES["op9_token_ids"](spark, SF).collect()}
    assert sorted(out) == sorted(all_)
    for doc_id in sorted(all_):
        ids = np.array(tokenizer.encode(all_[doc_id], add_special_tokens=False).ids, "<u4").tobytes() + struct.pack("<I", 2)
        assert (out[doc_id].start, out[doc_id].n_tokens, out[doc_id].ids_crc32) == (start, len(ids) // 4, zlib.crc32(ids))
        start += len(ids) // 4


def test_leaks(spark):
    from llm.test_decontaminate import hashed, plain_distance

    from trigwatch.llm.decontaminate import EDITS

    items = {i: hashed(t) for i, t in table(spark, "benchmark")}
    got = {(r.doc_id, r.item_id): r.distance for r in QUERIES["op10_decontaminate"](spark, SF).collect()}
    want = {}
    for doc_id, text in texts(spark).items():
        words = hashed(text)
        some = set(words)
        for item_id, item in items.items():
            if len(some.intersection(item)) >= len(set(item)) - EDITS * len(item):  # else too many words are missing
                d = plain_distance(item, words)
                if d <= EDITS * len(item):
                    want[doc_id, item_id] = d
    assert got == want and len(want) >= 3
