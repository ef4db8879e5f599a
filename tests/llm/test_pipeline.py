from __future__ import annotations

import random
import struct
import zlib
from collections import Counter

import numpy as np
import pytest
from llm.test_decontaminate import hashed, plain_distance
from llm.test_jaccard import shingle_set
from llm.test_mixing import brute as mixed_words

import corpus_pipeline
from trigwatch.llm.decontaminate import EDITS
from trigwatch.llm.labelled import remainder
from trigwatch.llm.quality import fit_quality
from trigwatch.llm.tokens import encoder, tokenizer_file


def prose(rng, n):
    return [rng.choice(["an", "ter", "ing", "re", "on"]) + rng.choice(["an", "tion", "ble", "s", "ly"]) + str(rng.randrange(40)) for _ in range(n)]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """Documents with junk, near copies and benchmark passages; rows are (doc_id, text, lang, source, n_chars)."""
    rng, rows = random.Random(8), []
    items = [(i, " ".join(prose(rng, 25))) for i in range(5)]
    for i in range(150):
        w = prose(rng, rng.randint(20, 120))
        kind = i % 6
        if kind == 0:
            w = [x.upper() + "!!" for x in w]
        elif kind == 1 and i > 6:
            w = rows[i - 5][1].split()
            w[len(w) // 2] = "changed"
        elif kind == 2 and i % 4 == 0:
            w[5:5] = items[i % 5][1].split()
        text = " ".join(w)
        rows.append((i, text, "en", f"s{i % 3}", len(text)))
    rows += [(200, None, None, None, None), (201, "", "en", "s0", 0), (202, "same words here as there", "en", "s0", 24), (202, "same words here as there", "en", "s0", 24)]
    place = tmp_path_factory.mktemp("corpus")
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars int")
    docs.write.parquet(f"{place}/documents.parquet")
    spark.createDataFrame([(i, int(i % 6 != 0), 0) for i in range(150)], "doc_id long, quality int, toxic int").write.parquet(f"{place}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{place}/benchmark.parquet")
    return str(place), rows, items


def brute_quality(spark, rows, place):
    docs = spark.read.parquet(f"{place}/documents.parquet")
    model = fit_quality(docs, spark.read.parquet(f"{place}/labels.parquet"), remainder("doc_id", 5) != 0)
    return [r for r in rows if model.score(r[1] or "") >= 0.3]


def brute_groups(rows):
    """One row of each group of rows that share 0.8 of their 5-word shingles; rows without words stay."""
    sets, group = [shingle_set(r[1], 5) for r in rows], list(range(len(rows)))

    def find(i):
        while group[i] != i:
            i = group[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 10 * both >= 8 * len(sets[i] | sets[j]):
                group[find(i)] = find(j)
    kept, seen = [], set()
    for i in sorted(range(len(rows)), key=lambda i: rows[i][0]):
        if not sets[i] or find(i) not in seen:
            seen.add(find(i))
            kept.append(rows[i])
    return kept


def brute_leaks(rows, items):
    def leaky(text):
        return any(plain_distance(hashed(t), hashed(text or "")) <= EDITS * len(hashed(t)) for _, t in items)

    return [r for r in rows if not leaky(r[1])]


def brute_mix(rows):
    out = []
    taken = {i: (n, k) for i, n, _, _, k in mixed_words([r[:4] for r in rows])}
    for r in rows:
        n, k = taken[r[0]]
        for words in [n] * (k // n) + [k % n] * (k % n > 0) if n else []:
            text = r[1] if words == n else " ".join(r[1].split(" ")[:words])
            out.append((r[0], text, r[2], r[3], len(text)))
    return out


def stage(spark, name, rows, place):
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars int")
    out = dict(corpus_pipeline.STAGES)[name](spark, docs, place)
    assert out.columns == docs.columns
    return Counter(tuple(r) for r in out.collect())


def test_stages_against_brute_force(spark, folder):
    place, rows, items = folder
    good = brute_quality(spark, rows, place)
    assert Counter(good) == stage(spark, "quality", rows, place)
    assert 100 < len(good) < len(rows)
    single = brute_groups(rows)
    assert Counter(single) == stage(spark, "near_duplicates", rows, place)
    assert len(single) < len(rows) - 10
    clean = brute_leaks(rows, items)
    assert Counter(clean) == stage(spark, "decontaminate", rows, place)
    assert len(clean) < len(rows) - 5
    unique = [r for r in rows if r[0] != 202]
    assert Counter(brute_mix(unique)) == stage(spark, "mix_sources", unique, place)


def test_run(spark, folder):
    place, rows, items = folder
    final = brute_mix(brute_leaks(brute_groups(brute_quality(spark, rows, place)), items))
    tokenizer = encoder(tokenizer_file()).tokenizer
    want = Counter()
    for doc_id, text, *_ in final:
        ids = np.array(tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes() + struct.pack("<I", 2)
        want[doc_id, len(ids) // 4, zlib.crc32(ids)] += 1
    out = corpus_pipeline.run(spark, place).collect()
    assert Counter((r.doc_id, r.n_tokens, r.ids_crc32) for r in out) == want
    out.sort(key=lambda r: r.start)
    assert [r.doc_id for r in out] == sorted(r.doc_id for r in out)
    assert all(a.start + a.n_tokens == b.start for a, b in zip(out, out[1:]))


def test_odd_rows(spark, make_docs, odd_rows, folder):
    docs = make_docs(odd_rows)
    for name, call in corpus_pipeline.STAGES:
        out = call(spark, docs, folder[0])
        assert out.count() <= 2 * len(odd_rows)
        if name != "token_ids":
            assert out.columns == docs.columns
        assert call(spark, make_docs([]), folder[0]).count() == 0
