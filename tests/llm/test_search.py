from __future__ import annotations

import math
import random
import re
from collections import Counter

import pytest

from trigwatch.llm import search
from trigwatch.llm.search import search_documents, terms

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def plain(text):
    return TERM.findall((text or "").translate(LOWER))


def brute(items, docs, k=10):
    held = [(doc_id, Counter(plain(text))) for doc_id, text in docs]
    held = [(d, c, sum(c.values())) for d, c in held if c]
    n_docs, length = len(held), sum(n for *_, n in held)
    df = Counter(t for _, c, _ in held for t in c)
    out = []
    for item_id, text in items:
        scored = []
        for doc_id, tf, n in held:
            m = 25 + 75 * n * n_docs // length
            score = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (10**9 * tf[t] // (1000 * tf[t] + 8 * m)) for t in plain(text) if tf[t])
            if score > 0:
                scored.append((-score, doc_id is None, doc_id or 0, doc_id))
        out += [(item_id, rank, s[3], -s[0]) for rank, s in enumerate(sorted(scored)[:k], 1)]
    return sorted(out, key=str)


def found(spark, items, docs, **settings):
    frame = search_documents(spark.createDataFrame(items, "item_id long, text string"), docs, **settings)
    assert frame.columns == ["item_id", "rank", "doc_id", "score"]
    return sorted((tuple(r) for r in frame.collect()), key=str)


def test_terms():
    for text in ("The CAT's 3 hats_and ÉTÉ-中文 x\x00y", "", " !?", "İ ß z\x7fq"):
        assert [t.decode() for t in terms(text)] == plain(text)
    assert terms(None) == []


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(9)
    words = [f"w{i}" for i in range(40)] + ["É", "The", "THE", "中"]
    docs = [(i, " ".join(rng.choice(words) for _ in range(rng.randint(0, 30)))) for i in range(300)]
    docs += [(i + 1000, docs[i][1]) for i in range(0, 300, 3)]  # equal scores
    items = [(i, " ".join(rng.choice(words) for _ in range(rng.randint(0, 12)))) for i in range(25)]
    return docs, items + [(3, "w1 w1 w2"), (None, "the w5"), (50, None), (51, "--"), (52, "nowhere")]


def test_against_brute_force(spark, make_docs, rows):
    docs, items = rows
    for k in (1, 10):
        assert found(spark, items, make_docs(docs).repartition(7), k=k) == brute(items, docs, k)


def test_index_in_parts(spark, make_docs, rows, monkeypatch):
    docs, items = rows
    monkeypatch.setattr(search, "INDEX_BYTES", 600)
    monkeypatch.setattr(search, "CELLS", 20)
    assert found(spark, items, make_docs(docs).repartition(3)) == brute(items, docs)


def test_odd_rows(spark, make_docs, odd_rows):
    items = [(1, "One two seven"), (1, "one two seven"), (2, "ßÉ 漢字"), (3, "w5 w6 w5"), (4, "x" * 200_000)]
    docs = [r[:2] for r in odd_rows]
    assert found(spark, items, make_docs(odd_rows)) == brute(items, docs)


def test_empty_tables(spark, make_docs):
    assert found(spark, [(1, "a")], make_docs([])) == []
    assert found(spark, [], make_docs([(1, "a")])) == []
    assert found(spark, [(1, "a")], make_docs([(1, None), (2, "--")])) == []
