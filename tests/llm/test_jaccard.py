from __future__ import annotations

import random
from collections import defaultdict

import numpy as np
import pytest

from trigwatch.llm import jaccard
from trigwatch.llm.common import Scratch
from trigwatch.llm.graph import components
from trigwatch.llm.jaccard import choose_matches, needed, one_per_group, similar_groups
from trigwatch.llm.wordhash import MARKS, located_words, shingles, word_heads, words


def word_list(text):
    return (text or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")).encode("utf-8", "surrogatepass").split()


def shingle_set(text, k):
    w = word_list(text)
    return set() if not w else {tuple(w)} if len(w) < k else {tuple(w[i : i + k]) for i in range(len(w) - k + 1)}


def brute(rows, k, percent):
    sets = [shingle_set(t, k) for _, t in rows]
    parent = list(range(len(rows)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= percent * len(sets[i] | sets[j]):
                parent[find(i)] = find(j)
    ids = defaultdict(list)
    for i, (doc_id, _) in enumerate(rows):
        ids[find(i)].append(doc_id)
    out = []
    for i, (doc_id, _) in enumerate(rows):
        known = [x for x in ids[find(i)] if x is not None]
        out.append((doc_id, len(sets[i]), doc_id if not sets[i] else min(known, default=None)))
    return sorted(map(str, out))


def got(frame):
    return sorted(str((r.doc_id, r.n_shingles, r.component_id)) for r in frame.select("doc_id", "n_shingles", "component_id").collect())


def corpus(seed, n=160):
    """Random prose with near copies, chains of edits, a passage and a line that many share."""
    rng = random.Random(seed)
    vocabulary = [f"v{i}" for i in range(400)]
    passage = [rng.choice(vocabulary) for _ in range(60)]
    texts = []
    for i in range(n):
        kind = rng.random()
        if texts and kind < 0.5:
            w = list(rng.choice(texts[-20:]))
            for _ in range(rng.randint(0, 3)):
                w[rng.randrange(len(w))] = rng.choice(vocabulary) + rng.choice(["", "x"])
        elif kind < 0.7:
            w = [rng.choice(vocabulary) for _ in range(rng.randint(1, 60))] + passage
        else:
            w = [rng.choice(vocabulary[:40] if kind < 0.8 else vocabulary) for _ in range(rng.randint(1, 90))]
        texts.append(w)
    return [(i * 3, rng.choice([" ", "\n", "  "]).join(w)) for i, w in enumerate(texts)]


@pytest.mark.parametrize("k,percent", [(4, 85), (5, 80)])
def test_against_all_pairs(make_docs, k, percent):
    rows = corpus(k)
    assert got(similar_groups(make_docs(rows).repartition(3), k=k, percent=percent)) == brute(rows, k, percent)


def test_group_of_many_near_copies(make_docs):
    """One large group of edited copies and of exact copies, beside texts that hold most of it."""
    rng = random.Random(9)
    base = [f"b{i}" for i in range(80)]
    rows = []
    for i in range(220):
        w = list(base)
        for _ in range(rng.randint(0, 5)):
            w[rng.randrange(len(w))] = f"e{rng.randrange(10**6)}"
        rows.append((i, " ".join(w)))
    rows += [(300 + i, " ".join(base)) for i in range(120)] + [(500 + i, " ".join(base[:50] + [f"o{i}_{j}" for j in range(30)])) for i in range(30)]
    assert got(similar_groups(make_docs(rows), k=4, percent=85)) == brute(rows, 4, 85)


def test_no_star_rounds(make_docs, monkeypatch):
    monkeypatch.setattr(jaccard, "STAR_ROUNDS", 0)
    rows = corpus(3, 80)
    assert got(similar_groups(make_docs(rows), k=4, percent=85)) == brute(rows, 4, 85)


def test_odd_rows(make_docs, odd_rows):
    assert got(similar_groups(make_docs(odd_rows), k=4, percent=85)) == brute([r[:2] for r in odd_rows], 4, 85)


def test_empty_table_and_no_links(make_docs):
    assert similar_groups(make_docs([])).count() == 0
    rows = [(1, "a b c d e f"), (2, "g h i j k l"), (3, None)]
    assert got(similar_groups(make_docs(rows))) == brute(rows, 5, 80)


def test_one_row_of_each_group_stays(make_docs, odd_rows):
    docs = make_docs(odd_rows)
    out = one_per_group(docs)
    assert out.columns == docs.columns
    kept = sorted(str((r.doc_id, r.text)[0]) for r in out.collect())
    # the three equal texts leave id 1, once; texts without words all stay; both texts of id 8 are different
    assert kept == sorted(map(str, [1, 3, 4, 5, 6, None, 7, 8, 8]))


def test_components(spark):
    rng = random.Random(1)
    for edges in ([(i, i + 1) for i in range(40)] + [(50, i) for i in range(51, 90)] + [(100 + rng.randrange(60), 100 + rng.randrange(60)) for _ in range(40)],):
        parent = {v: v for e in edges for v in e}
        for _ in range(len(parent)):
            for a, b in edges:
                parent[a] = parent[b] = min(parent[a], parent[b])
        want = {v: p for v, p in parent.items() if any(v in e for e in edges if e[0] != e[1])}
        out = components(spark.createDataFrame(edges, "a long, b long"), Scratch(spark, "graph")).collect()
        assert len(out) == len(want) and {r.node: r.comp for r in out} == want


def test_matches_asked_grow_with_cost():
    cheap, dear = np.full(60, 0.1), np.full(60, 5000.0)
    dear[:10] = 0.1
    assert choose_matches(np.r_[5000.0, np.full(59, 0.1)], 100, 85) > 1  # dear tokens, cheap ones to add
    assert choose_matches(cheap, 4, 85) <= needed(4, 85)
    assert 1 <= choose_matches(dear, 100, 85) <= 8


def test_word_hashes():
    for text in ("", " ", "a", "A b\tc\x0bD\x0c é É x ", "ab " * 5, "\ud800 x"):
        w, want = words(text), word_list(text)
        assert len(w) == len(want)
        assert all((w[i] == w[j]) == (want[i] == want[j]) for i in range(len(w)) for j in range(len(w)))


def test_long_texts_are_hashed_in_pieces(monkeypatch):
    text = " ".join(f"word{i}" for i in range(3000)) + " " + "y" * 500
    whole = located_words(text, MARKS)
    heads = word_heads(text, MARKS, (4, 5))
    monkeypatch.setattr("trigwatch.llm.wordhash.PIECE_BYTES", 64)
    assert all((a == b).all() for a, b in zip(whole, located_words(text, MARKS)))
    assert all((a == b).all() for a, b in zip(heads, word_heads(text, MARKS, (4, 5))))
    assert len(shingles(words("a b a b a b a b"), 4)) == 2
