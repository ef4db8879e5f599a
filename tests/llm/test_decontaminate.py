from __future__ import annotations

import random

import numpy as np

from trigwatch.llm.decontaminate import EDITS, Finder, Walks, allowed, best_place, clean, edited, leaks, padded
from trigwatch.llm.wordhash import MARKS, words


def prose(rng, n):
    return [rng.choice(["the", "of", "and"]) if rng.random() < 0.3 else f"w{rng.randrange(800)}" for _ in range(n)]


def plain_distance(item, text):
    """Least word edits between the item and any stretch of the text."""
    row = [0] * (len(text) + 1)
    for x in item:
        new = [row[0] + 1]
        for j, y in enumerate(text):
            new.append(min(row[j] + (x != y), row[j + 1] + 1, new[j] + 1))
        row = new
    return min(row)


def hashed(text):
    return words(text, MARKS).tolist()


def corpus(seed):
    rng = random.Random(seed)
    items = [(i, " ".join(prose(rng, rng.randint(12, 45)))) for i in range(25)]
    rows = []
    for i in range(90):
        w = prose(rng, rng.randint(0, 150))
        if i % 2:
            item = rng.choice(items)[1].split()
            for _ in range(rng.randint(0, allowed(len(item)))):
                at, kind = rng.randrange(len(item)), rng.random()
                if kind < 0.4:
                    item[at] = f"x{rng.randrange(10**6)}"
                elif kind < 0.7:
                    item.insert(at, f"y{rng.randrange(10**6)}")
                else:
                    del item[at]
            at = rng.randint(0, len(w))
            w[at:at] = [x.upper() if rng.random() < 0.2 else x for x in item]
        rows.append((i, rng.choice([" ", ", ", "\n"]).join(w)))
    return items, rows


def brute(items, rows):
    out = {}
    for doc_id, text in rows:
        for item_id, item in items:
            a = hashed(item or "")
            d = plain_distance(a, hashed(text or "")) if a else None
            if d is not None and d <= EDITS * len(a):
                out[doc_id, item_id] = d
    return out


def test_recall_and_distances_against_brute_force(spark, make_docs):
    want, got = {}, {}
    for seed in range(4):
        items, rows = corpus(seed)
        frame = spark.createDataFrame(items, "item_id long, text string").withColumnRenamed("text", "body")
        for r in leaks(make_docs(rows), frame, item_text="body").collect():
            got[seed, r.doc_id, r.item_id] = r.distance
        want |= {(seed, *k): v for k, v in brute(items, rows).items()}
    assert set(got) <= set(want)  # every row is a true match
    assert len(got) >= 0.95 * len(want) and len(want) > 150
    assert all(k in got for k, d in want.items() if d == 0)
    assert all(got[k] >= want[k] for k in got) and np.mean([got[k] == want[k] for k in got]) > 0.95


def test_clean_drops_just_those(spark, make_docs):
    items, rows = corpus(7)
    docs, frame = make_docs(rows), spark.createDataFrame(items, "item_id long, text string")
    out = clean(docs, frame)
    assert out.columns == docs.columns
    found = {r.doc_id for r in leaks(docs, frame).collect()}
    assert {r.doc_id for r in out.collect()} == {i for i, _ in rows} - found


def test_odd_rows(spark, make_docs, odd_rows):
    items = [(1, "four five, SIX seven eight"), (1, "four five, SIX seven eight"), (2, None), (3, ""), (4, "..."), (None, "another text of the same id"), (5, "another text of"), (6, " ".join(f"w{i % 977}" for i in range(700, 760)))]
    out = leaks(make_docs(odd_rows), spark.createDataFrame(items, "item_id long, text string")).collect()
    found = sorted(str((r.doc_id, r.item_id, r.distance)) for r in out)
    assert found == sorted(map(str, [(1, 1, 0), (1, 1, 0), (2, 1, 0), (None, 1, 0), (8, None, 0), (6, 6, 0)]))


def test_empty_tables(spark, make_docs):
    none = spark.createDataFrame([], "item_id long, text string")
    assert leaks(make_docs([]), none).count() == 0
    assert leaks(make_docs([(1, "a b c")]), none).count() == 0
    assert clean(make_docs([(1, "a b c")]), none).count() == 1


def test_blocks_of_items(spark, make_docs, monkeypatch):
    items, rows = corpus(3)
    frame, docs = spark.createDataFrame(items, "item_id long, text string"), make_docs(rows)
    one = {(r.doc_id, r.item_id) for r in leaks(docs, frame).collect()}
    monkeypatch.setattr("trigwatch.llm.decontaminate.BLOCK_ITEMS", 10)
    assert len(one ^ {(r.doc_id, r.item_id) for r in leaks(docs, frame).collect()}) <= 0.05 * len(one)


def test_walks_keep_near_texts_together():
    rng = np.random.default_rng(1)
    item = rng.integers(1, 1 << 62, 40).astype(np.uint64)
    walks = Walks(40, 400, 3)
    start = np.zeros(1, np.int64)

    def share(other):
        return float((walks.signatures(padded(item, start, 40)) == walks.signatures(padded(other, start, 40))).mean())

    one, many = np.mean([share(edited(item, 1, rng)) for _ in range(20)]), np.mean([share(edited(item, 8, rng)) for _ in range(20)])
    assert share(item) == 1 and one > 0.5 > many > 0.02
    assert share(rng.integers(1, 1 << 62, 40).astype(np.uint64)) < 0.02


def test_best_place():
    rng = random.Random(2)
    for _ in range(300):
        a, b = ([rng.randrange(4) for _ in range(rng.randint(1, 8))] for _ in range(2))
        assert best_place(np.array(a), np.array(b))[0] == plain_distance(a, b)
    assert best_place(np.array([5, 6]), np.array([1, 5, 6, 5, 6])) == (0, 1)


def test_windows_skip_no_match():
    for seed in range(5):
        items, rows = corpus(seed)
        finder = Finder(items)
        for (doc_id, item_id), d in brute(items, rows).items():
            n = len(hashed(dict(items)[item_id]))
            assert n in {length for length, _ in finder.windows(words(rows[doc_id][1], MARKS))}, (doc_id, item_id, d)


def test_long_items_at_the_edit_limit():
    rng = np.random.default_rng(11)
    for n in (61, 150, 400):
        items = [(i, " ".join(f"w{x}" for x in rng.integers(0, 5000, n))) for i in range(5)]
        finder, texts, want = Finder(items), [], []
        for item_id, item in items:
            for _ in range(8):
                w = item.split()
                for kind in rng.integers(0, 3, allowed(n)):
                    at, new = int(rng.integers(0, len(w))), f"x{rng.integers(0, 1 << 40)}"
                    w[at : at + int(kind != 1)] = [new] * int(kind < 2)
                around = [f"w{x}" for x in rng.integers(0, 5000, 80)]
                texts.append(" ".join(around[:40] + w + around[40:]))
                want.append(item_id)
        got = {(number, item_id): distance for number, item_id, distance, _ in finder.matches(texts)}
        assert set(got) <= set(enumerate(want))
        assert len(got) >= 0.95 * len(want), (n, len(got))
        for number in range(0, len(texts), 9):
            if (number, want[number]) in got:
                assert got[number, want[number]] == plain_distance(hashed(items[want[number]][1]), hashed(texts[number]))
