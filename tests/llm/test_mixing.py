from __future__ import annotations

import hashlib
import random
import re
from collections import defaultdict

import pytest

from trigwatch.llm.mixing import mix, mixed


def size_of(text):
    return len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))


def brute_targets(sizes, weights=(5, 2, 1), cap=2):
    """Share by weight, stop at the cap, share the excess again until none is above."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    left, open_, target = 1.5 * sum(sizes.values()), list(order), {}
    while open_:
        part = left / sum(weight[s] for s in open_)
        over = [s for s in open_ if weight[s] * part >= cap * sizes[s]]
        if not over:
            target |= {s: weight[s] * part for s in open_}
            break
        for s in over:
            target[s] = float(cap * sizes[s])
            left -= target[s]
            open_.remove(s)
    return target


def brute(rows):
    sized = [(r[0], r[3], size_of(r[1])) for r in rows]
    sizes = defaultdict(int)
    for _, source, n in sized:
        sizes[source] += n
    target, out = brute_targets(sizes), []
    for source in sizes:
        mine = [(i, n) for i, s, n in sized if s == source]
        mine.sort(key=lambda r: (hashlib.md5(f"mix{'' if r[0] is None else r[0]}".encode()).hexdigest(), r[0] is not None, r[0] or 0, r[1]))
        budget = int(target[source] + 0.5)
        passes = budget // sizes[source] if sizes[source] else 0
        rest = budget - passes * sizes[source]
        for i, n in mine:
            last = max(0, min(n, rest))
            rest -= last
            out.append((i, n, sizes[source], round(target[source], 6), passes * n + last))
    return sorted(out, key=str)


def taken(frame):
    return sorted(((r.doc_id, r["size"], r.source_size, round(r.target, 6), r.taken) for r in frame.collect()), key=str)


def test_odd_rows(make_docs, odd_rows):
    assert taken(mix(make_docs(odd_rows))) == brute(odd_rows)


@pytest.mark.parametrize("seed", range(3))
def test_random_sources(make_docs, seed):
    rng = random.Random(seed)
    rows = [(i, " ".join("w" * rng.randint(1, 3) for _ in range(rng.randint(0, 30))), "en", rng.choice(["a", "a", "a", "b", "c", "ä", None, "", "z"])) for i in range(300)]
    got = taken(mix(make_docs(rows)))
    assert got == brute(rows)
    per, source, target = defaultdict(int), {r[0]: r[3] for r in rows}, {}
    for i, n, _, t, k in got:
        assert 0 <= k <= 2 * n
        per[source[i]] += k
        target[source[i]] = t
    assert all(abs(per[s] - target[s]) <= 0.51 for s in per)


def test_reruns_agree(make_docs):
    rows = [(i, "a b c " * (i % 5), "en", f"s{i % 4}") for i in range(100)]
    assert taken(mix(make_docs(rows).repartition(3))) == taken(mix(make_docs(rows).repartition(8)))


def test_empty_table(make_docs):
    assert mix(make_docs([])).count() == 0
    assert mixed(make_docs([])).count() == 0


def test_rejects_bad_settings(make_docs):
    with pytest.raises(ValueError):
        mix(make_docs([]), weights=(1, 0))
    with pytest.raises(ValueError):
        mix(make_docs([]), share=(5, 2))


def test_rows_of_the_mix(make_docs):
    rows = [(i, " ".join(f"d{i}w{j}" for j in range(1 + i % 7)) + " ", "en", "abc"[i % 3]) for i in range(60)]
    docs = make_docs(rows)
    want = {r.doc_id: r.taken for r in mix(docs).collect()}
    out = mixed(docs)
    assert out.columns == docs.columns
    got, texts = defaultdict(int), dict((r[0], r[1]) for r in rows)
    for r in out.collect():
        got[r.doc_id] += size_of(r.text)
        assert texts[r.doc_id].startswith(r.text) and r.n_chars == len(r.text)
    assert {k: v for k, v in want.items() if v} == dict(got)


def test_long_cut(make_docs):
    rows = [(1, " ".join(f"w{j}" for j in range(50_000)), "en", "a"), (2, "x y z", "en", "b")]
    words = {r.doc_id: r.taken for r in mix(make_docs(rows)).collect()}
    got = defaultdict(int)
    for r in mixed(make_docs(rows)).collect():
        got[r.doc_id] += size_of(r.text)
    assert dict(got) == words


def dealt(docs):
    got = defaultdict(int)
    for r in mixed(docs).collect():
        got[r.source, r.doc_id] += size_of(r.text)
    return dict(got)


@pytest.mark.parametrize("ids", [None, 7])
def test_equal_rows_keep_to_their_sources(make_docs, ids):
    text = " ".join(f"w{j}" for j in range(20))
    rows = [(ids, text, "en", "a")] * 100 + [(ids, text, "en", "b")] * 100 + [(ids, text, "en", None)] * 3
    rows += [(1000 + i, "x y z " * (1 + i % 5), "en", "b") for i in range(400)]
    docs = make_docs(rows).repartition(5)
    want = defaultdict(int)
    for r in mix(docs).collect():
        want[r.source, r.doc_id] += r.taken
    assert dealt(docs) == {k: v for k, v in want.items() if v}
    per = defaultdict(list)
    for r in mixed(docs).where("doc_id IS NULL OR doc_id = 7").collect():
        per[r.source].append(size_of(r.text))
    assert all(sum(n != 20 for n in sizes) <= 1 for sizes in per.values())  # whole texts, and one cut
