from __future__ import annotations

import hashlib
import tracemalloc
from collections import Counter, defaultdict

from hypothesis import given, settings
from hypothesis import strategies as st

from trigwatch.llm.common import Scratch
from trigwatch.llm.exact import Trie, exact_groups


def brute(rows):
    groups = defaultdict(list)
    for doc_id, text in rows:
        groups[text or ""].append(doc_id)
    out = []
    for doc_id, text in rows:
        ids = [i for i in groups[text or ""] if i is not None]
        keep = max(ids, default=None)
        out.append((doc_id, keep, len(groups[text or ""]), keep is None or doc_id == keep, hashlib.sha256((text or "").encode()).hexdigest()))
    return out


def same(got, want):
    return sorted(map(str, got)) == sorted(map(str, want))


def test_odd_rows(make_docs, odd_rows):
    got = [tuple(r) for r in exact_groups(make_docs(odd_rows)).collect()]
    assert same(got, brute([r[:2] for r in odd_rows]))


def test_empty_table(make_docs):
    assert exact_groups(make_docs([])).count() == 0


def test_hot_group(make_docs):
    rows = [(i, "copy of one text") for i in range(900)] + [(i, f"text {i}") for i in range(900, 1300)]
    got = [tuple(r) for r in exact_groups(make_docs(rows).repartition(7)).collect()]
    assert same(got, brute(rows))


def test_subtrees_go_out_when_full(spark, make_docs, monkeypatch):
    rows = [(i, f"{'abc'[i % 3]}{i % 40}" * (1 + i % 5)) for i in range(400)] + [(500, None), (501, "x" * 9000), (502, "x" * 9000 + "y")]
    for most in (900, 5000, 40_000):
        monkeypatch.setattr("trigwatch.llm.exact.TRIE_BYTES", most)
        work, rounds = Scratch(spark, "exact"), []
        monkeypatch.setattr(work, "stored", lambda df, name, plain=work.stored: rounds.append(name) or plain(df, name))
        assert same([tuple(r) for r in exact_groups(make_docs(rows), work=work).collect()], brute(rows))
        assert (len(rounds) > 1) == (most < 40_000)


def strings(trie):
    return {t: (o, n) for t, o, n in trie.terminals()}


@settings(max_examples=200, deadline=None)
@given(st.lists(st.tuples(st.binary(max_size=12), st.one_of(st.none(), st.integers(0, 9)))))
def test_trie(rows):
    trie, want = Trie(), {}
    for text, owner in rows:
        assert trie.add(text, owner, 1)
        before = want.get(text, (None, 0))
        best = max([x for x in (before[0], owner) if x is not None], default=None)
        want[text] = (best, before[1] + 1)
    assert strings(trie) == want


@settings(max_examples=200, deadline=None)
@given(st.lists(st.binary(max_size=6), min_size=1), st.integers(0, 4000), st.lists(st.binary(max_size=6)))
def test_spilled_subtrees(first, most, later):
    trie, out = Trie(), Counter()
    for text in first:
        trie.add(text, 1, 1)
    before = trie.held
    for text, _, n in trie.spill(most):
        out[text] += n
    assert not out or trie.held < before
    assert len(set(first)) == 1 or strings(trie)  # something stays
    for text in later:
        if not trie.add(text, 1, 1):
            out[text] += 1
    kept = {t: n for t, (_, n) in strings(trie).items()}
    assert not set(kept) & set(out)  # a string is either in the trie or went out, with all its copies
    assert Counter(kept) + out == Counter(first + later)


def test_a_trie_branches():
    trie = Trie()
    for i, text in enumerate([b"prefix one", b"prefix two", b"prefix", b"other"]):
        trie.add(text, i, 1)
    assert sorted(trie.root[1]) == [ord("o"), ord("p")]
    shared = trie.root[1][ord("p")]
    assert shared[0] == b"prefix" and shared[3] == 1 and list(shared[1]) == [ord(" ")]
    assert sorted(c[0] for c in shared[1][ord(" ")][1].values()) == [b"one", b"two"]


def test_memory_of_many_short_texts_is_counted():
    texts = [f"{i * 7919 % 1_000_003:010d}".encode() for i in range(1_000_000)]
    tracemalloc.start()
    trie = Trie()
    for i, text in enumerate(texts):
        trie.add(text, i, 1)
    taken = tracemalloc.get_traced_memory()[0]
    tracemalloc.stop()
    assert 0.6 * trie.held < taken < 1.1 * trie.held
