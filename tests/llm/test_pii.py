from __future__ import annotations

import hashlib
import random
import re

from trigwatch.llm.pii import KINDS, find_personal_data, posterior, reliabilities


def luhn(digits):
    twice = [int(c) * (2 if i % 2 else 1) for i, c in enumerate(reversed(digits))]
    return sum(v - 9 if v > 9 else v for v in twice) % 10 == 0


def brute(text):
    out = [(m.start(), 0, m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    out += [(m.start(), 1, m.end()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(p) <= 255 for p in m[0].split("."))]
    for kind, pattern, low, high in ((2, r"[0-9]([\x20-]?[0-9])+", 14, 19), (3, r"\+[0-9][\x20().0-9-]+[0-9]", 10, 15)):
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m[0])
            if low <= len(digits) <= high and (kind == 3 or luhn(digits)):
                out.append((m.start(), kind, m.end()))
    return sorted(out)


def joined(spans):
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)


def check(frame, texts):
    for r in frame.collect():
        want = brute(texts[r.doc_id] or "")
        assert r.base_sha256 == hashlib.sha256(joined(want).encode()).hexdigest(), (texts[r.doc_id], joined(want), r.spans)
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(s[1] == k for s in want) for k in range(4)]
        spans = [s for s in r.spans.split(",") if s]
        assert [s for s in spans if not s.startswith("other")] == [s for s in joined(want).split(",") if s]
        assert spans == sorted(spans, key=lambda s: (int(s.split(":")[1]), KINDS.index(s.split(":")[0])))


def test_random_texts(make_docs):
    rng = random.Random(4)
    parts = ["4111111111111111", "4111 1111 1111 1111", " ", "-", "9", "a@b.co", "x_y@c.de", "@", "1.2.3.4", "255.255.255.255", "256.1.1.1", ".", "+1 (555) 010-9999", "+", "\U0001f600", "call ", "0", "123-45-6789", " 555 123 4567", "é"]
    texts = {i: "".join(rng.choice("ab.@-_+é9 1") for _ in range(rng.randint(0, 30))) for i in range(600)}
    texts |= {600 + i: "".join(rng.choice("0123456789 -.+()") for _ in range(rng.randint(0, 60))) for i in range(600)}
    texts |= {1200 + i: "".join(rng.choice(parts) for _ in range(rng.randint(0, 10))) for i in range(600)}
    check(find_personal_data(make_docs(list(texts.items()))), texts)


def test_odd_rows(make_docs, odd_rows):
    rows = [r[:2] for r in odd_rows if r[0] not in (None, 1, 8)]
    out = find_personal_data(make_docs(odd_rows))
    assert out.count() == len(odd_rows)
    check(out.where("doc_id IN (2, 3, 4, 5, 6)"), dict(rows))
    assert out.where("doc_id = 7").first().spans == ""


def hard_texts(n):
    """Texts on which a pattern that starts anew at every character takes quadratic time."""
    return {1: "a" * n, 2: "1" * n, 3: "a.b" * n, 4: "1." * n, 5: "a@" + "b." * n + "c", 6: "+1" + " " * n, 7: "4 " * n, 8: "x@y.z " * n}


def test_hard_texts(make_docs):
    texts = hard_texts(300)
    check(find_personal_data(make_docs(list(texts.items()))), texts)


def test_long_hard_texts_end(make_docs):
    out = {r.doc_id: (r.n_email, r.n_ip, r.n_card, r.n_phone) for r in find_personal_data(make_docs(list(hard_texts(100_000).items()))).collect()}
    none = (0, 0, 0, 0)
    assert out == {1: none, 2: none, 3: none, 4: (0, 25_000, 0, 0), 5: (1, 0, 0, 0), 6: none, 7: none, 8: (100_000, 0, 0, 0)}


def test_empty_table(make_docs):
    assert find_personal_data(make_docs([])).count() == 0


def test_added_spans(make_docs):
    cue = [(i, f"please call 555 123 4{i:03d} or mail a{i}@b.com today, visa 4111111111111111") for i in range(40)]
    plain = [(100 + i, f"version 555.123.4{i:03d} of the order") for i in range(40)]
    out = {r.doc_id: r.spans for r in find_personal_data(make_docs(cue + plain)).collect()}
    assert all("other:12:24" in out[i] for i in range(40))
    assert all("other" not in out[100 + i] for i in range(40))


def test_native(make_docs):
    plan = find_personal_data(make_docs([(1, "a@b.co")]))._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


def test_expectation_maximisation():
    rng = random.Random(2)
    counts, truth = {}, {}
    for _ in range(20_000):
        y = rng.random() < 0.3
        votes = tuple((1 if y == (rng.random() < right) else -1) if rng.random() < speaks else 0 for right, speaks in ((0.95, 1), (0.8, 1), (0.85, 0.6), (0.7, 0.5)))
        counts[votes] = counts.get(votes, 0) + 1
        truth[votes] = truth.get(votes, 0) + y
    share, tables = reliabilities(counts)
    assert abs(share - 0.3) < 0.05
    assert tables[0][1, 1] > 0.85 and tables[0][1, 1] > tables[1][1, 1] > tables[3][1, 1]
    right = sum(n - truth[v] if posterior(share, tables, v) < 0.5 else truth[v] for v, n in counts.items())
    assert right / sum(counts.values()) > 0.93


def test_added_spans_touch_no_base_span(make_docs):
    rng = random.Random(12)
    parts = ["a@b.co", "10.0.0.1", "+1 415 555 0100", "4111 1111 1111 1111", "call 415-555-0199", " ", "x", "@handle", "300.1.2.3", "tel. 0301234567", ", "]
    rows = [(i, "".join(rng.choice(parts) + rng.choice(["", " "]) for _ in range(15))) for i in range(200)]
    for r in find_personal_data(make_docs(rows)).collect():
        spans = [(k, int(a), int(b)) for k, a, b in (s.split(":") for s in r.spans.split(",") if s)]
        base = [s for s in spans if s[0] != "other"]
        assert all(b <= c or d <= a for k, a, b in spans if k == "other" for _, c, d in base)
        assert hashlib.sha256(",".join(f"{k}:{a}:{b}" for k, a, b in base).encode()).hexdigest() == r.base_sha256


def test_context_decides_where_labelers_abstain(make_docs):
    rows = [(i, f"contact wizard @bob{i:03d} soon") for i in range(150)]
    rows += [(1000 + i, f"version gizmo @media{i:03d} soon") for i in range(150)]
    rows += [(2000, "the wizard @carola said"), (2001, "the gizmo @charsets said")]
    out = {r.doc_id: r.spans for r in find_personal_data(make_docs(rows)).collect()}
    assert out[2000] == "other:11:18" and out[2001] == ""
    assert all("other" in out[i] for i in range(150)) and all(out[1000 + i] == "" for i in range(150))
