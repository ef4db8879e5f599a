"""Secrets in texts: fixed patterns, and strings that look random to character Markov models."""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trigwatch.llm.common import batched, filled, hash_sample, stored, table
from trigwatch.llm.registry import query

#: fixed values of the contract: the kinds in order, their patterns, and what a match must have
KINDS = ("assign", "access", "hex", "random")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")
KEYWORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")

#: strings that the models judge
STRING, LETTER = re.compile(r"[A-Za-z0-9+/_=-]{16,}"), re.compile("[A-Za-z]")
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-."
CODE = {c: i for i, c in enumerate(ALPHABET)}

#: bound of the training sample: secrets, documents with ordinary words, bytes of a document
SECRETS, DOCUMENTS, DOCUMENT_BYTES = 5000, 400, 1 << 15
#: one distinct ordinary word in so many is held back from the models; fewer than so many tell
#: nothing; share of them that may look random; distance of the threshold from the others
HELD_BACK, LEAST_HELD, ODD_SHARE, MARGIN = 5, 50, 0.05, 0.1


def base_spans(text: str) -> list[tuple[int, int, int, str]]:
    """(start, kind, end, secret part) of the fixed patterns, in code points.

    A run of hex digits, or of what may follow AKIA, is matched as a whole by the pattern
    without a least length, so asking for the length at once finds the same matches.
    """
    out = []
    low = text.lower()
    if any(k in low for k in KEYWORDS):
        out += [(m.start(), 0, m.end(), m[2]) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    if "AKIA" in text:
        out += [(m.start(), 1, m.end(), m[0]) for m in ACCESS.finditer(text) if len(m[0]) >= 20]
    out += [(m.start(), 2, m.end(), m[0]) for m in HEX.finditer(text)]
    return sorted(out)


def other_strings(text: str, spans: list[tuple[int, int, int, str]]) -> list[tuple[int, str]]:
    """Start and text of the long strings, not only of digits and marks, that touch no span.

    Both are in order of their starts, so one walk over the spans will do: a string touches one
    if the farthest end of those that begin before its end lies behind its start.
    """
    out, at, reach = [], 0, 0
    for m in STRING.finditer(text):
        while at < len(spans) and spans[at][0] < m.end():
            reach = max(reach, spans[at][2])
            at += 1
        if reach <= m.start() and LETTER.search(m[0]):
            out.append((m.start(), m[0]))
    return out


def joined(spans: Iterable[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[kind]}:{start}:{end}" for start, kind, end in sorted(spans))


class MarkovRatio:
    """Log-likelihood ratio per character of two first-order character models.

    One is trained on secrets, one on ordinary identifiers; every transition starts with a
    pseudo-count. Half of the random model is uniform, for secrets over alphabets that the
    labelled ones lack. A string counts as random when its ratio is at least halfway from that
    of all but ``ODD_SHARE`` of the held-back ordinary strings to zero and above it by
    ``MARGIN``; or, when these are few or look random themselves, when it is above zero by
    ``MARGIN``. Long strings that nobody has labelled have no part in it, so any share of them
    can be secrets.
    """

    def __init__(self, secrets: list[str], ordinary: list[str], held_back: list[str]) -> None:
        random = (np.exp(self._model(secrets)) + 1 / len(ALPHABET)) / 2
        self.table = np.log(random) - self._model(ordinary)
        usual = sorted(self.value(s) for s in held_back)
        high = min(0.0, usual[int(len(usual) * (1 - ODD_SHARE))]) if len(usual) >= LEAST_HELD else 0.0
        self.threshold = max(high / 2, high + MARGIN)

    @staticmethod
    def _model(strings: list[str]) -> np.ndarray:
        size = len(ALPHABET) + 1  # the last row is the begin
        counts = np.ones((size, size - 1))
        for s in strings:
            codes = [CODE[c] for c in s if c in CODE]
            np.add.at(counts, ([size - 1, *codes][: len(codes)], codes), 1)
        return np.log(counts / counts.sum(1, keepdims=True))

    def value(self, string: str) -> float:
        codes = [CODE[c] for c in string if c in CODE]
        return float(self.table[[len(ALPHABET), *codes][: len(codes)], codes].sum() / max(1, len(codes)))

    def random(self, string: str) -> bool:
        return self.value(string) > self.threshold


def _train(found: DataFrame, docs: DataFrame) -> MarkovRatio:
    """Models from bounded samples in hash order: secrets that the patterns found, and words of
    some documents outside of them, a part of which is held back for the threshold."""
    values = found.select(F.explode("secrets").alias("s")).where(F.length("s") <= 512).distinct().orderBy(F.xxhash64("s")).limit(SECRETS)
    secrets = [r[0] for r in values.collect()]
    ordinary = []
    for text in hash_sample(docs.where(F.octet_length("text") <= DOCUMENT_BYTES), "text", DOCUMENTS):
        spans = base_spans(text)
        rest, at = [], 0
        for start, _, end, _ in spans:
            rest.append(text[at:start])
            at = max(at, end)
        rest.append(text[at:])
        # longer ones may be secrets that no pattern knows
        ordinary += [w for part in rest for w in re.findall(r"(?<![A-Za-z0-9+/_=-])[A-Za-z][A-Za-z0-9_-]{3,14}(?![A-Za-z0-9+/_=-])", part)]
    held_back = {w for w in ordinary if zlib.crc32(w.encode()) % HELD_BACK == 0}
    return MarkovRatio(secrets, [w for w in ordinary if w not in held_back], sorted(held_back))


def find_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Spans of secrets in every whole text, one row per input row.

    Returns ``doc_id, n_assign, n_access, n_hex, base_sha256, spans``. A span is
    kind:start:end in code points, the end exclusive; spans stand by start, then kind, and are
    joined by commas (``base_sha256`` is over those of the fixed patterns). Kind ``random`` is
    a string of 16 or more characters, a letter among them, that touches no other span and
    that the models call random. Null and empty texts have no spans; repeated rows are rows of their own; other
    columns are not read. Without any secret in the corpus the random model is uniform.

    Texts are read once by the scan, whose small result is stored, and once for the bounded
    training sample; then only the strings found are judged.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), filled(text_col).alias("text"))
    schema = pa.schema([
        ("doc_id", pa.int64()), ("starts", pa.list_(pa.int64())), ("kinds", pa.list_(pa.int32())), ("ends", pa.list_(pa.int64())),
        ("secrets", pa.list_(pa.string())), ("at", pa.list_(pa.int64())), ("strings", pa.list_(pa.string())),
    ])

    def scan(batches):
        for batch in batches:
            columns = [[] for _ in range(6)]
            for text in batch.column(1):
                text = text.as_py()
                spans = base_spans(text)
                others = other_strings(text, spans)
                row = ([s[0] for s in spans], [s[1] for s in spans], [s[2] for s in spans], [s[3] for s in spans], [o[0] for o in others], [o[1] for o in others])
                for column, value in zip(columns, row):
                    column.append(value)
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, f.type) for c, f in zip(columns, list(schema)[1:]))], schema=schema)

    lists = "doc_id long, starts array<long>, kinds array<int>, ends array<long>, secrets array<string>, at array<long>, strings array<string>"
    found = stored(batched(rows).mapInArrow(scan, lists), "secrets")
    model = _train(found, rows)
    out_schema = pa.schema([("doc_id", pa.int64()), *((f"n_{k}", pa.int64()) for k in KINDS[:3]), ("base", pa.string()), ("spans", pa.string())])

    def judge(batches):
        for batch in batches:
            out = []
            for doc_id, starts, kinds, ends, at, strings in zip(*(c.to_pylist() for c in batch.columns)):
                base = list(zip(starts, kinds, ends))
                more = [(s, 3, s + len(x)) for s, x in zip(at, strings) if model.random(x)]
                out.append((doc_id, *(kinds.count(k) for k in range(3)), joined(base), joined(base + more)))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), out_schema)], schema=out_schema)

    judged = found.select("doc_id", "starts", "kinds", "ends", "at", "strings").mapInArrow(
        judge, "doc_id long, n_assign long, n_access long, n_hex long, base string, spans string"
    )
    return judged.select("doc_id", "n_assign", "n_access", "n_hex", F.sha2("base", 256).alias("base_sha256"), "spans")


@query("op3_secrets")
def op3_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_secrets(table(spark, sf_dir, "documents"))
