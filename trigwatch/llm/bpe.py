"""Byte-pair encoding and decoding, with texts cut where no vocabulary token can reach across."""

from __future__ import annotations

import json
import os
import re
from array import array
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from trigwatch.llm.common import batched, filled, fresh, table
from trigwatch.llm.registry import query
from trigwatch.llm.tokens import tokenizer_file

#: bytes of a text that are searched for cuts at a time, and rows that are encoded together
SLAB, GROUP = 1 << 20, 32
#: fragments whose ids a worker remembers, the longest of them, and marks of those that came once
CACHE, CACHE_BYTES, MARKS = 400_000, 32, 1 << 22
#: white space beyond ASCII: its last byte also ends other characters
WIDE_SPACE = re.compile("[\x85\xa0  -     　]")


def byte_letters() -> dict[str, int]:
    """The letter that stands for each byte in a byte-level vocabulary: a printable Latin-1 byte
    stands for itself, the others are numbered from 256 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


def forced_cuts(tokens: Sequence[bytes]) -> np.ndarray:
    """``cut[a, b]``: no token has byte ``b`` right after byte ``a``, so tokens always part there."""
    cut = np.ones((256, 256), bool)
    for token in tokens:
        pair = np.frombuffer(token, np.uint8)
        cut[pair[:-1], pair[1:]] = False
    return cut


def safe_cuts(cut: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The forced cuts at which both sides may also be split into words independently.

    The word pattern reads from left to right without looking back. A cut changes what it finds
    only inside a character, after white space (a run of it keeps its last sign for the next
    word, and so must see that word) and before an apostrophe that continues a run of marks (at
    the start of a fragment it could begin a contraction). All other cuts lie between two
    words or inside one, whose two parts are then found as words of their own. The second table
    is for texts with white space beyond ASCII: it has no cut after a wide character at all.
    """
    cut = cut.copy()
    cut[:, 0x80:0xC0] = False
    cut[[*range(0x09, 0x0E), *range(0x1C, 0x21)]] = False
    marks = [b for b in range(256) if b >= 0x80 or not chr(b).isalnum()]
    cut[marks, ord("'")] = False
    wide = cut.copy()
    wide[0x80:] = False
    return cut, wide


class Codec:
    """Encodes and decodes by a tokenizers file.

    Texts of a byte-level file with its usual word pattern are cut at forced boundaries: a merge
    never crosses one, so the fragments are encoded independently and their ids concatenated.
    Ids of fragments that come a second time are remembered. Files of another kind, and texts
    that hold the text of an added token, are encoded whole.
    """

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # tasks already use every core
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        model, before, decoder = spec["model"], spec.get("pre_tokenizer") or {}, spec.get("decoder") or {}
        self.added = [t["content"] for t in spec.get("added_tokens") or []]
        letters = byte_letters()
        vocab = model["vocab"] if model.get("type") == "BPE" else {}
        byte_level = bool(vocab) and decoder.get("type") == "ByteLevel" and all(c in letters for token in vocab for c in token)
        self.pieces: list[bytes] | None = None
        self.cuts: tuple[np.ndarray, np.ndarray] | None = None
        if byte_level:
            spelled = {i: bytes(letters[c] for c in token) for token, i in vocab.items()}
            every = spelled | {t["id"]: bytes(letters[c] for c in t["content"]) if all(c in letters for c in t["content"]) else t["content"].encode() for t in spec.get("added_tokens") or []}
            self.pieces = [every.get(i, b"") for i in range(max(every) + 1)]
            usual = before.get("type") == "ByteLevel" and before.get("use_regex", True) and not before.get("add_prefix_space")
            odd = model.get("dropout") or model.get("continuing_subword_prefix") or model.get("end_of_word_suffix") or model.get("unk_token")
            if usual and not odd and spec.get("normalizer") is None:
                self.cuts = tuple(np.ascontiguousarray(c.ravel()) for c in safe_cuts(forced_cuts(list(spelled.values()))))
        self.cache: dict[bytes, bytes] = {}
        self.once = bytearray(MARKS)

    def fragments(self, text: str) -> Iterator[list[bytes]]:
        """The parts of ``text`` between cuts, in lists of about ``SLAB`` bytes."""
        raw = text.encode()
        cut = self.cuts[1 if WIDE_SPACE.search(text) else 0]
        signs, start = np.frombuffer(raw, np.uint8), 0
        for at in range(0, len(raw), SLAB):
            part = signs[at : at + SLAB + 1].astype(np.uint16)
            ends = (np.flatnonzero(cut[(part[:-1] << 8) | part[1:]]) + (at + 1)).tolist()
            if at + SLAB >= len(raw):
                ends.append(len(raw))
            if ends:
                yield [raw[a:b] for a, b in zip([start, *ends], ends)]
                start = ends[-1]

    def _whole(self, texts: list[str]) -> list[bytes]:
        return [array("I", e.ids).tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _known(self, fragments: list[bytes]) -> list[bytes]:
        """Ids of each fragment; the library is called once for those that are not remembered."""
        cache, once = self.cache, self.once
        found = list(map(cache.get, fragments))
        if None in found:
            missing: dict[bytes, list[int]] = {}
            for i, ids in enumerate(found):
                if ids is None:
                    missing.setdefault(fragments[i], []).append(i)
            for (fragment, places), ids in zip(missing.items(), self._whole([f.decode() for f in missing])):
                if len(fragment) <= CACHE_BYTES and len(cache) < CACHE:
                    mark = hash(fragment) % MARKS
                    if once[mark]:
                        cache[fragment] = ids
                    once[mark] = 1
                for i in places:
                    found[i] = ids
        return found

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text, as unsigned 32-bit integers of the machine's byte order."""
        out: list[bytes] = [b""] * len(texts)
        together, ends = [], []
        for i, text in enumerate(texts):
            if self.cuts is None or any(a in text for a in self.added):
                out[i] = self._whole([text])[0]
            elif len(text) > SLAB // 4:
                out[i] = b"".join([b"".join(self._known(parts)) for parts in self.fragments(text)])
            else:
                for parts in self.fragments(text):
                    together += parts
                ends.append((i, len(together)))
        ids, at = self._known(together), 0
        for i, end in ends:
            out[i] = b"".join(ids[at:end])
            at = end
        return out

    def decode(self, ids: Sequence[int]) -> str:
        """The text of the ids, special tokens too; unknown ids have none, and bytes that are no
        UTF-8 become replacement signs."""
        if self.pieces is None:
            return self.tokenizer.decode(list(ids), skip_special_tokens=False)
        pieces, n = self.pieces, len(self.pieces)
        try:
            return b"".join([pieces[i] for i in ids]).decode("utf-8", "replace")
        except IndexError:
            return b"".join([pieces[i] for i in ids if i < n]).decode("utf-8", "replace")


_CODECS: dict[str, Codec] = {}


def codec(path: str) -> Codec:
    """One codec per worker and file."""
    if path not in _CODECS:
        _CODECS[path] = Codec(path)
    return _CODECS[path]


def encode_texts(docs: DataFrame, tokenizer: str, text_col: str = "text", keep: Sequence[str] = ("doc_id",), ids_col: str = "ids") -> DataFrame:
    """The ``keep`` columns and ``ids_col``, an array of the ids of the whole text.

    Ids equal those of the tokenizers library without special tokens, truncation or padding.
    One row per row, repeated or not; null text counts as empty and has no ids; an empty table
    gives none. Columns not in ``keep`` are not read; a kept column may not be named like
    ``ids_col``. Nothing is shuffled, and a lost task is simply run again.
    """
    inner = fresh(docs.select(*[f"`{c}`" for c in keep]), "text_to_encode")[0]
    rows = docs.select(*[F.col(f"`{c}`") for c in keep], filled(text_col).alias(inner))
    schema = T.StructType([*(docs.schema[c] for c in keep), T.StructField(ids_col, T.ArrayType(T.IntegerType(), False))])

    def run(batches):
        code = codec(tokenizer)
        for batch in batches:
            for at in range(0, batch.num_rows, GROUP):
                some = batch.slice(at, GROUP)
                ids = code.encode(some.column(some.num_columns - 1).to_pylist())
                ends = np.cumsum([0, *(len(i) // 4 for i in ids)], dtype=np.int32)
                values = pa.array(np.frombuffer(b"".join(ids), np.int32))
                yield pa.RecordBatch.from_arrays([*some.columns[:-1], pa.ListArray.from_arrays(pa.array(ends), values)], names=[*keep, ids_col])

    return batched(rows).mapInArrow(run, schema)


def decode_ids(rows: DataFrame, tokenizer: str, ids_col: str = "ids", text_col: str = "decoded") -> DataFrame:
    """All columns and ``text_col``, the text of the ids in ``ids_col``, special tokens included.

    Equals the tokenizers library's decoding: ids that the file does not know are left out, as
    are null ids; a null or empty array gives the empty text.
    """
    schema = T.StructType([*rows.schema, T.StructField(text_col, T.StringType())])
    names, place = [f.name for f in schema], rows.columns.index(ids_col)

    def run(batches):
        code = codec(tokenizer)
        for batch in batches:
            for at in range(0, batch.num_rows, GROUP):
                some = batch.slice(at, GROUP)
                texts = []
                for ids in some.column(place):
                    found = ids.values.drop_null().to_numpy() if ids.is_valid else np.empty(0, np.int64)
                    texts.append(code.decode(found[found >= 0].tolist()))
                yield pa.RecordBatch.from_arrays([*some.columns, pa.array(texts, pa.string())], names=names)

    return batched(rows).mapInArrow(run, schema)


@query("op13_bpe")
def op13_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = tokenizer_file()
    out = decode_ids(encode_texts(table(spark, sf_dir, "documents"), path), path)
    return out.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.concat_ws(",", F.col("ids").cast("array<string>")), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )
