"""Benchmark passages in documents, by CGK embeddings and bit-sampling LSH with exact verification."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trigwatch.llm.common import batched, filled, fresh, table
from trigwatch.llm.registry import query
from trigwatch.llm.wordhash import MARKS, located_words, mixed

#: part of an item's words that edits may change; wanted recall; samples per table; tables of the simulation
EDITS, RECALL, SAMPLES, TRIAL_TABLES = 0.2, 0.98, 4, 48
#: items of more words are looked for by pieces of at most so many: the tables needed grow with the length
WHOLE_WORDS, PIECE_WORDS = 60, 32
#: items of fewer words are too common to tell anything and are never found
LEAST_WORDS = 5
#: items that one pass holds, and bytes of their texts
BLOCK_ITEMS, BLOCK_BYTES = 20_000, 32 << 20
PAIR = np.uint64(0x9E3779B97F4A7C15)


def allowed(n: int) -> int:
    return int(EDITS * n)


class Walks:
    """CGK walks for sequences of up to ``n`` symbols, and which steps each hash table samples.

    A walk of 3n steps reads the symbol it stands on and moves on or stays by a random bit of
    (step, symbol). Equal stretches keep two walks together, so few edits leave most steps
    equal; a table's key is a hash of a few sampled steps.
    """

    def __init__(self, n: int, tables: int, seed: int) -> None:
        rng = np.random.default_rng([seed, n])
        self.n = n
        self.moves = rng.integers(1, 1 << 63, (3 * n, tables), dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        self.keys = np.zeros((3 * n, tables), np.uint64)
        for t in range(tables):
            steps = rng.choice(2 * n, min(SAMPLES, 2 * n), replace=False)  # later ones mostly stand behind the end
            self.keys[steps, t] = rng.integers(1, 1 << 63, len(steps), dtype=np.uint64) * np.uint64(2) + np.uint64(1)

    def signatures(self, symbols: np.ndarray, tables: int | None = None) -> np.ndarray:
        """Key of every row in every table; rows are padded with 0 to ``n + 1`` symbols."""
        moves, keys = self.moves[:, :tables], self.keys[:, :tables]
        rows = np.arange(len(symbols))[:, None]
        at = np.zeros((len(symbols), moves.shape[1]), np.int64)
        out = np.zeros(at.shape, np.uint64)
        for j in range(3 * self.n):
            symbol = symbols[rows, at]
            out += symbol * keys[j]
            at += ((symbol * moves[j]) >> np.uint64(63)).astype(np.int64)
            np.minimum(at, self.n, out=at)
        return mixed(out)


def padded(words: np.ndarray, starts: np.ndarray, n: int) -> np.ndarray:
    """Windows of ``n`` words, with a 0 after them; 0 where the text has ended."""
    at = starts[:, None] + np.arange(n)[None, :]
    out = np.zeros((len(starts), n + 1), np.uint64)
    out[:, :n] = np.where(at < len(words), words[np.minimum(at, len(words) - 1)], np.uint64(0))
    return out


EDIT = 1 << 40


def best_place(item: np.ndarray, text: np.ndarray) -> tuple[int, int]:
    """Least word edits between the item and any stretch of the text, and where the first such stretch begins."""
    steps = np.arange(len(text) + 1, dtype=np.int64) * EDIT
    row = np.arange(len(text) + 1, dtype=np.int64)  # a cell is edits * EDIT + begin
    for x in item:
        new = row + EDIT
        np.minimum(new[1:], row[:-1] + np.where(text == x, 0, EDIT), out=new[1:])
        row = np.minimum.accumulate(new - steps) + steps  # words of the text that the item lacks
    distance, start = divmod(int(row.min()), EDIT)
    return distance, start


def pieces(words: np.ndarray) -> list[tuple[int, np.ndarray]]:
    """Begin and words of the pieces by which an item is looked for: all of a short one.

    Pieces of ``m`` words share out the edits of the item, so one of them at least has no more
    than ``EDITS * m``.
    """
    count = 1 if len(words) <= WHOLE_WORDS else math.ceil(len(words) / PIECE_WORDS)
    cuts = [i * len(words) // count for i in range(count + 1)]
    return [(a, words[a:b]) for a, b in zip(cuts, cuts[1:])]


def edited(item: np.ndarray, edits: int, rng: np.random.Generator) -> np.ndarray:
    """The item after random substitutions, insertions and deletions of words."""
    words = item.tolist()
    for kind in rng.integers(0, 3, edits):
        at = int(rng.integers(0, max(1, len(words))))
        if kind == 0 and words:
            words[at] = int(rng.integers(1, 1 << 62))
        elif kind == 1:
            words.insert(at, int(rng.integers(1, 1 << 62)))
        elif len(words) > 1:
            del words[at]
    return np.array(words, np.uint64)


class Finder:
    """Finds the items of one block in texts.

    Items of more than ``WHOLE_WORDS`` words are looked for by their pieces, others whole; what
    is found is compared as a whole item. Per length of what is looked for: walks, and as many
    tables as simulated worst-case edits need for the wanted recall. A text is searched only
    where a window has enough word pairs of that length's pieces: ``k`` edits leave at least
    ``n - 1 - 2k`` of the pairs of ``n`` words, so this skips no match.
    """

    def __init__(self, items: list[tuple[int, str]], seed: int = 5) -> None:
        self.items: list[tuple[int, np.ndarray]] = []
        self.pieces: dict[int, list[tuple[int, int, np.ndarray]]] = {}  # number of the item, begin, words
        for item_id, text in items:
            words = located_words(text, MARKS)[0]
            if len(words) >= LEAST_WORDS:
                for begin, piece in pieces(words):
                    self.pieces.setdefault(len(piece), []).append((len(self.items), begin, piece))
                self.items.append((item_id, words))
        self.lengths = sorted(self.pieces)
        # lengths share 64 bits when there are more; a shared bit only makes the first test coarser
        self.bit = {n: i * min(64, len(self.lengths)) // max(1, len(self.lengths)) for i, n in enumerate(self.lengths)}
        pairs = sum(n * len(group) for n, group in self.pieces.items())
        self.shift = np.uint64(64 - max(16, min(24, (16 * pairs).bit_length())))
        self.slots = np.zeros(1 << (64 - int(self.shift)), np.uint64)
        self.walks, self.tables = {}, {}
        rng = np.random.default_rng(seed)
        for n, group in self.pieces.items():
            for *_, words in group:
                self.slots[self._slot(words)] |= np.uint64(1) << np.uint64(self.bit[n])
            walks = Walks(n, TRIAL_TABLES, seed)
            some = [group[i][2] for i in rng.permutation(len(group))[:8]]
            copies = [(edited(w, allowed(n), rng), w) for w in some for _ in range(max(4, 32 // len(some)))]
            x = walks.signatures(np.concatenate([padded(c, np.zeros(1, np.int64), n) for c, _ in copies]))
            y = walks.signatures(np.concatenate([padded(w, np.zeros(1, np.int64), n) for _, w in copies]))
            hit = max(float((x == y).mean()), 1e-3)
            count = 1 if hit >= RECALL else math.ceil(math.log(1 - RECALL) / math.log(1 - hit))
            if count > TRIAL_TABLES:
                walks = Walks(n, count, seed)
            keys = walks.signatures(np.concatenate([padded(w, np.zeros(1, np.int64), n) for *_, w in group]), count)
            order = np.argsort(keys, axis=0, kind="stable")
            self.walks[n], self.tables[n] = walks, (count, np.take_along_axis(keys, order, 0), order)

    def _slot(self, words: np.ndarray) -> np.ndarray:
        """Slots of the word pairs."""
        return (mixed(words[:-1] * PAIR + words[1:]) >> self.shift).astype(np.int64)

    def windows(self, words: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
        """Lengths and the window starts that may hold a piece (a short item whole) of that length."""
        if len(words) < 2:
            return
        marks = self.slots[self._slot(words)]
        some = marks[marks != 0]
        if not len(some):
            return
        counts = np.unpackbits(some.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
        for n in self.lengths:
            k = allowed(n)
            least = max(1, n - 1 - 2 * k)
            if counts[self.bit[n]] < least:
                continue
            mine = (marks >> np.uint64(self.bit[n])) & np.uint64(1)
            total = np.concatenate([[0], np.cumsum(mine.astype(np.int64))])
            starts = np.arange(max(1, len(words) - (n - k) + 1))
            ends = np.minimum(starts + max(1, n + k - 1), len(mine))
            # a best stretch can begin with a word of the item; one further on is as good to find it
            hit = (total[ends] - total[np.minimum(starts, len(mine))] >= least) & (mine[np.minimum(starts, len(mine) - 1)] > 0)
            if hit.any():
                yield n, starts[hit]

    def matches(self, texts: list[str]) -> Iterator[tuple[int, int, int, int]]:
        """(text number, item id, distance, first word) of each item found, at its best place."""
        held: dict[int, list[tuple[int, np.ndarray, int]]] = {}
        found: dict[tuple[int, int], tuple[int, int]] = {}
        for number, text in enumerate(texts):
            words = located_words(text, MARKS)[0]
            for n, starts in self.windows(words):
                for at in range(0, len(starts), 1 << 12):
                    waiting = held.setdefault(n, [])
                    waiting.append((number, words, starts[at : at + (1 << 12)]))
                    if sum(len(s) for _, _, s in waiting) >= 1 << 12:
                        self._look(n, held.pop(n), found)
        for n, waiting in held.items():
            self._look(n, waiting, found)
        for (number, item_id), (distance, start) in found.items():
            yield number, item_id, distance, start

    def _look(self, n: int, waiting: list, found: dict) -> None:
        count, keys, order = self.tables[n]
        group = self.pieces[n]
        signs = self.walks[n].signatures(np.concatenate([padded(w, s, n) for _, w, s in waiting]), count)
        owner = np.concatenate([np.full(len(s), i) for i, (_, _, s) in enumerate(waiting)])
        starts = np.concatenate([s for _, _, s in waiting])
        pairs = []
        for t in range(count):
            low, high = (np.searchsorted(keys[:, t], signs[:, t], side) for side in ("left", "right"))
            rows, n_hits = np.flatnonzero(high > low), (high - low)[high > low]
            if len(rows):
                offset = np.arange(n_hits.sum()) - np.repeat(np.cumsum(n_hits) - n_hits, n_hits)
                pairs.append(np.stack([np.repeat(rows, n_hits), order[np.repeat(low[rows], n_hits) + offset, t]], axis=1))
        if not pairs:
            return
        pairs = np.unique(np.concatenate(pairs), axis=0)
        distinct: dict[int, set[int]] = {}
        places: dict[tuple[int, int], list[list[int]]] = {}  # by waiting text and item: stretches to compare, joined where they meet
        for row, piece in pairs[np.argsort(starts[pairs[:, 0]] - np.array([begin for _, begin, _ in group])[pairs[:, 1]], kind="stable")].tolist():
            item, begin, _ = group[piece]
            item_id, whole = self.items[item]
            number, words, _ = waiting[owner[row]]
            if found.get((number, item_id), (1, 0))[0] == 0:
                continue
            most = allowed(len(whole))
            slack = most if len(whole) == n else most + allowed(n)  # a piece may itself begin some words beside the window
            start = int(starts[row]) - begin
            low, high = max(0, start - slack), min(len(words), start + len(whole) + slack)
            if item not in distinct:
                distinct[item] = set(whole.tolist())
            # an edit takes away one distinct word at most
            if len(distinct[item].intersection(words[low:high].tolist())) < len(distinct[item]) - most:
                continue
            known = places.setdefault((owner[row], item), [])
            if known and low <= known[-1][1]:
                known[-1][1] = max(known[-1][1], high)
            else:
                known.append([low, high])
        for (text, item), stretches in places.items():
            (item_id, whole), (number, words, _) = self.items[item], waiting[text]
            for low, high in stretches:
                before = found.get((number, item_id), (allowed(len(whole)) + 1, 0))
                if before[0]:
                    distance, at = best_place(whole, words[low:high])
                    if (distance, low + at) < before:
                        found[number, item_id] = (distance, low + at)


def item_blocks(items: DataFrame, id_col: str, text_col: str) -> Iterator[list[tuple[int, str]]]:
    """The items in blocks that each stay below ``BLOCK_ITEMS`` and ``BLOCK_BYTES`` or so."""
    known = items.where(F.col(text_col).isNotNull()).select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).distinct()
    n, size = known.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()
    blocks = max(1, math.ceil(2 * n / BLOCK_ITEMS) if n > BLOCK_ITEMS else 1, math.ceil(2 * size / BLOCK_BYTES) if size > BLOCK_BYTES else 1)
    for b in range(blocks):
        block = known if blocks == 1 else known.where(F.pmod(F.xxhash64("id", "text"), F.lit(blocks)) == b)
        yield sorted((tuple(r) for r in block.collect()), key=lambda r: (r[0] is None, r[0] or 0, r[1]))


def leaks(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """Benchmark items found in documents: ``doc_id, item_id, distance, first_word``.

    Words are runs of letters, digits and non-ASCII bytes, A-Z lower-cased. An item of ``n``
    words is in a document when some stretch of it differs by at most ``EDITS * n`` inserted,
    deleted or changed words; the row has the least such number and where (0-based word) the
    first best stretch begins. Null items and items of fewer than ``LEAST_WORDS`` words are never found; a null or
    empty text has none. Repeated rows give repeated rows, items that share an id count as
    one. A document with nothing found has no row.

    Items go to the tasks in blocks of bounded size, each block one pass over all documents.
    Windows begin at every word that may start an item, or a piece of an item of more than
    ``WHOLE_WORDS`` words. Every match is verified by the exact distance of the whole item
    around the window; the tables are as many as simulated edits at the limit need for
    ``RECALL`` by a single window, and an item usually lies in several.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), filled(text_col).alias("text"))
    schema = pa.schema([("doc_id", pa.int64()), ("item_id", pa.int64()), ("distance", pa.int32()), ("first_word", pa.int64())])
    out = None
    for block in item_blocks(items, item_id, item_text):
        finder = Finder(block)

        def find(batches, finder=finder):
            for batch in batches:
                ids = batch.column(0).to_pylist()
                got = [(ids[i], item, distance, start) for i, item, distance, start in finder.matches(batch.column(1).to_pylist())]
                if got:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*got), schema)], schema=schema)

        part = batched(rows).mapInArrow(find, "doc_id long, item_id long, distance int, first_word long")
        out = part if out is None else out.unionByName(part)
    return out


def _leaky(finder: Finder):
    @F.pandas_udf("boolean")
    def leaky(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in texts:
            hit = {number for number, *_ in finder.matches(batch.tolist())}
            yield pd.Series([i in hit for i in range(len(batch))], dtype="bool")

    return leaky


def clean(docs: DataFrame, items: DataFrame, text_col: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """``docs`` without the rows in which an item is found (as in ``leaks``); columns stay."""
    (flag,) = fresh(docs, "leaks")
    for block in item_blocks(items, item_id, item_text):
        docs = batched(docs).withColumn(flag, _leaky(Finder(block))(filled(text_col))).where(~F.col(flag)).drop(flag)
    return docs


@query("op10_decontaminate")
def op10_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
