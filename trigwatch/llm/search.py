"""Ranked lexical search the other way round: documents stream through an index of the items."""

from __future__ import annotations

import heapq
import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from trigwatch.functions.ordering import running_totals
from trigwatch.llm.common import Scratch, batched, filled, table
from trigwatch.llm.registry import query

#: ASCII signs that are no digit or letter part terms; only A-Z are lower-cased
TERM_BYTES = bytes(
    b + 32 if 0x41 <= b <= 0x5A else b if b >= 0x80 or chr(b).isalnum() else 0x20 for b in range(256)
)
#: bytes of item texts in one index that is broadcast
INDEX_BYTES = 16 << 20
#: documents that are scored together, and places of their table of scores
GROUP, CELLS = 64, 1 << 21
#: parts in which the heaps of an item are merged before the last merge
MERGE_PARTS = 64


def terms(text: str | None) -> list[bytes]:
    """The terms of a text as UTF-8, in order, repeats included; null has none."""
    return text.encode().translate(TERM_BYTES).split() if text else []


class Index:
    """Inverted index over the terms of some items: for each term the items that hold it and
    how often. ``key`` numbers the items of the whole table."""

    def __init__(self, items: list[tuple[int, str | None]]) -> None:
        self.keys = [key for key, _ in items]
        postings: dict[bytes, list[tuple[int, int]]] = {}
        for place, (_, text) in enumerate(items):
            for term, n in Counter(terms(text)).items():
                postings.setdefault(term, []).append((place, n))
        self.number = {term: i for i, term in enumerate(postings)}
        sizes = [len(p) for p in postings.values()]
        self.starts = np.cumsum([0, *sizes])
        flat = [pair for p in postings.values() for pair in p]
        self.items = np.array([i for i, _ in flat], np.int64)
        self.counts = np.array([n for _, n in flat], np.int64)
        self.weights = np.zeros(len(sizes), np.int64)

    def weigh(self, documents: int, holding: dict[bytes, int]) -> None:
        """Set each term's weight from the number of documents and of those that hold it."""
        for term, i in self.number.items():
            self.weights[i] = math.floor(1000 * math.log((2 * documents + 2) / (2 * holding.get(term, 0) + 1)))

    def scores(self, found: list[tuple[int, int, int]], rows: int) -> np.ndarray:
        """Scores of ``rows`` documents (rows) for all items (columns). ``found`` has, per term of
        a document, the row, the term's number and its part of the score."""
        grid = np.zeros(rows * len(self.keys), np.int64)
        if found:
            row, term, part = np.array(found, np.int64).T
            sizes = self.starts[term + 1] - self.starts[term]
            ends = np.cumsum(sizes)
            at = np.arange(ends[-1]) - np.repeat(ends - sizes, sizes) + np.repeat(self.starts[term], sizes)
            np.add.at(grid, np.repeat(row, sizes) * len(self.keys) + self.items[at], np.repeat(part * self.weights[term], sizes) * self.counts[at])
        return grid.reshape(rows, len(self.keys))


class Heaps:
    """The best ``k`` documents of each item: higher scores first, equal ones by smaller id, null last."""

    def __init__(self, items: int, k: int) -> None:
        self.k, self.best = k, [[] for _ in range(items)]
        self.floor = np.ones(items, np.int64)  # no lower score can enter: scores start above 0

    def offer(self, scores: np.ndarray, ids: list[int | None]) -> None:
        for row, item in zip(*(at.tolist() for at in np.nonzero(scores >= self.floor))):
            heap, doc_id = self.best[item], ids[row]
            entry = (int(scores[row, item]), doc_id is not None, -(doc_id or 0))
            if len(heap) < self.k:
                heapq.heappush(heap, entry)
            else:
                heapq.heappushpop(heap, entry)
            if len(heap) == self.k:
                self.floor[item] = heap[0][0]

    def rows(self) -> Iterator[tuple[int, int | None, int]]:
        for item, heap in enumerate(self.best):
            for score, known, negative in heap:
                yield item, -negative if known else None, score


def numbered(items: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``key`` (unique), ``item_id``, ``text`` and the ``part`` of bounded size that the item belongs to."""
    rows = items.select(F.col(id_col).cast("long").alias("item_id"), F.col(text_col).alias("text"))
    rows = rows.withColumn("key", F.monotonically_increasing_id()).withColumn("bytes", 64 + F.octet_length(filled("text")))
    placed = running_totals(rows, [F.col("key")], {"upto": F.col("bytes")})
    part = F.floor((F.col("upto") - F.col("bytes")) / F.lit(INDEX_BYTES)).cast("long")
    return placed.select("key", "item_id", "text", part.alias("part"))


def corpus_counts(docs: DataFrame, index: Index) -> tuple[int, int, dict[bytes, int]]:
    """Documents with a term, all their terms, and per term of the index the documents that hold
    it. One row per task and term is shuffled, at most one per term of the index is collected."""
    number = docs.sparkSession.sparkContext.broadcast(index.number)
    schema = pa.schema([("term", pa.int64()), ("n", pa.int64()), ("length", pa.int64())])

    def count(batches):
        known, held, documents, length = number.value, Counter(), 0, 0
        for batch in batches:
            for text in batch.column(0).to_pylist():
                found = terms(text)
                documents += bool(found)
                length += len(found)
                held.update([known[t] for t in set(found) if t in known])
        rows = [(-1, documents, length), *((t, n, 0) for t, n in held.items())]
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows)], schema=schema)

    out = docs.select("text").mapInArrow(count, "term long, n long, length long")
    got = {r[0]: r[1:] for r in out.groupBy("term").agg(F.sum("n"), F.sum("length")).collect()}
    number.destroy()
    documents, length = got.pop(-1, (0, 0))
    names = list(index.number)
    return documents, length, {names[i]: n for i, (n, _) in got.items()}


def best_of_part(docs: DataFrame, index: Index, k: int) -> DataFrame:
    """``key, doc_id, score``: the heaps of every task for the items of one index."""
    documents, length, holding = corpus_counts(docs, index)
    index.weigh(documents, holding)
    sent = docs.sparkSession.sparkContext.broadcast(index)
    schema = pa.schema([("key", pa.int64()), ("doc_id", pa.int64()), ("score", pa.int64())])

    def search(batches):
        index = sent.value
        heaps, number = Heaps(len(index.keys), k), index.number
        group = max(1, min(GROUP, CELLS // max(1, len(index.keys))))
        for batch in batches:
            ids, texts = (c.to_pylist() for c in batch.columns)
            for start in range(0, len(ids), group):
                found = []
                for row, text in enumerate(texts[start : start + group]):
                    words = terms(text)
                    long = 8 * (25 + 75 * len(words) * documents // length) if words else 0
                    for term, tf in Counter(words).items():
                        if (i := number.get(term)) is not None:
                            found.append((row, i, 1_000_000_000 * tf // (1000 * tf + long)))
                some = ids[start : start + group]
                heaps.offer(index.scores(found, len(some)), some)
        rows = [(index.keys[item], doc_id, score) for item, doc_id, score in heaps.rows()]
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows)], schema=schema)

    return docs.mapInArrow(search, "key long, doc_id long, score long")


def search_documents(
    items: DataFrame, docs: DataFrame, k: int = 10, item_id: str = "item_id", item_text: str = "text",
    doc_id: str = "doc_id", doc_text: str = "text", work: Scratch | None = None,
) -> DataFrame:
    """The ``k`` documents that score highest for each item: ``item_id, rank, doc_id, score``.

    Terms, weights and scores are whole numbers (see the README); only scores above 0 count,
    equal ones come by ascending id, null ids last. Every row of ``items`` is an item of its own,
    also when ids repeat or are null; every row of ``docs`` is a document. Items and documents
    without terms (null, empty, only marks) find nothing and are not found. Empty tables give no
    rows; other columns are not read.

    The index over the items' terms is broadcast, in parts of at most ``INDEX_BYTES`` of item
    text, and the documents stream past each part twice: once to count, once to score. What a
    task keeps is a heap of ``k`` documents per item of a part. Heaps are merged in two steps,
    so that no task gets all the heaps of an item at once. ``work`` receives the table of numbered
    items, for the caller to clear.
    """
    spark = docs.sparkSession
    work = work or Scratch(spark, "search")
    listed = work.stored(numbered(items, item_id, item_text), "items")
    rows = batched(docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(doc_text).alias("text")))
    parts = listed.agg(F.max("part")).first()[0]
    best = spark.createDataFrame([], "key long, doc_id long, score long")
    for part in range(-1 if parts is None else parts + 1):
        texts = listed.where(F.col("part") == part).select("key", "text").collect()  # at most INDEX_BYTES
        best = best.unionByName(best_of_part(rows, Index([tuple(r) for r in texts]), k))
    order = [F.col("score").desc(), F.col("doc_id").asc_nulls_last()]
    dealt = best.withColumn("deal", F.pmod(F.xxhash64("doc_id", "score"), F.lit(MERGE_PARTS)))
    some = dealt.withColumn("rank", F.row_number().over(Window.partitionBy("key", "deal").orderBy(*order))).where(F.col("rank") <= k)
    last = some.withColumn("rank", F.row_number().over(Window.partitionBy("key").orderBy(*order))).where(F.col("rank") <= k)
    named = last.join(listed.select("key", "item_id"), "key")
    return named.select("item_id", F.col("rank").cast("int").alias("rank"), "doc_id", "score")


SEARCH_SQL = r"""
WITH d AS (
  SELECT doc_id, row_number() OVER () AS rid,
    regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS t
  FROM documents WHERE text IS NOT NULL
), p AS (SELECT rid, doc_id, len(t)::BIGINT AS n, unnest(t) AS term FROM d),
tf AS (SELECT rid, doc_id, n, term, count(*)::BIGINT AS tf FROM p GROUP BY rid, doc_id, n, term),
whole AS (SELECT count(*)::BIGINT AS nd, sum(len(t))::BIGINT AS l FROM d WHERE len(t) > 0),
i AS (
  SELECT item_id, row_number() OVER () AS iid, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term
  FROM benchmark WHERE text IS NOT NULL
), it AS (SELECT iid, item_id, term, count(*)::BIGINT AS k FROM i GROUP BY iid, item_id, term),
w AS (
  SELECT term, floor(1000 * ln((2 * nd + 2)::DOUBLE / (2 * df + 1)::DOUBLE))::BIGINT AS w
  FROM (SELECT term, count(*)::BIGINT AS df FROM tf GROUP BY term), whole
), s AS (
  SELECT iid, any_value(item_id) AS item_id, rid, any_value(doc_id) AS doc_id,
    sum(k * w * ((1000000000 * tf) // (1000 * tf + 8 * (100 - 75 + ((75 * n * nd) // l)))))::BIGINT AS score
  FROM it JOIN tf USING (term) JOIN w USING (term), whole
  GROUP BY iid, rid
), r AS (SELECT *, row_number() OVER (PARTITION BY iid ORDER BY score DESC, doc_id ASC NULLS LAST) AS rank FROM s WHERE score > 0)
SELECT item_id, rank::INTEGER AS rank, doc_id, score FROM r WHERE rank <= 10
"""


@query("op12_search", SEARCH_SQL)
def op12_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search_documents(table(spark, sf_dir, "benchmark"), table(spark, sf_dir, "documents"))
