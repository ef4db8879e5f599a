"""Hard negatives by a secondary sort: each anchor's pairs arrive in order of their score."""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from trigwatch.llm.common import Scratch, batched, table
from trigwatch.llm.registry import query

#: anchors that are compared in one pass over the rows, and scores that a task holds at a time
ANCHORS, CELLS = 1 << 13, 1 << 21
#: parts in which an anchor's positives are merged before the last merge
MERGE_PARTS = 64
#: order-preserving key: anchor, descending score, positives before negatives, id
KEY, SIGN = struct.Struct(">QQBQ"), 1 << 63
PAIR = "anchor long, score long, negative boolean, vec_id long"
PAIR_SCHEMA = pa.schema([("anchor", pa.int64()), ("score", pa.int64()), ("negative", pa.bool_()), ("vec_id", pa.int64())])


def pack(anchor: int, score: int, negative: bool, vec_id: int) -> bytes:
    """Bytes that sort like (anchor, -score, negative, vec_id)."""
    return KEY.pack(anchor, SIGN - 1 - score, negative, vec_id + SIGN)


def unpack(key: bytes) -> tuple[int, int, bool, int]:
    anchor, score, negative, vec_id = KEY.unpack(key)
    return anchor, SIGN - 1 - score, bool(negative), vec_id - SIGN


def usable(vectors: DataFrame, id_col: str, vector_col: str, label: Column) -> DataFrame:
    """``vec_id, label, vector``: rows with id, label and a vector of finite components, each
    component x as floor(256 x)."""
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), label.cast("long").alias("label"), F.col(vector_col).cast("array<double>").alias("vector"))
    finite = F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    kept = rows.where(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("vector").isNotNull()).where(finite)
    return kept.withColumn("vector", F.transform("vector", lambda x: F.floor(x * 256.0)))


def matrix(vectors: pa.ListArray, width: int) -> np.ndarray:
    """A row per vector, as whole numbers; a short vector goes on with zeros."""
    ends = vectors.offsets.to_numpy()
    values = vectors.values.to_numpy()
    sizes = np.diff(ends)
    if len(sizes) and (sizes == width).all():
        return values[ends[0] : ends[-1]].reshape(-1, width)
    out = np.zeros((len(sizes), width), np.int64)
    for i, (start, n) in enumerate(zip(ends.tolist(), np.minimum(sizes, width).tolist())):
        out[i, :n] = values[start : start + n]
    return out


def products(rows: np.ndarray, anchors: np.ndarray) -> np.ndarray:
    """Exact inner products. Floating point adds whole numbers exactly below 2^24 or 2^53, and
    every partial sum is below the bound; beyond 2^53 whole numbers are multiplied."""
    most = int(np.abs(rows).max(initial=0)) * int(np.abs(anchors).max(initial=0)) * max(1, rows.shape[1])
    if most < 1 << 24:
        return (rows.astype(np.float32) @ anchors.astype(np.float32).T).astype(np.int64)
    if most < 1 << 53:
        return (rows.astype(np.float64) @ anchors.astype(np.float64).T).astype(np.int64)
    if most < 1 << 63:
        return rows @ anchors.T
    raise ValueError("an inner product may pass 64 bits")


class Best:
    """The ``k`` best rows of each of many windows: higher scores first, equal ones by smaller id."""

    def __init__(self, low: np.ndarray, k: int) -> None:
        self.floor, self.k = low.copy(), k  # what is lower than the floor cannot enter
        self.held = np.empty((4, 0), np.int64)  # window, score, id, row

    def offer(self, *found: np.ndarray) -> None:
        """Windows, scores, ids and row numbers of what may enter."""
        if not len(found[0]):
            return
        held = np.concatenate([self.held, np.stack(found)], axis=1)
        held = held[:, np.lexsort((held[3], held[2], -held[1], held[0]))]
        place = np.arange(held.shape[1]) - np.searchsorted(held[0], held[0], "left")
        keep = place < self.k
        self.held, full = held[:, keep], place[keep] == self.k - 1
        # an equal score can still enter by a smaller id
        self.floor[self.held[0, full]] = self.held[1, full]


def blocks(batches: Iterable[pa.RecordBatch], vectors: np.ndarray) -> Iterator[tuple[np.ndarray, ...]]:
    """Ids, labels, numbers within the task and scores (a column per anchor) of some rows at a time."""
    step, number = max(16, CELLS // max(1, len(vectors))), 0
    for batch in batches:
        for at in range(0, batch.num_rows, step):
            some = batch.slice(at, step)
            scores = products(matrix(some.column(2), vectors.shape[1]), vectors)
            yield some.column(0).to_numpy(), some.column(1).to_numpy(), np.arange(number, number + some.num_rows), scores
            number += some.num_rows


def positive_pairs(rows: DataFrame, sent, k: int) -> DataFrame:
    """Per task the ``k`` best rows of the label of each anchor."""

    def run(batches):
        keys, ids, labels, vectors = sent.value
        best = Best(np.full(len(keys), np.iinfo(np.int64).min), k)
        for row_ids, row_labels, numbers, scores in blocks(batches, vectors):
            row, anchor = np.nonzero((scores >= best.floor) & (row_labels[:, None] == labels) & (row_ids[:, None] != ids))
            best.offer(anchor, scores[row, anchor], row_ids[row], numbers[row])
        yield pairs(keys[best.held[0]], best.held[1], False, best.held[2])

    return rows.mapInArrow(run, PAIR)


def negative_pairs(rows: DataFrame, sent, k: int) -> DataFrame:
    """Per task the ``k`` best rows of other labels in each positive's window."""

    def run(batches):
        keys, labels, vectors, owner, low, high = sent.value
        best = Best(low, k)
        turn = np.arange(len(owner)) - np.searchsorted(owner, owner, "left")
        turns = [np.flatnonzero(turn == t) for t in range(int(turn.max(initial=-1)) + 1)]
        for row_ids, row_labels, numbers, scores in blocks(batches, vectors):
            other, found = row_labels[:, None] != labels, []
            for windows in turns:  # the first window of every anchor, then the second
                of = owner[windows]
                seen = scores[:, of]
                row, place = np.nonzero((seen >= best.floor[windows]) & (seen <= high[windows]) & other[:, of])
                found.append((windows[place], seen[row, place], row_ids[row], numbers[row]))
            if found:
                best.offer(*map(np.concatenate, zip(*found)))
        held = best.held.copy()
        held[0] = owner[held[0]]
        held = np.unique(held, axis=1)  # a row in two windows of an anchor travels once
        yield pairs(keys[held[0]], held[1], True, held[2])

    return rows.mapInArrow(run, PAIR)


def pairs(keys: np.ndarray, scores: np.ndarray, negative: bool, ids: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c) for c in (keys, scores, np.full(len(keys), negative), ids)], schema=PAIR_SCHEMA)


def best_of(found: DataFrame, k: int) -> DataFrame:
    """The ``k`` best pairs per anchor of all tasks' best, merged in two steps."""
    order = [F.col("score").desc(), F.col("vec_id")]
    dealt = found.withColumn("deal", F.pmod(F.xxhash64("vec_id"), F.lit(MERGE_PARTS)))
    some = dealt.withColumn("place", F.row_number().over(Window.partitionBy("anchor", "deal").orderBy(*order))).where(F.col("place") <= k)
    last = some.withColumn("place", F.row_number().over(Window.partitionBy("anchor").orderBy(*order))).where(F.col("place") <= k)
    return last.select(*PAIR_SCHEMA.names)


def mined(keys: Iterable[bytes], positives: int, negatives: int, least: int, most: int) -> Iterator[tuple[int, ...]]:
    """Negatives of every window, from keys in their order.

    The first positives of an anchor open windows of scores; each negative that follows goes to
    the open windows that it lies in, and a window closes when it is full or the scores have
    fallen below it. Only the anchor's open windows are held.
    """
    current, windows, opened = None, [], 0
    for key in keys:
        anchor, score, negative, vec_id = unpack(key)
        if anchor != current:
            current, windows, opened = anchor, [], 0
        if not negative:
            if opened < positives:
                windows.append([vec_id, score, 0])
                opened += 1
            continue
        for window in windows:
            positive_id, top, given = window
            if least * top <= 100 * score <= most * top and given < negatives:
                window[2] = given + 1
                yield anchor, positive_id, given + 1, vec_id, top, score
        windows = [w for w in windows if w[2] < negatives and 100 * score >= least * w[1]]


def hard_negatives(
    vectors: DataFrame, anchors: Column, label: Column | None = None, id_col: str = "vec_id", vector_col: str = "embedding",
    positives: int = 5, negatives: int = 10, least: int = 30, most: int = 90, work: Scratch | None = None,
) -> DataFrame:
    """For each anchor and each of its ``positives`` best rows of the same label, the first
    ``negatives`` rows of other labels whose score is ``least`` to ``most`` hundredths of the
    positive's: ``anchor_id, positive_id, rank, negative_id, positive_score, negative_score``.

    ``anchors`` chooses the rows that are queries; all rows are compared with them. A score is
    the whole-number inner product of floor(256 x); equal scores go by smaller id. Rows without
    id, label or vector, or with a null or non-finite component, take no part; a shorter vector
    counts as followed by zeros. Positives are rows with another id than the anchor. A row that
    repeats is a row (and an anchor) of its own. A score that may pass 64 bits is an error. Anchors without positives, and positives with nothing in their window, give no rows;
    an empty table gives none. Other columns are not read.

    Anchors are broadcast ``ANCHORS`` at a time, and blocks of rows are multiplied with them. A task keeps
    its best rows per anchor, first of the same label, then, with the positives known, of each
    positive's window, so what is shuffled is bounded by anchors times tasks and the whole result follows
    from it. The pairs' keys are shuffled by anchor and sorted inside partitions, and one pass
    over each partition opens windows and emits negatives, without collecting an anchor's rows.
    """
    spark = vectors.sparkSession
    work = work or Scratch(spark, "negatives")
    label = F.col("label") if label is None else label
    rows = batched(usable(vectors, id_col, vector_col, label))
    asked = usable(vectors.where(anchors), id_col, vector_col, label)
    listed = work.stored(asked.withColumn("key", F.monotonically_increasing_id()), "anchors")
    n, width = listed.agg(F.count(F.lit(1)), F.max(F.size("vector"))).first()
    passes = -(-n // ANCHORS)
    turn_of = F.pmod(F.xxhash64("key"), F.lit(max(1, passes)))
    found = spark.createDataFrame([], PAIR)
    for turn in range(passes):
        block = listed.where(turn_of == turn).select("key", "vec_id", "label", "vector").toArrow()
        if not block.num_rows:
            continue
        keys, ids, labels = (block.column(i).to_numpy() for i in range(3))
        queries = matrix(block.column(3).combine_chunks(), max(1, width))
        sent = spark.sparkContext.broadcast((keys, ids, labels, queries))
        near = work.stored(best_of(positive_pairs(rows, sent, positives), positives), "positives")
        top = near.select("anchor", "score").toArrow()  # a few per anchor of this pass
        place = {key: i for i, key in enumerate(keys.tolist())}
        owner = np.array([place[a] for a in top.column(0).to_pylist()], np.int64)
        order = np.argsort(owner, kind="stable")
        owner, score = owner[order], top.column(1).to_numpy()[order]
        windows = spark.sparkContext.broadcast((keys, labels, queries, owner, -(-least * score // 100), most * score // 100))
        found = found.unionByName(near).unionByName(negative_pairs(rows, windows, negatives))
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    keyed = found.rdd.map(lambda r: (pack(*r), None))
    in_order = keyed.repartitionAndSortWithinPartitions(tasks, lambda key: zlib.crc32(key[:8]))
    rows_out = in_order.mapPartitions(lambda part: mined((key for key, _ in part), positives, negatives, least, most))
    out = spark.createDataFrame(rows_out, "key long, positive_id long, rank int, negative_id long, positive_score long, negative_score long", verifySchema=False)
    names = listed.select("key", F.col("vec_id").alias("anchor_id"))
    return out.join(names, "key").select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


NEGATIVES_SQL = """
WITH v AS (
  SELECT row_number() OVER () AS row, vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
    list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS q
  FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT a.row AS anchor, a.vec_id AS anchor_id, v.row, v.vec_id, a.label = v.label AS same, list_inner_product(a.q, v.q)::BIGINT AS score
  FROM v a, v WHERE a.vec_id % 100 = 0 AND (a.vec_id <> v.vec_id OR a.label <> v.label)
), p AS (
  SELECT * FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor ORDER BY score DESC, vec_id) <= 5
), n AS (
  SELECT p.anchor_id, p.vec_id AS positive_id, s.vec_id AS negative_id, p.score AS positive_score, s.score AS negative_score,
    row_number() OVER (PARTITION BY p.anchor, p.row ORDER BY s.score DESC, s.vec_id)::INTEGER AS rank
  FROM p JOIN s ON p.anchor = s.anchor AND NOT s.same AND 30 * p.score <= 100 * s.score AND 100 * s.score <= 90 * p.score
)
SELECT anchor_id, positive_id, rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 10
"""


@query("op11_hard_negatives", NEGATIVES_SQL)
def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    vec_id, label = F.col("vec_id"), F.col("label")
    moved = F.when(vec_id % 7 == 0, (label + 1) % 10).otherwise(label)
    return hard_negatives(table(spark, sf_dir, "embeddings"), vec_id % 100 == 0, moved)
