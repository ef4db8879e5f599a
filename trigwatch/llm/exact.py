"""Exact duplicates by Patricia tries over whole byte strings."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trigwatch.llm.common import Scratch, attach_groups, batched, filled, table
from trigwatch.llm.registry import query

#: memory that a task's trie may take before its largest subtrees go out
TRIE_BYTES = 64 << 20
#: memory of a node and of a terminal's values, beside the bytes of its label
NODE_BYTES, TERMINAL_BYTES = 190, 40


class Trie:
    """A compressed radix trie over byte strings; a terminal keeps the owner and the row count.

    A node is ``[label, children by first byte or None, owner, count]``; a count of 0 means that
    no string ends there, one below 0 that the subtree has gone out: strings that lead into it
    are refused. ``held`` estimates the memory taken, nodes and tables included.
    """

    def __init__(self) -> None:
        self.root: list = [b"", None, None, 0]
        self.held = NODE_BYTES

    def add(self, text: bytes, owner: int | None, count: int) -> bool:
        """Whether the string was taken in; False if its subtree has gone out."""
        node, at, end = self.root, 0, len(text)
        while at < end:
            first = text[at]
            child = node[1].get(first) if node[1] else None
            if child is None:
                child = [text[at:], None, None, 0]
                self.held += NODE_BYTES + end - at
                self._link(node, first, child)
                node = child
                break
            if child[3] < 0:
                return False
            label = child[0]
            if not text.startswith(label, at):
                same = _common(text, at, label)
                upper = [label[:same], {label[same]: child}, None, 0]
                child[0] = label[same:]
                self.held += NODE_BYTES
                node[1][first] = upper
                child = upper
            node = child
            at += len(child[0])
        if not node[3]:
            self.held += TERMINAL_BYTES
        if owner is not None and (node[2] is None or owner > node[2]):
            node[2] = owner
        node[3] += count
        return True

    @staticmethod
    def _link(node: list, first: int, child: list) -> None:
        if node[1] is None:
            node[1] = {}
        node[1][first] = child

    def terminals(self, node: list | None = None, before: bytes = b"") -> Iterator[tuple[bytes, int | None, int]]:
        """Every string below a node with its owner and count; ``before`` leads to the node."""
        stack = [(self.root if node is None else node, before)]
        while stack:
            node, before = stack.pop()
            text = before + node[0]
            if node[3] > 0:
                yield text, node[2], node[3]
            if node[1]:
                stack.extend((child, text) for child in node[1].values())

    def _sizes(self) -> dict[int, int]:
        """Memory of the subtree of every node, by the node's identity."""
        order, stack = [], [self.root]
        while stack:
            node = stack.pop()
            order.append(node)
            if node[1]:
                stack.extend(node[1].values())
        sizes: dict[int, int] = {}
        for node in reversed(order):
            own = NODE_BYTES + len(node[0]) + (TERMINAL_BYTES if node[3] > 0 else 0)
            sizes[id(node)] = own + (sum(sizes[id(c)] for c in node[1].values()) if node[1] else 0)
        return sizes

    def spill(self, most: int) -> Iterator[tuple[bytes, int | None, int]]:
        """Send out the largest subtrees until the rest takes at most ``most``; something always
        stays, unless a single path is all there is. Their strings come out one by one."""
        sizes = self._sizes()
        node, before = self.root, b""
        # down the only path, to where the trie first branches or a string ends
        while node[3] <= 0 and node[1] and len(node[1]) == 1:
            (child,) = node[1].values()
            if child[3] < 0:
                return
            node, before = child, before + node[0]
        if not node[1]:
            return
        before += node[0]
        subtrees = sorted((c for c in node[1].items() if c[1][3] >= 0), key=lambda c: -sizes[id(c[1])])
        left = len(subtrees) + (node[3] > 0)
        for first, child in subtrees:
            if self.held <= most or left <= 1:
                break
            left -= 1
            yield from self.terminals(child, before)
            self.held -= sizes[id(child)] - NODE_BYTES
            node[1][first] = [b"", None, None, -1]


def _common(text: bytes, at: int, label: bytes) -> int:
    """Length of the common prefix of ``text[at:]`` and ``label``, by halving."""
    low, high = 0, min(len(text) - at, len(label))
    while low < high:
        mid = (low + high + 1) // 2
        if text.startswith(label[low:mid], at + low):
            low = mid
        else:
            high = mid - 1
    return low


#: a string that has gone out has its text, one whose owner is settled the hash of its text
PARTS = "text binary, owner long, n long, sha string"
PART_SCHEMA = pa.schema([("text", pa.binary()), ("owner", pa.int64()), ("n", pa.int64()), ("sha", pa.string())])


def _batches(rows: Iterator[tuple], most_bytes: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    held, size = [], 0
    for row in rows:
        held.append(row)
        size += len(row[0] or b"")
        if size > most_bytes or len(held) == 4096:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), PART_SCHEMA)], schema=PART_SCHEMA)
            held, size = [], 0
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), PART_SCHEMA)], schema=PART_SCHEMA)


def _owners(batches, most: int, settle: bool) -> Iterator[pa.RecordBatch]:
    """One trie for all strings of a partition; what it has no room for goes out by subtrees.

    With ``settle`` a string that is left in the trie at the end is settled: all its copies came
    here and none went out. Otherwise strings are only combined ahead of the shuffle.
    """
    trie = Trie()

    def rows():
        for batch in batches:
            for text, owner, n in zip(*(c.to_pylist() for c in batch.columns)):
                if not trie.add(text, owner, n):
                    yield text, owner, n, None
                elif trie.held > most:
                    for string in trie.spill(most // 2):
                        yield *string, None
        for text, owner, n in trie.terminals():
            if settle:
                yield None, owner, n, hashlib.sha256(text).hexdigest()
            else:
                yield text, owner, n, None

    yield from _batches(rows())


def owners(docs: DataFrame, work: Scratch, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``text_sha256, keep_id, group_size``, one row per distinct text, from tries alone.

    Strings are dealt by length and content hash, so all copies of one meet in one trie. What its
    tasks sent out by subtree lies in the shared folder and is dealt anew, to as many tasks as
    its size asks for, until nothing is left; each round settles what stayed in its tries.
    """
    most = TRIE_BYTES
    rows = docs.select(filled(text_col).cast("binary").alias("text"), F.col(id_col).cast("long").alias("owner"), F.lit(1).cast("long").alias("n"))
    open_ = batched(rows).mapInArrow(lambda it: _owners(it, most, False), PARTS).select("text", "owner", "n")
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    settled = None
    while True:
        dealt = open_.repartition(parts, F.octet_length("text"), F.xxhash64("text"))
        done = work.stored(dealt.mapInArrow(lambda it: _owners(it, most, True), PARTS), "owners")
        here = done.where(F.col("sha").isNotNull()).select(F.col("sha").alias("text_sha256"), F.col("owner").alias("keep_id"), F.col("n").alias("group_size"))
        settled = here if settled is None else settled.unionByName(here)
        open_ = done.where(F.col("sha").isNull()).select("text", "owner", "n")
        size = open_.agg(F.sum(F.octet_length("text") + F.lit(2 * NODE_BYTES))).first()[0]
        if size is None:
            return settled
        parts = max(parts, -(-4 * size // most))


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", work: Scratch | None = None) -> DataFrame:
    """Owner and size of the group of equal texts of every row.

    Returns ``id_col, keep_id, group_size, kept, text_sha256``, one row per input row. Texts
    are equal when their UTF-8 bytes are; null counts as the empty text, which is a group like
    any other. The largest id of a group stays; null ids never own a group unless it has no
    other, then ``keep_id`` is null and its rows are kept. Rows that repeat the owner's id
    with the same text are all kept: being kept belongs to the id. Other columns of ``docs``
    are not read.

    Each task first combines its own copies in a trie, so a text that fills a third of all rows
    crosses the shuffle once per task, or a few times if its subtree went out. A trie takes at most about
    ``TRIE_BYTES`` of memory, or one string if that is longer. ``work`` receives the tables on the way,
    for the caller to clear when the result has been read.
    """
    groups = owners(docs, work or Scratch(docs.sparkSession, "exact"), id_col, text_col)
    members = docs.select(F.col(id_col).cast("long").alias(id_col), F.sha2(filled(text_col), 256).alias("text_sha256"))
    out = attach_groups(members, groups, "text_sha256", "group_size", [id_col])
    return out.select(id_col, "keep_id", "group_size", F.coalesce(F.col(id_col) == F.col("keep_id"), F.col("keep_id").isNull()).alias("kept"), "text_sha256")


@query(
    "op6_exact_dedup",
    """SELECT doc_id, max(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size,
       coalesce(doc_id = max(doc_id) OVER same, max(doc_id) OVER same IS NULL) AS kept, sha256(coalesce(text, '')) AS text_sha256
       FROM documents WINDOW same AS (PARTITION BY coalesce(text, ''))""",
)
def op6_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_groups(table(spark, sf_dir, "documents"))
