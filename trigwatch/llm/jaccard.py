"""N-gram Jaccard join: adaptive prefixes with several required matches."""

from __future__ import annotations

import hashlib
from collections import OrderedDict

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from trigwatch.llm.common import Scratch, attach_groups, batched, filled, fresh, stored, table
from trigwatch.llm.graph import components
from trigwatch.llm.registry import query
from trigwatch.llm.wordhash import runs, shingles, words

#: counters of each frequency sketch (shingles, words), and pieces in which they are summed
SKETCH, PIECES = 1 << 20, 64
#: most matches that a prefix may be lengthened for; cost of a verification in list entries
MOST_MATCHES, VERIFY_COST = 8, 20.0
#: a token expected in so many sets is dealt by set
HOT_SETS = 4096
#: bits of the filter of texts that verification needs
FILTER_BITS = 1 << 23
#: most rounds that compare a list with its central member only, before all that remain are compared
STAR_ROUNDS = 2
CACHE_BYTES = 32 << 20


def needed(n, percent: int):
    """Fewest shared shingles of a set of size ``n`` with any set that it links with."""
    return -(-n * percent // 100)


def choose_matches(frequency: np.ndarray, n: int, percent: int) -> int:
    """How many shared prefix tokens to ask for, by estimated cost.

    ``frequency`` has the estimated list lengths of the tokens in prefix order. Asking for
    ``l`` matches needs a prefix longer by ``l - 1`` tokens, so more list entries are read;
    a candidate then takes up ``l`` of them, so at most one in ``l`` entries leads to a
    verification.
    """
    most = min(MOST_MATCHES, needed(n, percent))
    first = n - needed(n, percent)
    entries = np.cumsum(frequency[: first + most])[first:]
    cost = entries * (1 + VERIFY_COST / np.arange(1, len(entries) + 1))
    return int(np.argmin(cost)) + 1


def node_of(tokens: np.ndarray) -> int:
    """Identity of a shingle set."""
    return int.from_bytes(hashlib.blake2b(tokens.tobytes(), digest_size=8).digest(), "little", signed=True)


def _scan(docs: DataFrame, k: int, work: Scratch) -> DataFrame:
    """One pass over all texts: set size and identity of each, and the pieces of two frequency
    sketches, of the shingles of each set and of all words."""
    schema = pa.schema([("doc_id", pa.int64()), ("text_key", pa.int64()), ("n", pa.int64()), ("node", pa.int64()), ("piece", pa.int32()), ("counts", pa.binary())])

    def scan(batches):
        counts, waiting, held = np.zeros((2, SKETCH), np.int64), ([], []), 0

        def count():
            for row, hashes in zip(counts, waiting):
                row += np.bincount(np.concatenate(hashes).astype(np.int64), minlength=SKETCH)
                hashes.clear()

        for batch in batches:
            sizes, nodes = [], []
            for text in batch.column(2):
                w = words(text.as_py())
                s = shingles(w, k)
                sizes.append(len(s))
                nodes.append(node_of(s) if len(s) else None)
                waiting[0].append(s >> np.uint64(44))
                waiting[1].append(w >> np.uint64(44))
                held += len(w)
                if held > 1 << 19:
                    count()
                    held = 0
            none = pa.nulls(len(sizes))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(sizes, pa.int64()), pa.array(nodes, pa.int64()), none.cast(pa.int32()), none.cast(pa.binary())], schema=schema)
        if held:
            count()
        if counts.any():
            zip_ = zstandard.ZstdCompressor(level=1)
            parts = [zip_.compress(c.astype("<u4").tobytes()) for c in counts.reshape(2 * PIECES, -1)]
            none = pa.nulls(len(parts)).cast(pa.int64())
            yield pa.RecordBatch.from_arrays([none, none, none, none, pa.array(range(len(parts)), pa.int32()), pa.array(parts, pa.binary())], schema=schema)

    return work.stored(batched(docs).mapInArrow(scan, "doc_id long, text_key long, n long, node long, piece int, counts binary"), "scan")


def _sketch(scan: DataFrame) -> np.ndarray:
    """Sums of the tasks' sketches: a fixed number of counters, whatever the input."""
    schema = pa.schema([("piece", pa.int32()), ("counts", pa.binary())])

    def add(batches):
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for piece, data in zip(batch.column(0).to_pylist(), batch.column(1)):
                counts = np.frombuffer(zstandard.ZstdDecompressor().decompress(data.as_py()), "<u4").astype(np.int64)
                sums[piece] = sums[piece] + counts if piece in sums else counts
        yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array([s.tobytes() for s in sums.values()], pa.binary())], schema=schema)

    pieces = scan.where("piece IS NOT NULL").select("piece", "counts").repartition(PIECES, "piece")
    out = np.zeros((2 * PIECES, SKETCH // PIECES), np.int64)
    for piece, data in pieces.mapInArrow(add, "piece int, counts binary").collect():
        out[piece] = np.frombuffer(data, np.int64)
    return out.reshape(2, SKETCH)


class Rarity:
    """How many sets are expected to have a shingle, as a power of two in steps of a quarter.

    Its words' frequencies tell how often it comes about by chance. A shared passage is no
    chance: its shingles stand out of their sketch counters, which decides where it is more.
    Both depend on the shingle only, so all sets are ordered alike.
    """

    def __init__(self, counts: np.ndarray) -> None:
        shingles_, words_ = counts
        total = max(1, int(words_.sum()))
        self.total = np.float32(np.log2(total))
        self.word = (np.log2(np.maximum(words_, 1)) - np.log2(total)).astype(np.float32)
        load = float(np.median(shingles_))
        over = shingles_ - load - 6 * np.sqrt(load + 1)
        self.passage = np.where(over > 0, np.log2(np.maximum(shingles_ - load, 1)), -32).astype(np.float32)

    def steps(self, w: np.ndarray, tokens: np.ndarray, k: int) -> np.ndarray:
        """0 to 255 for the run of ``k`` words at each word, whose hashes ``tokens`` are."""
        p = self.word[(w >> np.uint64(44)).astype(np.int64)]
        chance = sum(p[j : len(tokens) + j] for j in range(min(k, len(p) - len(tokens) + 1))) + self.total
        level = np.maximum(chance, self.passage[(tokens >> np.uint64(44)).astype(np.int64)])
        return ((np.clip(level, -32, 31.75) + 32) * 4).astype(np.uint8)


def _postings(docs: DataFrame, k: int, percent: int, counts: np.ndarray, work: Scratch) -> DataFrame:
    """``token, node, meta, hot`` for the prefix of each set; meta is the token's place (from 1),
    the set size and the matches chosen; hot tokens are expected in ``HOT_SETS`` sets or more.

    Tokens stand in one global order: expected frequency, then hash. Any total order is right;
    rare tokens first keep lists short.
    """
    rarity = Rarity(counts)
    schema = pa.schema([("token", pa.int64()), ("node", pa.int64()), ("meta", pa.int64()), ("hot", pa.bool_())])
    hot_step = int((np.log2(HOT_SETS) + 32) * 4)

    def emit(batches):
        seen: set[int] = set()
        for batch in batches:
            tokens, nodes, metas, hots = [], [], [], []
            for text in batch.column(0):
                w = words(text.as_py())
                every = runs(w, k)
                s, at = np.unique(every, return_index=True)
                if not len(s) or (node := node_of(s)) in seen:
                    continue
                seen.add(node)
                n, steps = len(s), rarity.steps(w, every, k)[at]
                first = n - needed(n, percent) + min(MOST_MATCHES, needed(n, percent))
                rank = (steps.astype(np.uint64) << np.uint64(56)) | (s >> np.uint64(8))
                order = np.argpartition(rank, first - 1)[:first] if first < n else np.arange(n)
                order = order[np.argsort(rank[order])]
                l = choose_matches(np.exp2(steps[order] / 4.0 - 32) + 0.1, n, percent)
                mine = s[order[: n - needed(n, percent) + l]].view(np.int64)
                tokens.append(mine)
                nodes.append(np.full(len(mine), node, np.int64))
                metas.append(np.arange(1, len(mine) + 1) << 36 | n << 4 | l)
                hots.append(steps[order[: len(mine)]] >= hot_step)
            if tokens:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in (tokens, nodes, metas, hots)], schema=schema)

    return work.stored(batched(docs).select("text").mapInArrow(emit, "token long, node long, meta long, hot boolean"), "postings")


def _met(postings: DataFrame, work: Scratch) -> DataFrame:
    """``token, node, meta`` of the tokens that at least two sets have in their prefix, once each.

    Sorted by token, a stream of rows tells with one row held back. A token that is expected
    in very many sets would make one task's stream long; it is taken as met, and its rows are
    dealt by set.
    """
    schema = pa.schema([(c, pa.int64()) for c in ("token", "node", "meta")])

    def keep(batches):
        held = np.empty((3, 0), np.int64)  # the last row, if its token has not been met again
        last, met = None, None
        for batch in batches:
            rows = np.concatenate([held, np.stack([c.to_numpy() for c in batch.columns])], axis=1)
            same = (rows[0, 1:] == rows[0, :-1]) & (rows[1, 1:] == rows[1, :-1])
            fresh_ = np.concatenate([[held.shape[1] > 0 or (rows[0, 0], rows[1, 0]) != last], ~same])
            rows = rows[:, fresh_]
            if not rows.shape[1]:
                continue
            token = rows[0]
            again = token[1:] == token[:-1]
            out = np.zeros(len(token), bool)
            out[1:] |= again
            out[:-1] |= again
            out |= token == met if met is not None else False
            last = (token[-1], rows[1, -1])
            held = np.empty((3, 0), np.int64) if out[-1] else rows[:, -1:]
            met = token[-1] if out[-1] else met
            if out.any():
                yield pa.RecordBatch.from_arrays([pa.array(r) for r in rows[:, out]], schema=schema)

    parts = int(postings.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    cold = postings.where("NOT hot").drop("hot").repartition(parts, "token").sortWithinPartitions("token", "node")
    hot = postings.where("hot").drop("hot").distinct()
    return work.stored(cold.mapInArrow(keep, "token long, node long, meta long").unionByName(hot), "met")


def alpha(percent: int) -> Column:
    """Fewest tokens that linked sets of sizes ``a_n`` and ``b_n`` share."""
    return F.ceil((F.col("a_n") + F.col("b_n")) * percent / (100 + percent))


def asked(percent: int) -> Column:
    """Tokens that the whole prefixes of linked sets share at least.

    Of the set whose prefix ends first, a shared token lies either in both prefixes or behind
    its own; ``needed - l`` tokens lie behind a prefix made for ``l`` matches. So each match
    that a prefix is lengthened for is a match more to ask for.
    """
    return alpha(percent) - F.greatest(*[F.ceil(F.col(f"{x}_n") * percent / 100) - F.col(f"{x}_l") for x in "ab"])


def early(percent: int) -> Column:
    """Whether a shared token can be the first of a linked pair: it stands among the first
    ``n - alpha + 1`` tokens of both."""
    return (F.col("a_p") <= F.col("a_n") - alpha(percent) + 1) & (F.col("b_p") <= F.col("b_n") - alpha(percent) + 1)


def _texts(docs: DataFrame, wanted: DataFrame, work: Scratch) -> DataFrame:
    """``node, text`` for the wanted ``node, text_key``; a bit filter keeps other texts out of the shuffle."""
    slot = F.pmod(F.col("text_key"), F.lit(FILTER_BITS))
    parts = wanted.select(F.expr(f"bitmap_bucket_number(pmod(text_key, {FILTER_BITS}) + 1)").alias("at"), F.expr(f"bitmap_bit_position(pmod(text_key, {FILTER_BITS}) + 1)").alias("bit"))
    bits = np.zeros((FILTER_BITS // 32768 + 1, 4096), np.uint8)
    for at, data in parts.groupBy("at").agg(F.expr("bitmap_construct_agg(bit)")).collect():
        bits[at - 1] = np.frombuffer(data, np.uint8)
    bits = bits.ravel()

    def keep(batches):
        seen: set[int] = set()
        for batch in batches:
            at = batch.column(2).to_numpy()
            hit = (bits[at >> 3] >> (at & 7).astype(np.uint8)) & 1
            keys, rows = batch.column(0).to_pylist(), []
            for i in np.flatnonzero(hit):
                if keys[i] not in seen:
                    seen.add(keys[i])
                    rows.append(i)
            if rows:
                yield batch.take(pa.array(rows)).select([0, 1])

    found = batched(docs).select("text_key", "text", slot.alias("slot")).mapInArrow(keep, "text_key long, text string")
    return work.stored(found.join(wanted, "text_key").groupBy("node").agg(F.first("text").alias("text")), "texts")


def _verified(pairs: DataFrame, docs: DataFrame, nodes: DataFrame, k: int, percent: int, work: Scratch) -> DataFrame:
    """``a, b, links`` for the pairs: whether the whole sets, made anew from whole texts, are similar enough."""
    pairs = work.stored(pairs, "pairs")
    ends = pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct()
    texts = _texts(docs, nodes.join(ends, "node").select("node", "text_key"), work)
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("links", pa.bool_())])

    def check(batches):
        cache: OrderedDict[int, np.ndarray] = OrderedDict()
        held = 0

        def tokens(node, text):
            nonlocal held
            if node in cache:
                cache.move_to_end(node)
                return cache[node]
            s = cache[node] = shingles(words(text.as_py()), k)
            held += s.nbytes
            while held > CACHE_BYTES and len(cache) > 2:
                held -= cache.popitem(last=False)[1].nbytes
            return s

        for batch in batches:
            ids = [batch.column(0).to_pylist(), batch.column(1).to_pylist()]
            links = []
            for a, b, ta, tb in zip(*ids, batch.column(2), batch.column(3)):
                x, y = tokens(a, ta), tokens(b, tb)
                low, high = sorted((len(x), len(y)))
                if 100 * low < percent * high:
                    links.append(False)
                    continue
                same = len(x) + len(y) - len(np.union1d(x, y))
                links.append(100 * same >= percent * (len(x) + len(y) - same))
            yield pa.RecordBatch.from_arrays([pa.array(ids[0], pa.int64()), pa.array(ids[1], pa.int64()), pa.array(links, pa.bool_())], schema=schema)

    ta = texts.select(F.col("node").alias("a"), F.col("text").alias("_ta"))
    tb = texts.select(F.col("node").alias("b"), F.col("text").alias("_tb"))
    return work.stored(batched(pairs).join(ta, "a").join(tb, "b").select("a", "b", "_ta", "_tb").mapInArrow(check, "a long, b long, links boolean"), "verified")


def similar_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 5, percent: int = 80) -> DataFrame:
    """Component of every document under "the word-shingle sets are similar".

    Returns ``doc_id, n_shingles, component_id``, and ``text_key`` (a hash of the text) and
    ``group`` (the component as a number, null without words), one row per input row. Words are runs of
    bytes other than ASCII white space after lower-casing A-Z; a set has the distinct shingles
    of ``k`` words, of a shorter text all its words as one, of an empty or null text nothing.
    Two sets link when 100 * intersection >= percent * union; empty sets link with nothing.
    ``component_id`` is the smallest id reachable by links; null ids are never it unless a component has no other.
    Repeated rows and ids are rows of their own. Other columns are not read.

    Equal sets are one node. Each node's tokens stand in one global order (rare first, by a
    fixed-size frequency sketches of all texts), and its prefix is lengthened for as many
    matches as makes the estimated cost least; ``asked`` tells how many a linked pair shares. Lists of one token are compared in two steps.
    Star rounds verify each member against the list's first only, which joins groups of
    copies with one verification per document. Then only members of different components
    meet, pairs with too few shared tokens go, and all others are verified on whole texts. A
    link that is never looked at joins documents that are in one component already.

    Texts are read twice, and once more for each round of verification; what moves is prefixes
    (about a sixth of the hashes) and the texts of the documents to be verified. Every wide step is stored, and removed
    again when the result is.
    """
    text = filled(text_col)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text).alias("text_key"), text.alias("text"))
    work = Scratch(docs.sparkSession, "jaccard")
    scan = _scan(rows, k, work)
    sets = scan.where("piece IS NULL").select("doc_id", "text_key", "n", "node")
    nodes = work.stored(
        sets.where("n > 0").groupBy("node").agg(F.min("doc_id").alias("first_id"), F.min("text_key").alias("text_key"), F.count(F.lit(1)).alias("rows")),
        "nodes",
    )
    postings = _postings(rows, k, percent, _sketch(scan), work)
    met = _met(postings, work)
    sizes = met.groupBy("token").agg(F.count(F.lit(1)).alias("size"))
    # tokens that a node shares with any other, and how central it is: an original has few tokens of its own
    weights = met.join(sizes, "token").groupBy("node").agg(F.count(F.lit(1)).alias("s"), F.sum("size").alias("weight"))
    weights = work.stored(weights, "weights")
    place, size = F.shiftright("meta", 36), F.shiftright("meta", 4).bitwiseAND((1 << 32) - 1)
    shared = met.select("token", "node", place.alias("p"), size.alias("n"), (F.col("meta") % 16).alias("l")).join(weights, "node").withColumn("comp", F.col("node"))
    tried, labels = None, None

    def lists(here):
        """The lists that still hold members of different components, with the most central member."""
        ends = here.groupBy("token").agg(
            F.min("comp").alias("_lo"), F.max("comp").alias("_hi"), F.max(F.struct("weight", "node", "comp", "n", "l", "s")).alias("_first")
        )
        return work.stored(here.join(ends.where("_lo <> _hi").select("token", "_first"), "token"), "lists")

    def overlapping(pairs):
        """The pairs (``a, b, asked``) whose whole prefixes share enough tokens."""
        pairs = work.stored(pairs, "candidates")
        ends = pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct()
        prefix = work.stored(met.join(ends, "node", "left_semi").groupBy("node").agg(F.collect_list("token").alias("tokens")), "prefixes")
        both = pairs.join(prefix.select(F.col("node").alias("a"), F.col("tokens").alias("_ta")), "a")
        both = both.join(prefix.select(F.col("node").alias("b"), F.col("tokens").alias("_tb")), "b")
        return both.where(F.size(F.array_intersect("_ta", "_tb")) >= F.col("asked")).select("a", "b")

    def add(pairs):
        """Verify the pairs and join the components of those that link."""
        nonlocal tried, labels
        done = _verified(pairs, rows, nodes, k, percent, work)
        tried = done if tried is None else tried.unionByName(done)
        found = not done.where("links").isEmpty()
        if found:
            labels = components(tried.where("links").select("a", "b"), work)
        return found

    def side(frame, x, prefix=""):
        names = {x: "node", f"{x}_c": "comp", f"{x}_n": "n", f"{x}_l": "l", f"{x}_s": "s"}
        return frame.withColumns({new: F.col(prefix + old) for new, old in names.items()})

    # sets of different components and similar sizes, of which neither shares too few tokens with all others
    possible = (F.col("a_c") != F.col("b_c")) & (F.least("a_s", "b_s") >= asked(percent)) & (
        (100 * F.col("a_n") >= percent * F.col("b_n")) & (100 * F.col("b_n") >= percent * F.col("a_n"))
    )
    active = lists(shared)
    for _ in range(STAR_ROUNDS):
        stars = side(side(active, "a"), "b", "_first.").where(possible).groupBy("a", "b").agg(F.count(F.lit(1)).alias("c"), F.first(asked(percent)).alias("asked"))
        if tried is not None:
            stars = stars.join(tried.select("a", "b"), ["a", "b"], "left_anti")
        best = stars.groupBy("a").agg(F.max_by(F.struct("b", "asked"), F.struct("c", "b")).alias("m")).select("a", "m.b", "m.asked")
        if not add(overlapping(best)):
            break
        active = active.drop("comp", "_first").join(labels.withColumnRenamed("comp", "_comp"), "node", "left").withColumn("comp", F.coalesce("_comp", "node"))
        active = lists(active.drop("_comp"))
    # tokens of a set in the common order: a pair needs its first common token only, and that
    # is none whose predecessor is the same in both sets
    inside = Window.partitionBy("node").orderBy("p")
    active = active.withColumns({"before": F.lag("token").over(inside), "s": F.count(F.lit(1)).over(Window.partitionBy("node"))})
    x = side(active, "a").select("token", "a", "a_c", "a_n", "a_l", "a_s", F.col("p").alias("a_p"), F.col("before").alias("a_b"))
    y = side(active, "b").select("token", "b", "b_c", "b_n", "b_l", "b_s", F.col("p").alias("b_p"), F.col("before").alias("b_b"))
    new = ~F.coalesce(F.col("a_b") == F.col("b_b"), F.lit(False))
    meet = x.join(y, (x["token"] == y["token"]) & (F.col("a_c") < F.col("b_c")) & new & possible & early(percent))
    rest = overlapping(meet.select("a", "b", asked(percent).alias("asked")).distinct())
    if tried is not None:
        rest = rest.join(tried.select("a", "b"), ["a", "b"], "left_anti").join(tried.select(F.col("a").alias("b"), F.col("b").alias("a")), ["a", "b"], "left_anti")
    add(rest)
    comps = nodes.join(labels, "node", "left") if labels is not None else nodes.withColumn("comp", F.col("node"))
    comps = comps.withColumn("comp", F.coalesce("comp", "node"))
    firsts = comps.groupBy("comp").agg(F.min("first_id").alias("component_id"))
    groups = work.stored(comps.join(firsts, "comp").select("node", "comp", "component_id", "rows"), "groups")
    out = attach_groups(sets, groups, "node", "rows", ["text_key", "doc_id"])
    alone = F.col("n") == 0
    out = out.select(
        "doc_id", F.col("n").alias("n_shingles"), F.when(alone, F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"),
        "text_key", F.when(~alone, F.col("comp")).alias("group"),
    )
    out = stored(out, "similar-groups")
    work.clear()
    return out


def one_per_group(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 5, percent: int = 80) -> DataFrame:
    """``docs`` with one row of each group of similar texts: the smallest id (null last, ties by
    a hash of the text, equal rows once). Texts without words are in no group and all stay."""
    grouped = similar_groups(docs, id_col, text_col, k, percent).where("group IS NOT NULL")
    order = F.struct(F.col("doc_id").isNull(), "doc_id", "text_key")
    id_name, key = fresh(docs, "owner_id", "owner_key")
    owners = grouped.groupBy("group").agg(F.min_by(F.struct("doc_id", "text_key"), order).alias("o")).select(F.col("o.doc_id").alias(id_name), F.col("o.text_key").alias(key))
    id_text = F.coalesce(F.col(id_name).cast("string"), F.lit(""))
    worded = filled(text_col).rlike(r"[^\x20\x09-\x0D]")
    rows = docs.where(worded).withColumn(id_name, F.coalesce(F.col(id_col).cast("long").cast("string"), F.lit(""))).withColumn(key, F.xxhash64(filled(text_col)))
    kept = rows.join(owners.withColumn(id_name, id_text), [id_name, key], "left_semi").dropDuplicates([id_name, key])
    columns = [F.col(f"`{c}`") for c in docs.columns]
    return kept.select(*columns).unionByName(docs.where(~worded).select(*columns))


LINKED_SQL = r"""WITH RECURSIVE w AS MATERIALIZED (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
    'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
    sets AS MATERIALIZED (SELECT doc_id, list_distinct(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [array_to_string(w, ' ')]
        ELSE list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' ')) END) AS s FROM w),
    tokens AS (SELECT doc_id, unnest(s) AS g FROM sets),
    shared AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS same FROM tokens a JOIN tokens b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
    links AS MATERIALIZED (SELECT a, b FROM shared JOIN sets x ON x.doc_id = a JOIN sets y ON y.doc_id = b WHERE 100 * same >= 85 * (len(x.s) + len(y.s) - same)),
    reach AS (SELECT doc_id AS a, doc_id AS b FROM sets UNION SELECT reach.a, l.b FROM reach
        JOIN (SELECT a, b FROM links UNION ALL SELECT b, a FROM links) l ON reach.b = l.a)
    SELECT s.doc_id, len(s.s) AS n_shingles, min(r.b) AS component_id FROM sets s JOIN reach r ON r.a = s.doc_id GROUP BY ALL"""


@query("op4_jaccard_join", LINKED_SQL)
def op4_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similar_groups(table(spark, sf_dir, "documents"), k=4, percent=85).select("doc_id", "n_shingles", "component_id")
