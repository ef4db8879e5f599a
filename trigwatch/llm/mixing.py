"""Mixing sources to target weights."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from trigwatch.functions.ordering import ranked_within, running_totals
from trigwatch.llm.common import attach_groups, filled, fresh, stored, table
from trigwatch.llm.registry import query

WORD, SPACE = r"[^\x20\x09-\x0D]+", r"[\x20\x09-\x0D]"


def word_count(text: str = "text") -> Column:
    return F.regexp_count(filled(text), F.lit(WORD)).cast("long")


def source_targets(sizes: DataFrame, weights: Sequence[int], share: tuple[int, int], cap: int) -> DataFrame:
    """Words to take from each source.

    ``sizes`` has one row per source: ``source``, ``source_size``. Sources in order (code
    points, null last) get the weights in turn and divide ``share`` (a fraction as two
    integers) of all words by weight. A source stops at ``cap`` times its size and its excess
    goes to the others by weight until none is above. That end state is found directly: with
    sources ordered by ``cap * size / weight``, those up to some point stop, and the rest get
    their weight's part of what is left. Prefix sums over that order give the point, so there
    are no rounds, however many sources there are.
    """
    order = [F.col("source").isNull().cast("int"), F.col("source")]
    placed = running_totals(sizes, order, {"_place": F.lit(1).cast("long")})
    turn = F.array(*[F.lit(int(w)).cast("long") for w in weights])
    weighed = placed.withColumn("_weight", F.element_at(turn, ((F.col("_place") - 1) % len(weights) + 1).cast("int")))
    ratio = (F.col("source_size") * cap).cast("double") / F.col("_weight")
    summed = stored(
        running_totals(
            weighed.withColumns({"_cap": F.col("source_size") * cap, "_ratio": ratio}),
            [F.col("_ratio"), F.col("_place")],
            {"_caps": F.col("_cap"), "_weights": F.col("_weight")},
            grand={"_all_caps": "_caps", "_all_weights": "_weights"},
        ),
        "targets",
    )
    # the row stops if its own cap is within its part of what sources before it leave
    budget = F.col("_all_caps") / F.lit(cap) * share[0] / share[1]
    left, rest = budget - (F.col("_caps") - F.col("_cap")), F.col("_all_weights") - (F.col("_weights") - F.col("_weight"))
    summed = summed.withColumn("_stops", F.col("_ratio") <= left / rest)
    stopped, open_ = summed.agg(
        F.coalesce(F.sum(F.when(F.col("_stops"), F.col("_cap"))), F.lit(0)),
        F.coalesce(F.sum(F.when(~F.col("_stops"), F.col("_weight"))), F.lit(1)),
    ).first()
    target = F.when(F.col("_stops"), F.col("_cap").cast("double")).otherwise(
        F.col("_weight") * ((budget - F.lit(stopped)) / F.lit(open_))
    )
    return summed.select("source", "source_size", "_place", target.alias("target"))


def mix(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    weights: Sequence[int] = (5, 2, 1),
    share: tuple[int, int] = (3, 2),
    cap: int = 2,
    seed: str = "mix",
) -> DataFrame:
    """How many words of each document the mix takes.

    Returns ``doc_id, size, source_size, target, taken`` and ``source``, one row per input row.
    Size is the number of words; null and empty texts have none and nothing is taken of them.
    Documents of a source stand in the order of an md5 of seed and id (then id, null first,
    then size), so reruns agree. A source passes its documents as often as its target holds
    its size in full, and once more up to the exact word: the document at the cut gives the
    words up to it. Rows with equal id and size are interchangeable. Sources without a word
    have target 0. Weights are positive integers; ``share`` is at most ``cap``.

    Texts are read once; only (id, source, size) moves on. The order is range-sorted over all
    sources at once, so a source with a third of all rows lies over many slices, and slice
    offsets make the prefix sums global.
    """
    if not weights or min(weights) < 1 or share[0] > cap * share[1]:
        raise ValueError("weights must be positive and the share at most the cap")
    sized = stored(
        docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(source_col).cast("string").alias("source"), word_count(text_col).alias("size")),
        "sized",
    )
    sizes = stored(sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("_rows")), "sources")
    targets = source_targets(sizes.select("source", "source_size"), weights, share, cap)
    starts = running_totals(targets, [F.col("_place")], {"_end": F.col("source_size")}).withColumn("_start", F.col("_end") - F.col("source_size"))
    keyed = [F.coalesce(F.concat(F.lit("s"), F.col("source")), F.lit("")).alias("_source")]
    groups = stored(
        starts.alias("a").join(sizes.select(F.col("source").alias("_s"), "_rows"), F.col("a.source").eqNullSafe(F.col("_s"))).select(
            *keyed, "source_size", "target", "_start", "_place", "_rows"
        ),
        "groups",
    )
    rows = attach_groups(sized.select("*", *keyed), groups, "_source", "_rows", ["doc_id", "size"])
    key = F.md5(F.concat(F.lit(seed), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))))
    summed = running_totals(
        rows.withColumn("_key", key),
        [F.col("_place"), F.col("_key"), F.col("doc_id"), F.col("size")],
        {"_end": F.col("size")},
    )
    budget = F.round(F.col("target")).cast("long")
    size, total = F.col("size"), F.col("source_size")
    passes = F.when(total > 0, F.floor(budget / total).cast("long")).otherwise(F.lit(0).cast("long"))
    before = F.col("_end") - size - F.col("_start")
    last = F.greatest(F.lit(0).cast("long"), F.least(size, budget - passes * total - before))
    return summed.select("doc_id", "size", "source_size", "target", (passes * size + last).alias("taken"), "source")


def mixed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **settings) -> DataFrame:
    """``docs`` as the mix takes them: a row for each full pass, and one more with the text up to
    the cut if the last pass ends inside the document. Documents of which nothing is taken go.

    Columns are those of ``docs``; an ``n_chars`` column follows the text. Rows of equal source,
    id and size are interchangeable: what the mix takes of them is dealt row after row, whole texts
    first and one cut, so no word is lost or moved to another source. A cut text ends with its last
    word taken.
    """
    size, key, taken, n, place = fresh(docs, "size", "key", "taken", "n", "place")

    def name(source: Column, doc_id: Column, words: Column) -> Column:
        # a source may hold any character, so it stands last
        return F.concat(F.coalesce(doc_id.cast("string"), F.lit("")), F.lit("|"), words.cast("string"), F.coalesce(F.concat(F.lit("|"), source), F.lit("")))

    shares = stored(
        mix(docs, id_col, text_col, source_col, **settings)
        .groupBy(name(F.col("source"), F.col("doc_id"), F.col("size")).alias(key))
        .agg(F.sum("taken").alias(taken), F.count(F.lit(1)).alias(n)),
        "taken",
    )
    rows = docs.withColumn(size, word_count(text_col))
    rows = rows.withColumn(key, name(F.col(source_col).cast("string"), F.col(id_col).cast("long"), F.col(size)))
    rows = attach_groups(rows, shares, key, n, [id_col]).where(F.col(taken) > 0).withColumn(place, F.lit(0).cast("long"))
    if not shares.where(F.col(n) > 1).isEmpty():
        again = rows.where(F.col(n) > 1).withColumn(place, F.monotonically_increasing_id())
        first, more = fresh(again, "first", "more")
        again = ranked_within(again, key, [F.col(place)], first, more).withColumn(place, F.col(first) - 1).drop(first, more)
        rows = rows.where(F.col(n) == 1).unionByName(again.select(rows.columns))
    # of the whole texts taken, each row gets its even part, and the first rows one more; the next one gets the cut
    whole, rest = F.floor(F.col(taken) / F.col(size)), F.col(taken) % F.col(size)
    full = (F.floor(whole / F.col(n)) + (F.col(place) < whole % F.col(n)).cast("int")).cast("int")
    part = F.when(F.col(place) == whole % F.col(n), rest).otherwise(F.lit(0)).cast("int")
    copies = rows.withColumn(key, F.explode(F.concat(F.array_repeat(F.lit(0), full), F.when(part > 0, F.array(part)).otherwise(F.array().cast("array<int>")))))
    # possessive groups: Java matches them in a loop, not by recursion
    some = F.concat(F.lit(rf"^({SPACE}*+(?:{WORD}+{SPACE}*+){{"), (F.col(key) - 1).cast("string"), F.lit(rf"}}+{WORD}+)"))
    cut = F.when(F.col(key) == 0, F.col(text_col)).otherwise(F.call_function("regexp_extract", F.col(text_col), some, F.lit(1)))
    out = copies.withColumn(text_col, cut)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.col(key) == 0, F.col("n_chars")).otherwise(F.length(text_col).cast(docs.schema["n_chars"].dataType)))
    return out.select(*[F.col(f"`{c}`") for c in docs.columns])


@query(
    "op7_mix_sources",
    r"""WITH sized AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size FROM documents),
    sources AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size, row_number() OVER (ORDER BY source NULLS LAST) AS place FROM sized GROUP BY source),
    weighed AS (SELECT *, source_size * 2 AS cap, [5, 2, 1][(place - 1) % 3 + 1] AS weight FROM sources),
    placed AS (SELECT *, CAST(sum(cap) OVER upto AS BIGINT) - cap AS before, CAST(sum(weight) OVER upto AS BIGINT) - weight AS used,
        CAST(sum(cap) OVER () AS BIGINT) / 2 * 3 / 2 AS budget, CAST(sum(weight) OVER () AS BIGINT) AS weights
        FROM weighed WINDOW upto AS (ORDER BY CAST(cap AS DOUBLE) / weight, place ROWS UNBOUNDED PRECEDING)),
    stops AS (SELECT *, CAST(cap AS DOUBLE) / weight <= (budget - before) / (weights - used) AS stop FROM placed),
    targets AS (SELECT source, source_size, CASE WHEN stop THEN CAST(cap AS DOUBLE) ELSE weight * ((budget - coalesce(CAST(sum(cap) FILTER (stop) OVER () AS BIGINT), 0))
        / CAST(sum(weight) FILTER (NOT stop) OVER () AS BIGINT)) END AS target FROM stops),
    summed AS (SELECT doc_id, size, source_size, target, s.source, CAST(round(target) AS BIGINT) AS budget,
        CAST(sum(size) OVER (PARTITION BY s.source ORDER BY md5('mix' || coalesce(CAST(doc_id AS VARCHAR), '')), doc_id NULLS FIRST, size ROWS UNBOUNDED PRECEDING) AS BIGINT) AS upto
        FROM sized s JOIN targets t ON s.source IS NOT DISTINCT FROM t.source)
    SELECT doc_id, size, source_size, target, source, CASE WHEN source_size = 0 THEN 0 ELSE budget // source_size * size
        + greatest(0, least(size, budget % source_size - (upto - size))) END AS taken FROM summed""",
)
def op7_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents"))
