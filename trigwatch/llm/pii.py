"""Personal data by weak supervision, in DataFrame functions only."""

from __future__ import annotations

import math
from functools import reduce
from itertools import chain

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from trigwatch.llm.common import filled, stored, table
from trigwatch.llm.registry import query

#: fixed values of the contract: the kinds in order; ``other`` are spans that the method adds
KINDS = ("email", "ip", "card", "phone", "other")

#: The contract's patterns in a form that Java matches in linear time and without recursion:
#: possessive repeats, and a match begins where a run begins (or where the last match ended).
#: A run that fails there fails at each later place too, so the matches are the same.
LOCAL = r"[A-Za-z0-9._%+-]"
PATTERNS = {
    "email": rf"(?:\G|(?<!{LOCAL})){LOCAL}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"(?<![0-9])(?<![0-9][\x20-])[0-9](?:[\x20-]?[0-9]){13,18}+(?![\x20-]?[0-9])",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    "other": r"(?<![0-9A-Za-z+.-])(?:\(?[0-9]{2,4}\)?[\x20.-][0-9]{3,4}[\x20.-][0-9]{3,4}|[0-9]{3}-[0-9]{2}-[0-9]{4})(?![0-9A-Za-z-])|(?<![A-Za-z0-9_@.%+-])@[A-Za-z][A-Za-z0-9_]{2,30}(?![A-Za-z0-9_.@-])",
}
#: what a text must have before its pattern is tried
HINTS = {
    "email": lambda t: t.contains("@"),
    "ip": lambda t: t.rlike(r"[0-9]\.[0-9]"),
    "card": lambda t: t.rlike(r"[0-9](?:[\x20-]?[0-9]){13}"),
    "phone": lambda t: t.contains("+"),
    "other": lambda t: t.rlike(r"[0-9][\x20.-][0-9]|[0-9]\)|@[A-Za-z]"),
}

#: gazetteers: mail suffixes, calling codes, card issuers
SUFFIXES = "com org net edu gov info io co de fr es it uk eu ch at nl be us ca".split()
CALLING = "1 7 20 27 30 31 32 33 34 36 39 40 41 43 44 45 46 47 48 49 51 52 54 55 56 57 58 60 61 62 63 64 65 66 81 82 84 86 90 91 92 94 98 351 352 353 358 380 420".split()
ISSUERS = "4 51 52 53 54 55 34 37 36 6011 65 35 62".split()
#: context words before a span, for and against
CUES = "mail|contact|phone|tel|call|mobile|fax|card|visa|credit|pay|ip|addr|host|server|ssn|social|passport|id:|kontakt|telefon|karte|carte|courriel|correo|tarjeta"
COUNTER_CUES = "version|order|invoice|isbn|total|page|chapter|section|part|figure|release"
CONTEXT = 24


def _digits(match: Column) -> Column:
    return F.regexp_replace(match, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """Whether the check digit of a string of digits is right."""
    def step(d, i):
        twice = d.try_cast("int") * F.when(i % 2 == 1, 2).otherwise(1)
        return F.when(twice > 9, twice - 9).otherwise(twice)

    parts = F.transform(F.split(F.reverse(digits), "(?!^)"), step)
    return F.aggregate(parts, F.lit(0), lambda a, x: a + F.coalesce(x, F.lit(0))) % 10 == 0


def valid(kind: Column, match: Column) -> Column:
    """The contract's condition on a match of each kind; false for ``other``."""
    digits = _digits(match)
    parts = F.transform(F.split(match, r"\."), lambda p: F.ltrim(p, F.lit("0")))
    small = F.forall(parts, lambda p: (F.length(p) < 3) | ((F.length(p) == 3) & (p <= "255")))
    return (
        F.when(kind == "email", F.lit(True)).when(kind == "ip", small)
        .when(kind == "card", F.length(digits).between(14, 19) & luhn(digits))
        .when(kind == "phone", F.length(digits).between(10, 15)).otherwise(F.lit(False))
    )


def _begins(text: Column, words: list[str]) -> Column:
    return text.rlike("^(?:" + "|".join(words) + ")")


def votes(kind: Column, match: Column, tail: Column, ok: Column) -> dict[str, Column]:
    """What each labeler says of a candidate: 1 personal data, -1 not, 0 nothing."""
    digits, before = _digits(match), F.right(tail, F.lit(1))
    strict = match.rlike(r"^\(?[0-9]{3}\)?[\x20.-][0-9]{3}[\x20.-][0-9]{4}$|^[0-9]{3}-[0-9]{2}-[0-9]{4}$")
    def yes(c):
        return F.when(c, 1).otherwise(-1)

    return {
        "regex": F.when(kind != "other", yes(ok)).when(match.startswith("@"), 0).otherwise(yes(strict)),
        "gazetteer": F.when(kind == "email", yes(match.rlike(r"(?i)\.(?:" + "|".join(SUFFIXES) + ")$")))
        .when(kind == "phone", yes(_begins(digits, CALLING))).when(kind == "card", yes(_begins(digits, ISSUERS)))
        .when(kind == "ip", yes(~match.rlike(r"^0|^255\."))).otherwise(0),
        "context": F.when(F.lower(tail).rlike(rf"(?:{CUES})[^\n]*$"), 1).when(F.lower(tail).rlike(rf"(?:{COUNTER_CUES})[^\n]*$"), -1).otherwise(0),
        "border": F.when(before.rlike(r"^[A-Za-z0-9]$"), -1).when(before.rlike(r"^[:=(<\[\"']$"), 1).otherwise(0),
    }


LABELERS = ("regex", "gazetteer", "context", "border")


def reliabilities(counts: dict[tuple[int, ...], float], rounds: int = 60) -> tuple[float, list[dict]]:
    """Expectation-maximisation over vote patterns and their counts.

    Returns the share of personal data and, per labeler, the probability of each vote given
    the class. The first guess is the share of votes for; patterns are at most 3 to the power
    of the labelers, whatever the corpus.
    """
    believed = {p: (1 + sum(v == 1 for v in p)) / (2 + sum(v != 0 for v in p)) for p in counts}
    share, tables = 0.5, []
    for _ in range(rounds):
        total = sum(counts.values())
        share = (1 + sum(n * believed[p] for p, n in counts.items())) / (2 + total)
        tables = []
        for l in range(len(LABELERS)):
            given = {(v, y): 1.0 for v in (-1, 0, 1) for y in (0, 1)}
            for p, n in counts.items():
                given[p[l], 1] += n * believed[p]
                given[p[l], 0] += n * (1 - believed[p])
            tables.append({(v, y): given[v, y] / sum(given[u, y] for u in (-1, 0, 1)) for v, y in given})
        for p in believed:
            a = math.log(share) + sum(math.log(t[v, 1]) for t, v in zip(tables, p))
            b = math.log(1 - share) + sum(math.log(t[v, 0]) for t, v in zip(tables, p))
            believed[p] = 1 / (1 + math.exp(max(-50.0, min(50.0, b - a))))
    return share, tables


def posterior(share: float, tables: list[dict], pattern: tuple[int, ...]) -> float:
    a = math.log(share) + sum(math.log(t[v, 1]) for t, v in zip(tables, pattern))
    b = math.log(1 - share) + sum(math.log(t[v, 0]) for t, v in zip(tables, pattern))
    return 1 / (1 + math.exp(max(-50.0, min(50.0, b - a))))


#: what the span classifier sees beside the votes and the kind, each as one of ``BUCKETS`` by hash:
#: the last word before the span, the first word after it, and the span's shape
SEEN = ("before", "after", "shape")
BUCKETS = 32
#: bound of its training sample: so many candidates of each kind, in the order of a hash
TRAIN_PER_KIND = 4000


def span_features(match: Column, tail: Column, head: Column) -> dict[str, Column]:
    """Bucket of each of ``SEEN``: words in lower case; a shape has its runs of digits and letters
    as one sign each, and the number of digits."""

    def bucket(text: Column) -> Column:
        return F.pmod(F.xxhash64(text), F.lit(BUCKETS)).cast("int")

    shape = F.regexp_replace(F.regexp_replace(match, "[A-Za-z]+", "a"), "[0-9]+", "0")
    return {
        "before": bucket(F.regexp_extract(F.lower(tail), r"(\p{L}+)[^\p{L}]*$", 1)),
        "after": bucket(F.regexp_extract(F.lower(head), r"^[^\p{L}]*(\p{L}+)", 1)),
        "shape": bucket(F.concat_ws("|", shape, F.length(_digits(match)))),
    }


def active(pattern: tuple[int, ...], kind: str, seen: tuple[int, ...]) -> list[int]:
    """Numbers of the features that a candidate has; the last one is the constant."""
    said = [2 * i + (v < 0) for i, v in enumerate(pattern) if v]
    kinds = 2 * len(LABELERS)
    buckets = [kinds + len(KINDS) + BUCKETS * i + b for i, b in enumerate(seen)]
    return [*said, kinds + KINDS.index(kind), *buckets, N_FEATURES - 1]


N_FEATURES = 2 * len(LABELERS) + len(KINDS) + BUCKETS * len(SEEN) + 1


def train_classifier(rows: list[tuple[list[int], float]], rounds: int = 400, rate: float = 0.05, ridge: float = 1e-3) -> list[float]:
    """Logistic weights for rows of (feature numbers, belief between 0 and 1)."""
    x = np.zeros((len(rows), N_FEATURES))
    for i, (numbers, _) in enumerate(rows):
        x[i, numbers] = 1.0
    y = np.array([belief for _, belief in rows])
    weights, first, second = np.zeros(N_FEATURES), np.zeros(N_FEATURES), np.zeros(N_FEATURES)
    for step in range(1, rounds + 1):
        error = 1 / (1 + np.exp(-np.clip(x @ weights, -30, 30))) - y
        slope = x.T @ error / len(rows) + ridge * weights
        first, second = 0.9 * first + 0.1 * slope, 0.999 * second + 0.001 * slope**2
        weights -= rate * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.999**step)) + 1e-8)
    return weights.tolist()


def _score(weights: list[float]) -> Column:
    """Probability of the span classifier, as a column expression."""
    z, at = F.lit(float(weights[-1])), 2 * len(LABELERS)
    for i, l in enumerate(LABELERS):
        z = z + F.when(F.col(f"v_{l}") == 1, weights[2 * i]).when(F.col(f"v_{l}") == -1, weights[2 * i + 1]).otherwise(0.0)
    for i, k in enumerate(KINDS):
        z = z + F.when(F.col("kind") == k, weights[at + i]).otherwise(0.0)
    for i, name in enumerate(SEEN):
        own = weights[at + len(KINDS) + BUCKETS * i : at + len(KINDS) + BUCKETS * (i + 1)]
        z = z + F.get(F.array(*[F.lit(float(w)) for w in own]), F.col(f"c_{name}"))
    return 1 / (1 + F.exp(-z))


def candidates(docs: DataFrame, id_col: str, text_col: str) -> tuple[DataFrame, DataFrame]:
    """Rows ``row, doc_id`` of all documents, and ``row, kind, start, end, match, tail, head`` of all matches.

    One pass reads the texts; of each kind it stores the matches, and the length, the first and the
    last characters of each piece between them. Places are then running sums over the pieces of a
    document.
    """
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).cast("long").alias("doc_id"), filled(text_col).alias("t"))
    columns = []
    for kind, pattern in PATTERNS.items():
        pieces = F.transform(F.split("t", pattern, -1), lambda p: F.struct(F.char_length(p).alias("size"), F.right(p, F.lit(CONTEXT)).alias("tail"), F.left(p, F.lit(CONTEXT)).alias("head")))
        found = F.transform(
            F.arrays_zip(F.regexp_extract_all("t", F.lit(pattern), F.lit(0)).alias("match"), pieces.alias("piece"), F.slice(pieces, F.lit(2), F.size(pieces)).alias("next")),
            lambda z: F.struct(z["match"].alias("match"), z["piece"]["size"].alias("size"), z["piece"]["tail"].alias("tail"), z["next"]["head"].alias("head")),
        )
        columns.append(F.when(HINTS[kind](F.col("t")), found).alias(kind))
    scanned = stored(rows.select("row", "doc_id", *columns), "pii")
    stacked = scanned.select("row", F.explode(F.create_map(*chain.from_iterable((F.lit(k), F.col(k)) for k in KINDS))).alias("kind", "found"))
    each = stacked.select("row", "kind", F.posexplode("found").alias("at", "x")).select("row", "kind", "at", "x.*").where("match IS NOT NULL")
    upto = Window.partitionBy("row", "kind").orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
    end = F.sum(F.col("size") + F.char_length("match")).over(upto)
    placed = each.withColumn("end", end.cast("long")).withColumn("start", F.col("end") - F.char_length("match"))
    return scanned.select("row", "doc_id"), placed.select("row", "kind", "start", "end", "match", "tail", "head")


def find_personal_data(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: float = 0.5) -> DataFrame:
    """Spans of personal data in every whole text, one row per input row.

    Returns ``doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans``. A span is
    kind:start:end in code points, the end exclusive; spans stand by start, then kind, and are
    joined by commas (``base_sha256`` is over those of the contract's kinds). Kind ``other``
    is added by the method: a candidate (a failed match, a national number, a handle) that
    overlaps no base span, that the labelers do not speak against in the balance, and to which
    the span classifier gives at least ``least``. Null and empty texts have no spans; repeated rows are rows of their own;
    other columns are not read. Without any candidate nothing is trained.

    Labelers vote on every candidate; only the counts of vote patterns, of which there is a
    fixed number, reach the driver. There expectation-maximisation finds how reliable each
    labeler is. Its beliefs train the classifier on at most ``TRAIN_PER_KIND`` candidates of a kind, by
    hash, on which some labeler speaks; besides the votes it sees the words around the span and its
    shape, so it can decide where they abstain or tie. It is then a column expression.
    """
    rows, found = candidates(docs, id_col, text_col)
    kind, match = F.col("kind"), F.col("match")
    judged = found.withColumn("ok", valid(kind, match))
    judged = judged.withColumns({f"v_{name}": vote for name, vote in votes(kind, match, F.col("tail"), F.col("ok")).items()})
    judged = judged.withColumns({f"c_{name}": seen for name, seen in span_features(match, F.col("tail"), F.col("head")).items()})
    judged = stored(judged.drop("tail", "head", "match"), "candidates")
    said, seen = [f"v_{name}" for name in LABELERS], [f"c_{name}" for name in SEEN]
    counted = judged.groupBy(*said).agg(F.count(F.lit(1)).alias("n")).collect()
    share, tables = reliabilities({tuple(r[s] for s in said): float(r["n"]) for r in counted})
    # where all labelers abstain they teach nothing: there the words around decide
    spoke = reduce(lambda a, b: a | b, [F.col(s) != 0 for s in said])
    balance = reduce(lambda a, b: a + b, [F.col(s) for s in said])
    hashed = F.xxhash64("kind", "row", "start")
    place = F.row_number().over(Window.partitionBy("kind").orderBy(hashed, "row", "start"))
    sample = judged.where(spoke).select("kind", *said, *seen, place.alias("place")).where(F.col("place") <= TRAIN_PER_KIND).collect()
    beliefs = {tuple(r[s] for s in said): posterior(share, tables, tuple(r[s] for s in said)) for r in counted}
    lessons = [(active(tuple(r[s] for s in said), r["kind"], tuple(r[s] for s in seen)), beliefs[tuple(r[s] for s in said)]) for r in sample]
    added = ~F.col("ok") & (balance >= 0) & (_score(train_classifier(lessons)) >= least) if lessons else F.lit(False)
    rank = F.array_position(F.array(*[F.lit(k) for k in KINDS]), F.col("kind"))
    span = F.struct("start", F.when(F.col("ok"), rank).otherwise(F.lit(len(KINDS))).alias("rank"), "end")
    # an added span overlaps a base span that starts before it and reaches into it, or the next one to start
    up = Window.partitionBy("row").orderBy("start", F.desc("ok"), "end").rowsBetween(Window.unboundedPreceding, 0)
    down = Window.partitionBy("row").orderBy(F.desc("start"), F.desc("ok"), F.desc("end")).rowsBetween(Window.unboundedPreceding, 0)
    reached = judged.where(F.col("ok") | added).withColumns(
        {"before": F.max(F.when(F.col("ok"), F.col("end"))).over(up), "after": F.min(F.when(F.col("ok"), F.col("start"))).over(down)}
    )
    free = ~F.col("ok") & (F.coalesce("before", F.col("start")) <= F.col("start")) & (F.coalesce("after", F.col("end")) >= F.col("end"))
    spans = reached.groupBy("row").agg(
        F.array_sort(F.collect_list(F.when(F.col("ok"), span))).alias("base"), F.array_sort(F.collect_set(F.when(free, span))).alias("more"),
        *[F.count(F.when(F.col("ok") & (F.col("kind") == k), 1)).alias(f"n_{k}") for k in KINDS[:4]],
    )
    names = F.array(*[F.lit(k) for k in KINDS])

    def text(list_: Column) -> Column:
        parts = F.transform(list_, lambda s: F.concat_ws(":", F.element_at(names, s["rank"].cast("int")), s["start"], s["end"]))
        return F.coalesce(F.array_join(parts, ","), F.lit(""))

    out = rows.join(spans.withColumn("all", F.array_sort(F.concat("base", "more"))), "row", "left")
    return out.select(
        "doc_id", *[F.coalesce(f"n_{k}", F.lit(0).cast("long")).alias(f"n_{k}") for k in KINDS[:4]],
        F.sha2(text(F.col("base")), 256).alias("base_sha256"), text(F.col("all")).alias("spans"),
    )


@query("op5_pii")
def op5_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_personal_data(table(spark, sf_dir, "documents"))
