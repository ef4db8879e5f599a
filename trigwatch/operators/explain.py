"""Why a window was flagged: attributions, forest paths, rules that fire together."""

from __future__ import annotations

import uuid
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trigwatch.functions.ordering import running_totals
from trigwatch.operators.models import kept, score
from trigwatch.operators.trees import ExtraTrees, node_rows
from trigwatch.session import checked_broadcast, cut_lineage, ensure_checkpoint_dir


def numbered_background(background: DataFrame) -> tuple[DataFrame, int]:
    """Background rows with their number ``bg`` from 0 on, and how many there are. They are a
    bounded sample, so the numbering is one small table."""
    placed = cut_lineage(background.withColumn("_at", F.monotonically_increasing_id()))
    numbered = running_totals(placed, [F.col("_at")], {"_n": F.lit(1)})
    return numbered.withColumn("bg", (F.col("_n") - 1).cast("int")).drop("_at", "_n"), placed.count()


def background_pairs(rows: DataFrame, background: DataFrame) -> DataFrame:
    """Every row with every background row, by an equi join on the background's number: the sample
    travels to the rows, which stay where they are."""
    numbered, size = numbered_background(background)
    return rows.withColumn("bg", F.explode(F.sequence(F.lit(0), F.lit(max(size, 1) - 1)))).join(checked_broadcast(numbered), "bg")


def sampled_shapley(
    model, rows: DataFrame, background: DataFrame, key: str, dimension: int, permutations: int = 4, seed: int = 42
) -> DataFrame:
    """Sampled-permutation attributions of each row against every background row, for any model.

    ``rows``: key, features; ``background``: features, a bounded sample. For a pair (row,
    background) and a feature order, the features that differ are switched one after the
    other; the change of the score belongs to the feature switched. Means over pairs and
    orders sum exactly to score(row) - mean score(background).

    The work is rows x background x orders x differing features, all spread by Spark. Forests
    have ``shapley_values``, which is exact and far cheaper.
    """
    size = background.count()
    rng = np.random.default_rng(seed)
    orders = F.array(*[F.array(*[F.lit(int(i)) for i in rng.permutation(dimension)]) for _ in range(permutations)])
    pairs = background_pairs(
        rows.select(key, vector_to_array("features").alias("x")), background.select(vector_to_array("features").alias("b"))
    )
    chains = pairs.select(key, "x", "b", F.explode(orders).alias("order")).withColumn(
        "chain", F.filter("order", lambda i: F.get("x", i) != F.get("b", i))
    )
    # the step at which each feature is switched, found once per chain (0: never)
    positions = F.sequence(F.lit(0), F.lit(dimension - 1))
    chains = chains.withColumn("turn", F.transform(positions, lambda i: F.array_position("chain", i)))
    steps = chains.select(key, "x", "b", "chain", "turn", F.explode(F.sequence(F.lit(0), F.size("chain"))).alias("step"))
    mixed = F.transform(
        positions,
        lambda i: F.when((F.get("turn", i) >= 1) & (F.get("turn", i) <= F.col("step")), F.get("x", i)).otherwise(F.get("b", i)),
    )
    scored = score(model, steps.withColumn("features", array_to_vector(mixed)))
    # each score counts for the feature just switched and against the one switched next
    shares = F.array(
        F.struct(F.get("chain", F.col("step") - 1).alias("feature_idx"), F.col("probability").alias("part")),
        F.struct(F.get("chain", F.col("step")).alias("feature_idx"), (-F.col("probability")).alias("part")),
    )
    return (
        scored.select(key, F.explode(F.when(F.col("step") > 0, shares).otherwise(F.slice(shares, 2, 1))).alias("s"))
        .select(key, "s.*")
        .where("feature_idx IS NOT NULL")
        .groupBy(key, "feature_idx")
        .agg((F.sum("part") / F.lit(size * permutations)).alias("attribution"))
    )


class Leaf:
    """A leaf as the box of values that leads to it: its distinct features, and of each the
    interval ``(low, high]``; ``value`` is what the leaf adds to the forest's score."""

    def __init__(self, bounds: dict[int, tuple[float, float]], value: float) -> None:
        self.features = np.array(sorted(bounds), np.int64)
        self.low = np.array([bounds[f][0] for f in sorted(bounds)])
        self.high = np.array([bounds[f][1] for f in sorted(bounds)])
        self.value = value

    def fits(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The distinct patterns of conditions that rows meet, and the pattern of each row."""
        seen = x[:, self.features]
        met = (seen > self.low) & (seen <= self.high)
        # a pattern is known by its bits: a path has no more features than the tree is deep
        codes = met @ (1 << np.arange(met.shape[1], dtype=np.int64))
        _, first, which = np.unique(codes, return_index=True, return_inverse=True)
        return met[first], which


def forest_leaves(nodes: DataFrame) -> list[Leaf]:
    """Leaves of a node table (``tree, node, feature, threshold, left, right, value``), each with
    its value divided by the number of trees. The table has the model's size."""
    by_tree: dict[int, dict[int, tuple]] = {}
    for r in nodes.select("tree", "node", "feature", "threshold", "left", "right", "value").collect():
        by_tree.setdefault(r.tree, {})[r.node] = r[2:]
    out = []
    for tree in by_tree.values():
        stack = [(0, {})]
        while stack:
            at, bounds = stack.pop()
            feature, threshold, left, right, value = tree[at]
            if left < 0:
                out.append(Leaf(bounds, value / len(by_tree)))
                continue
            low, high = bounds.get(feature, (-np.inf, np.inf))
            if low < min(high, threshold):
                stack.append((left, bounds | {feature: (low, min(high, threshold))}))
            if max(low, threshold) < high:
                stack.append((right, bounds | {feature: (max(low, threshold), high)}))
    return out


def leaf_attributions(x: np.ndarray, background: np.ndarray, leaves: Sequence[Leaf]) -> np.ndarray:
    """Exact attributions (rows x features) of a forest's score against the background rows.

    With some features taken from the row and the others from a background row, a leaf is
    reached if each of its conditions is met by the row or by the background row: conditions that only the
    row meets need its features (u of them), those that only the background row meets need
    that one's (v). Over all orders such a feature of the row brings the leaf's value with a
    share of (u-1)! v! / (u+v)!, one of the background row takes it with u! (v-1)! / (u+v)!.
    Rows that meet the same conditions are computed once.
    """
    out = np.zeros(x.shape)
    for leaf in leaves:
        size = len(leaf.features)
        if not size:
            continue
        mine, which = leaf.fits(x)
        theirs, of = leaf.fits(background)
        times = np.bincount(of, minlength=len(theirs)) / len(background)
        only_x, only_b = mine[:, None] & ~theirs[None], ~mine[:, None] & theirs[None]
        reached = (mine[:, None] | theirs[None]).all(2)
        u, v = only_x.sum(2), only_b.sum(2)
        factorial = np.cumprod([1.0, *range(1, size + 1)])
        for_x = np.where(u > 0, factorial[np.maximum(u - 1, 0)] * factorial[v], 0.0) / factorial[u + v]
        for_b = np.where(v > 0, factorial[u] * factorial[np.maximum(v - 1, 0)], 0.0) / factorial[u + v]
        weight = leaf.value * reached * times
        share = (only_x * (weight * for_x)[:, :, None]).sum(1) - (only_b * (weight * for_b)[:, :, None]).sum(1)
        out[:, leaf.features] += share[which]
    return out


def shapley_values(spark: SparkSession, nodes: DataFrame, rows: DataFrame, background: DataFrame, key: str) -> DataFrame:
    """Exact attributions of a forest's score, ``key, feature_idx, attribution`` (zeros left out).

    ``rows``: key, features; ``background``: features, a bounded sample; ``nodes``: ``node_table``
    of the forest. The attributions of a row sum to its score minus the mean score of the
    background. Leaves and background are broadcast (the model's size, and a sample's); rows
    stay where they are and go through in Arrow batches, so the work is rows times leaves,
    without orders and without rows of pairs.
    """
    sample = np.array([r[0] for r in background.select(vector_to_array("features")).collect()], float)
    sent = spark.sparkContext.broadcast((sample, forest_leaves(nodes)))
    kind = rows.schema[key].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        there, leaves = sent.value
        for batch in batches:
            if len(batch):
                found = leaf_attributions(np.array(batch["x"].tolist(), float), there, leaves)
                i, j = np.nonzero(found)
                yield pd.DataFrame({"key": batch["key"].to_numpy()[i], "feature_idx": j.astype(np.int32), "attribution": found[i, j]})

    flat = rows.select(F.col(key).alias("key"), vector_to_array("features").alias("x"))
    return flat.mapInPandas(run, f"key {kind}, feature_idx INT, attribution DOUBLE").withColumnRenamed("key", key)


def node_table(spark: SparkSession, model) -> DataFrame:
    """Node rows ``tree, node, feature, threshold, left, right, value`` of a fitted forest or tree, read
    from its saved form; ``value`` is the node's weighted share of class 1."""
    if isinstance(model, ExtraTrees):
        return node_rows(spark, model.trees)
    path = f"{ensure_checkpoint_dir(spark)}/forest-{uuid.uuid4().hex}"
    model.write().save(path)
    data = spark.read.parquet(f"{path}/data")
    node = "nodeData" if "nodeData" in data.columns else None
    tree = F.col("treeID") if "treeID" in data.columns else F.lit(0)
    prefix = f"{node}." if node else ""
    weights = F.col(f"{prefix}impurityStats")
    return data.select(
        tree.alias("tree"),
        F.col(f"{prefix}id").alias("node"),
        F.col(f"{prefix}split.featureIndex").alias("feature"),
        F.get(F.col(f"{prefix}split.leftCategoriesOrThreshold"), F.lit(0)).alias("threshold"),
        F.col(f"{prefix}leftChild").alias("left"),
        F.col(f"{prefix}rightChild").alias("right"),
        (F.get(weights, F.lit(1)) / F.aggregate(weights, F.lit(0.0), lambda s, w: s + w)).alias("value"),
    )


def tree_paths(nodes: DataFrame, max_trees: int | None = None, max_depth: int | None = None) -> DataFrame:
    """Sorted distinct features on every root-to-leaf path (or path cut at ``max_depth``).

    Walks the trees level by level with one join per level; the table is the model's size.
    """
    if max_trees is not None:
        nodes = nodes.where(F.col("tree") < max_trees)
    nodes = cut_lineage(nodes)
    front = nodes.where("node = 0").select("tree", "feature", "left", "right", F.array().cast("array<int>").alias("seen"))
    paths, depth = None, 0
    while True:
        leaf = (F.col("left") < 0) & (F.col("right") < 0)
        ended = leaf if max_depth is None or depth < max_depth else F.lit(True)
        done = front.where(ended).select("tree", "seen")
        paths = done if paths is None else paths.unionByName(done)
        grown = front.where(~ended).select(
            "tree",
            F.array_union("seen", F.array(F.col("feature").cast("int"))).alias("seen"),
            F.explode(F.array("left", "right")).alias("node"),
        )
        front = cut_lineage(grown.join(nodes, ["tree", "node"]).select("tree", "feature", "left", "right", "seen"))
        depth += 1
        if front.isEmpty():
            break
    return paths.select("tree", F.sort_array("seen").alias("features")).where(F.size("features") > 0)


def path_itemsets(
    paths: DataFrame, sizes: Sequence[int] = (2, 3), min_support: float = 0.01, top_k: int | None = None
) -> DataFrame:
    """Feature combinations on paths: count and share of paths. A path has at most its depth's features."""
    total = paths.agg(F.count(F.lit(1))).scalar()
    found = None
    for size in sizes:
        combos = paths.select("features", F.transform("features", lambda f: F.array(f)).alias("sets"))
        for _ in range(size - 1):
            longer = F.flatten(
                F.transform("sets", lambda s: F.transform(F.filter("features", lambda f: f > F.element_at(s, -1)), lambda f: F.concat(s, F.array(f))))
            )
            combos = combos.select("features", longer.alias("sets"))
        one = combos.select(F.explode("sets").alias("itemset"))
        found = one if found is None else found.unionByName(one)
    counted = found.groupBy("itemset").agg(F.count(F.lit(1)).alias("n_paths"))
    kept = counted.withColumn("support", F.col("n_paths") / total).where(F.col("support") >= min_support)
    return kept if top_k is None else kept.orderBy(F.desc("n_paths"), "itemset").limit(top_k)


def cooccurring_rules(events: DataFrame, keys: Sequence[str], min_support: float) -> DataFrame:
    """Pairs of rules that fire in at least ``min_support`` of the windows together.

    A window has each rule of the catalogue once at most, so its pairs are bounded by the
    catalogue, and equal pairs are counted map-side before they are shuffled. Only rules that
    reach the support by themselves can be in such a pair.
    """
    fired = events.select(*keys, "rule_id").distinct()
    least = F.ceil(fired.select(*keys).distinct().agg(F.count(F.lit(1))).scalar() * min_support)
    frequent = fired.groupBy("rule_id").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least).select("rule_id")
    items = fired.join(frequent, "rule_id").groupBy(*keys).agg(F.sort_array(F.collect_list("rule_id")).alias("items"))
    pairs = F.flatten(F.transform("items", lambda x, i: F.transform(F.slice("items", i + 2, F.size("items")), lambda y: F.array(x, y))))
    counted = items.select(F.explode(pairs).alias("rules")).groupBy("rules").agg(F.count(F.lit(1)).alias("n_windows"))
    return counted.where(F.col("n_windows") >= least)


def project_windows(df: DataFrame, k: int = 3, extra: int = 8, power: int = 5, seed: int = 42) -> DataFrame:
    """Low-dimensional view of windows: the first ``k`` principal components as ``c1 .. ck``.

    A randomised range finder (Halko et al. 2011): centred rows times a random matrix of
    ``k + extra`` columns, ``power`` more passes of the same kind, and one for the small problem
    that remains. A pass sends one d x (k + extra) sum per task, added up by the executors, and
    sparse rows are multiplied as they are; no d x d matrix is formed anywhere. The sign of a
    component is that which makes its largest loading positive.
    """
    mean, loadings, _ = principal_directions(df, k, extra, power, seed)

    @F.pandas_udf("array<double>")
    def projected(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield pd.Series(list((np.stack(batch.to_numpy()) - mean) @ loadings) if len(batch) else [], dtype=object)

    flat = df.withColumn("_projected", projected(vector_to_array("features")))
    return flat.withColumns({f"c{i + 1}": F.get("_projected", F.lit(i)) for i in range(loadings.shape[1])}).drop("_projected")


def principal_directions(df: DataFrame, k: int, extra: int = 8, power: int = 5, seed: int = 42) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Mean, the first ``k`` directions (columns) and their variances; none for an empty frame's rows."""
    with kept(df.select("features")) as rows:
        moments = rows.select(Summarizer.metrics("mean", "count").summary(F.col("features")).alias("m")).select("m.mean", "m.count").first()
        mean, n = moments[0].toArray(), moments[1]
        d = len(mean)
        width = min(d, k + extra)
        basis = np.linalg.qr(np.random.default_rng(seed).normal(size=(d, width)))[0]
        for turn in range(power + 1):
            product_ = _covariance_times(rows, mean, basis)
            if turn < power:
                basis = np.linalg.qr(product_)[0]
        # the covariance seen inside the basis
        values, turned = np.linalg.eigh(basis.T @ product_)
        order = np.argsort(-values)[:k]
        loadings = basis @ turned[:, order]
        signs = np.sign(loadings[np.abs(loadings).argmax(0), np.arange(loadings.shape[1])])
        return mean, loadings * np.where(signs == 0, 1, signs), values[order] / max(1, n - 1)


def _covariance_times(rows: DataFrame, mean: np.ndarray, basis: np.ndarray) -> np.ndarray:
    """Centred scatter matrix times ``basis``, without the matrix: the sum of ``x (x' basis)`` over
    the rows, and the mean's part taken off."""
    shift = mean @ basis

    def sums(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros(basis.shape)
        flat = np.zeros(basis.shape[1])
        for batch in batches:
            for at, value in zip(batch["i"], batch["v"]):
                at = np.asarray(at, np.int64)
                y = np.asarray(value) @ basis[at] - shift
                total[at] += np.asarray(value)[:, None] * y
                flat += y
        i, j = np.nonzero(total)
        yield pd.DataFrame({"i": i, "j": j, "v": total[i, j]})
        yield pd.DataFrame({"i": np.full(len(flat), -1), "j": np.arange(len(flat)), "v": flat})

    dense = vector_to_array("features")
    places = F.filter(F.sequence(F.lit(0), F.size(dense) - 1), lambda p: F.get(dense, p) != 0)
    sparse = rows.select(places.alias("i"), F.filter(dense, lambda x: x != 0).alias("v"))
    found = sparse.mapInPandas(sums, "i BIGINT, j BIGINT, v DOUBLE").groupBy("i", "j").agg(F.sum("v").alias("v")).toPandas()
    out, flat = np.zeros(basis.shape), np.zeros(basis.shape[1])
    inner = found["i"] >= 0
    out[found["i"][inner], found["j"][inner]] = found["v"][inner]
    flat[found["j"][~inner]] = found["v"][~inner]
    return out - np.outer(mean, flat)
