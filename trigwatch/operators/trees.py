"""Trees grown level by level: one aggregate over (tree, node, feature) decides a whole level.

Tasks send each row down the trees built so far and add it up at the node where it stands, so
rows are never moved or rewritten, and what is collected per level is bounded by the model
(nodes times candidate splits), not by the rows.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trigwatch.operators.vectors import class_weights

#: rows that a task sends down the trees together
ROWS = 4096


class Tree:
    """A binary tree as lists by node number: the root is 0, a leaf has feature -1, and ``value``
    is the weighted share of class 1. A row goes left if its feature is at most the threshold."""

    def __init__(self, feature=(-1,), threshold=(0.0,), left=(-1,), right=(-1,), value=(0.5,)) -> None:
        self.feature, self.threshold, self.left, self.right, self.value = list(feature), list(threshold), list(left), list(right), list(value)

    def split(self, node: int, feature: int, threshold: float, left: float, right: float) -> tuple[int, int]:
        """Give a leaf two children with their values; returns their numbers."""
        at = len(self.feature)
        self.feature[node], self.threshold[node], self.left[node], self.right[node] = int(feature), float(threshold), at, at + 1
        self.feature += [-1, -1]
        self.threshold += [0.0, 0.0]
        self.left += [-1, -1]
        self.right += [-1, -1]
        self.value += [float(left), float(right)]
        return at, at + 1

    def leaves(self, x: np.ndarray) -> np.ndarray:
        """The leaf of every row."""
        feature, threshold = np.array(self.feature), np.array(self.threshold)
        left, right = np.array(self.left), np.array(self.right)
        node = np.zeros(len(x), np.int64)
        rows = np.arange(len(x))
        while len(rows):
            rows = rows[feature[node[rows]] >= 0]
            at = node[rows]
            node[rows] = np.where(x[rows, feature[at]] <= threshold[at], left[at], right[at])
        return node

    def values(self, x: np.ndarray) -> np.ndarray:
        return np.array(self.value)[self.leaves(x)]

    def parts(self) -> dict:
        return {"feature": self.feature, "threshold": self.threshold, "left": self.left, "right": self.right, "value": self.value}


def held_rows(df: DataFrame) -> DataFrame:
    """``x, y, w`` of a labelled frame, held while a fit goes over them; weight 1 if there is none."""
    weight = F.col("weight") if "weight" in df.columns else F.lit(1.0)
    rows = df.select(vector_to_array("features").alias("x"), F.col("label").cast("double").alias("y"), weight.cast("double").alias("w"))
    return rows.persist(StorageLevel.MEMORY_AND_DISK)


def _arrays(batches: Iterator[pa.RecordBatch], dimension: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    for batch in batches:
        for at in range(0, batch.num_rows, ROWS):
            some = batch.slice(at, ROWS)
            x = some.column(0).flatten().to_numpy(zero_copy_only=False).reshape(-1, dimension)
            yield x, some.column(1).to_numpy(zero_copy_only=False), some.column(2).to_numpy(zero_copy_only=False)


def _grouped(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Order of the rows by key, the distinct keys, and where each one starts."""
    order = np.argsort(keys, kind="stable")
    found, starts = np.unique(keys[order], return_index=True)
    return order, found, starts


class ExtraTrees:
    """Extremely randomised trees (Geurts et al. 2006), without bootstrap.

    At every node ``sqrt(d)`` features are drawn, for each a threshold between the least and the
    greatest value that the node's rows have, and the best of these splits by Gini impurity is
    taken. A level is two aggregates for all trees together: the ranges, then the weights on both
    sides. Draws depend on (seed, tree, node) only, so a repeated task changes nothing.
    """

    def __init__(self, trees: int = 100, depth: int = 10, least_rows: int = 2, seed: int = 42) -> None:
        self.n_trees, self.depth, self.least_rows, self.seed = trees, depth, least_rows, seed
        self.trees: list[Tree] = []

    def _drawn(self, tree: int, node: int, dimension: int) -> np.ndarray:
        return np.random.default_rng([self.seed, tree, node, 0]).permutation(dimension)[: max(1, math.isqrt(dimension))]

    def fit(self, df: DataFrame) -> "ExtraTrees":
        rows = held_rows(df if "weight" in df.columns else class_weights(df))
        try:
            dimension = rows.select(F.size("x")).first()[0]
            n, weight, ones = rows.agg(F.count(F.lit(1)), F.sum("w"), F.sum(F.col("w") * F.col("y"))).first()
            self.trees = [Tree(value=[ones / weight]) for _ in range(self.n_trees)]
            pure = n < self.least_rows or ones in (0.0, weight)
            front = {} if pure else {(t, 0): None for t in range(self.n_trees)}
            for _ in range(self.depth):
                if not front:
                    break
                front = self._level(rows, front, dimension)
        finally:
            rows.unpersist()
        return self

    def _level(self, rows: DataFrame, front: dict, dimension: int) -> dict:
        """Split the leaves of the front; returns the children that can be split further."""
        nodes = list(front)
        places = {}
        for i, (tree, node) in enumerate(nodes):
            places.setdefault(tree, []).append((node, i))
        drawn = np.array([self._drawn(t, n, dimension) for t, n in nodes])
        trees = self.trees

        def standing(x: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
            """Per tree the rows that stand at the front, and the place of their node."""
            for tree, found in places.items():
                where = np.full(len(trees[tree].feature), -1)
                where[[n for n, _ in found]] = [i for _, i in found]
                place = where[trees[tree].leaves(x)]
                kept = np.flatnonzero(place >= 0)
                if len(kept):
                    yield kept, place[kept]

        def ranges(batches):
            low = np.full(drawn.shape, np.inf)
            high = np.full(drawn.shape, -np.inf)
            for x, _, _ in _arrays(batches, dimension):
                for kept, place in standing(x):
                    order, found, starts = _grouped(place)
                    values = x[kept[order][:, None], drawn[place[order]]]
                    low[found] = np.minimum(low[found], np.minimum.reduceat(values, starts, axis=0))
                    high[found] = np.maximum(high[found], np.maximum.reduceat(values, starts, axis=0))
            i, j = np.nonzero(low <= high)
            yield pa.RecordBatch.from_arrays([pa.array(i), pa.array(j), pa.array(low[i, j]), pa.array(high[i, j])], names=["i", "j", "low", "high"])

        found = rows.mapInArrow(ranges, "i long, j long, low double, high double").groupBy("i", "j").agg(F.min("low"), F.max("high")).toPandas().to_numpy()
        threshold = np.full(drawn.shape, np.nan)
        for (tree, node), i in zip(nodes, range(len(nodes))):
            threshold[i] = np.random.default_rng([self.seed, tree, node, 1]).uniform(size=drawn.shape[1])
        spread = np.full((2, *drawn.shape), np.nan)
        at = found[:, :2].astype(int)
        spread[:, at[:, 0], at[:, 1]] = found[:, 2:].T
        low, high = spread
        threshold = low + threshold * (high - low)
        threshold[~(high > low)] = np.nan  # a feature that is constant here splits nothing

        def sides(batches):
            total = np.zeros((*drawn.shape, 6))  # rows, weight and weight of class 1, left and right
            for x, y, w in _arrays(batches, dimension):
                for kept, place in standing(x):
                    order, found, starts = _grouped(place)
                    rows_, place_ = kept[order], place[order]
                    left = (x[rows_[:, None], drawn[place_]] <= threshold[place_])[:, :, None]
                    sums = np.stack([np.ones(len(rows_)), w[rows_], w[rows_] * y[rows_]], axis=1)[:, None, :]
                    both = np.concatenate([left * sums, ~left * sums], axis=2)
                    total[found] += np.add.reduceat(both, starts, axis=0)
            i, j = np.nonzero(total[:, :, [0, 3]].sum(2))
            yield pa.RecordBatch.from_arrays([pa.array(i), pa.array(j), *(pa.array(total[i, j, c]) for c in range(6))], names=["i", "j", *"abcdef"])

        summed = rows.mapInArrow(sides, "i long, j long, " + ", ".join(f"{c} double" for c in "abcdef")).groupBy("i", "j").agg(*[F.sum(c) for c in "abcdef"]).toPandas().to_numpy()
        total = np.zeros((*drawn.shape, 6))
        at = summed[:, :2].astype(int)
        total[at[:, 0], at[:, 1]] = summed[:, 2:]
        gain = split_gain(total[:, :, 1] - total[:, :, 2], total[:, :, 2], total[:, :, 4] - total[:, :, 5], total[:, :, 5])
        gain[np.isnan(threshold) | (total[:, :, 0] == 0) | (total[:, :, 3] == 0)] = -np.inf
        children = {}
        for i, (tree, node) in enumerate(nodes):
            # sums in another order may differ in their last digits: equal gains are equal to nine places
            j = int(np.round(gain[i], 9).argmax())
            if gain[i, j] == -np.inf:
                continue
            counts, weights, ones = (total[i, j, k::3] for k in range(3))
            pair = self.trees[tree].split(node, drawn[i, j], threshold[i, j], *(ones / weights))
            for child, n, w, one in zip(pair, counts, weights, ones):
                if n >= self.least_rows and 0 < one < w:
                    children[tree, child] = None
        return children

    def chances(self, x: np.ndarray) -> np.ndarray:
        return sum(t.values(x) for t in self.trees) / len(self.trees)

    def transform(self, df: DataFrame) -> DataFrame:
        return with_chances(df, self.chances)

    def parts(self) -> dict:
        return {"settings": {"trees": self.n_trees, "depth": self.depth, "least_rows": self.least_rows, "seed": self.seed}, "trees": [t.parts() for t in self.trees]}

    @classmethod
    def from_parts(cls, parts: dict) -> "ExtraTrees":
        model = cls(**parts["settings"])
        model.trees = [Tree(**t) for t in parts["trees"]]
        return model


def split_gain(l0, l1, r0, r1):
    """What a split leaves pure, to be made as large as possible: the smaller the weighted Gini
    impurity of both sides, the larger it is."""
    with np.errstate(divide="ignore", invalid="ignore"):
        left = np.where(l0 + l1 > 0, (l0 * l0 + l1 * l1) / (l0 + l1), 0.0)
        right = np.where(r0 + r1 > 0, (r0 * r0 + r1 * r1) / (r0 + r1), 0.0)
    return left + right


def cut_points(rows: DataFrame, dimension: int, bins: int) -> list[np.ndarray]:
    """Candidate thresholds of every feature: up to ``bins - 1`` of its quantiles, the greatest left out."""
    shares = [i / bins for i in range(1, bins)]
    found = (
        rows.select(F.posexplode("x").alias("i", "v")).groupBy("i")
        .agg(F.percentile_approx("v", shares, 10_000).alias("cuts"), F.max("v").alias("top")).collect()
    )
    cuts: list[np.ndarray] = [np.empty(0)] * dimension
    for r in found:
        points = np.unique(r["cuts"])
        cuts[r["i"]] = points[points < r["top"]]
    return cuts


class AdaBoost:
    """Discrete boosting of weighted trees (Zhu et al. 2009, two classes).

    The weight of a row follows from the trees so far, so it is computed where the row is read
    and never stored: a round is one aggregate over (node, feature, bin, class) per level, and
    one for the error, over the same held rows. Thresholds are quantiles of a feature, fixed for all
    rounds; the best split by weighted Gini impurity wins, ties go to the first feature and
    the lowest threshold. ``cuts`` gives the thresholds of all features instead.
    """

    def __init__(self, rounds: int = 50, rate: float = 1.0, depth: int = 1, bins: int = 32, cuts: Sequence[float] | None = None) -> None:
        self.rounds, self.rate, self.depth, self.bins = rounds, rate, depth, bins
        self.given = None if cuts is None else sorted(cuts)
        self.trees: list[tuple[Tree, float]] = []
        self.history: list[tuple[float, float]] = []  # gain of the root and error, per round

    def fit(self, df: DataFrame) -> "AdaBoost":
        rows = held_rows(df)
        try:
            dimension = rows.select(F.size("x")).first()[0]
            self.cuts = cut_points(rows, dimension, self.bins) if self.given is None else [np.array(self.given)] * dimension
            for _ in range(self.rounds):
                tree = self._tree(rows, dimension)
                wrong, weight = self._error(rows, dimension, tree)
                error = wrong / weight
                self.history.append((self.root_gain, error))
                if error <= 0:
                    self.trees.append((tree, 1.0))
                    break
                if error >= 0.5 - 1e-12:
                    break
                self.trees.append((tree, self.rate * math.log((1 - error) / error)))
        finally:
            rows.unpersist()
        if not self.trees:
            raise ValueError("the first tree is no better than chance")
        return self

    def weights(self, x: np.ndarray, y: np.ndarray, w: np.ndarray) -> np.ndarray:
        """Weights of rows after the trees so far, up to a common factor."""
        raised = sum((alpha * ((t.values(x) > 0.5) != (y == 1)) for t, alpha in self.trees), np.zeros(len(x)))
        return w * np.exp(raised - sum(alpha for _, alpha in self.trees))

    def _tree(self, rows: DataFrame, dimension: int) -> Tree:
        """One weighted tree, a level at a time."""
        tree, front, cuts = Tree(), [0], self.cuts
        widest = max((len(c) for c in cuts), default=0) + 1
        for level in range(self.depth):

            def histogram(batches):
                sums = np.zeros((len(front), dimension, widest, 2))
                where = np.full(len(tree.feature), -1)
                where[front] = np.arange(len(front))
                for x, y, w in _arrays(batches, dimension):
                    w, place = self.weights(x, y, w), where[tree.leaves(x)]
                    kept = place >= 0
                    for f in range(dimension):
                        np.add.at(sums, (place[kept], f, np.searchsorted(cuts[f], x[kept, f]), y[kept].astype(int)), w[kept])
                at = np.nonzero(sums)
                yield pa.RecordBatch.from_arrays([*(pa.array(a) for a in at), pa.array(sums[at])], names=["i", "f", "b", "y", "w"])

            found = rows.mapInArrow(histogram, "i long, f long, b long, y long, w double").groupBy("i", "f", "b", "y").agg(F.sum("w")).toPandas().to_numpy()
            sums = np.zeros((len(front), dimension, widest, 2))
            sums[tuple(found[:, :4].astype(int).T)] = found[:, 4]
            upto = sums.cumsum(axis=2)
            all_ = upto[:, :, -1:]
            gain = split_gain(upto[..., 0], upto[..., 1], (all_ - upto)[..., 0], (all_ - upto)[..., 1])
            allowed = np.array([[b < len(c) for b in range(widest)] for c in cuts])
            gain[:, ~allowed] = -np.inf
            gain[(upto.sum(3) <= 0) | ((all_ - upto).sum(3) <= 0)] = -np.inf
            children = []
            for i, node in enumerate(front):
                if level == 0:
                    tree.value[0] = float(all_[i, 0, 0, 1] / max(all_[i, 0, 0].sum(), 1e-300))
                f, b = np.unravel_index(int(np.round(gain[i], 9).argmax()), gain[i].shape)
                if level == 0:
                    self.root_gain = float(gain[i, f, b])
                sides = np.stack([upto[i, f, b], all_[i, f, 0] - upto[i, f, b]])
                if gain[i, f, b] == -np.inf or (sides.sum(1) <= 0).any():
                    continue
                children += tree.split(node, f, cuts[f][b], *(sides[:, 1] / sides.sum(1)))
            front = children
            if not front:
                break
        return tree

    def _error(self, rows: DataFrame, dimension: int, tree: Tree) -> tuple[float, float]:
        def wrong(batches):
            missed = all_ = 0.0
            for x, y, w in _arrays(batches, dimension):
                w = self.weights(x, y, w)
                missed += float(w[(tree.values(x) > 0.5) != (y == 1)].sum())
                all_ += float(w.sum())
            yield pa.RecordBatch.from_arrays([pa.array([missed]), pa.array([all_])], names=["a", "b"])

        return tuple(rows.mapInArrow(wrong, "a double, b double").agg(F.sum("a"), F.sum("b")).first())

    def chances(self, x: np.ndarray) -> np.ndarray:
        votes = sum(alpha * np.where(t.values(x) > 0.5, 1.0, -1.0) for t, alpha in self.trees) / sum(a for _, a in self.trees)
        return 1 / (1 + np.exp(-votes))

    def transform(self, df: DataFrame) -> DataFrame:
        return with_chances(df, self.chances)

    def parts(self) -> dict:
        return {"settings": {"rounds": self.rounds, "rate": self.rate, "depth": self.depth, "bins": self.bins, "cuts": self.given}, "trees": [[t.parts(), a] for t, a in self.trees]}

    @classmethod
    def from_parts(cls, parts: dict) -> "AdaBoost":
        model = cls(**parts["settings"])
        model.trees = [(Tree(**t), a) for t, a in parts["trees"]]
        return model


def with_chances(df: DataFrame, chances: Callable[[np.ndarray], np.ndarray]) -> DataFrame:
    """With ``probability`` of class 1 and ``prediction``; rows reach the model in Arrow batches."""

    @F.pandas_udf("double")
    def chance(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield pd.Series(chances(np.stack(batch.to_numpy())) if len(batch) else [], dtype=float)

    return df.withColumn("probability", chance(vector_to_array("features"))).withColumn("prediction", (F.col("probability") > 0.5).cast("double"))


def node_rows(spark: SparkSession, trees: list[Tree]) -> DataFrame:
    """Trees as a table ``tree, node, feature, threshold, left, right, value``."""
    rows = [(t, i, f, th, l, r, v) for t, tree in enumerate(trees) for i, (f, th, l, r, v) in enumerate(zip(tree.feature, tree.threshold, tree.left, tree.right, tree.value))]
    return spark.createDataFrame(rows, "tree INT, node INT, feature INT, threshold DOUBLE, left INT, right INT, value DOUBLE")
