"""Support vector classifier with an RBF kernel: a cascade of local dual problems, or working sets against all rows."""

from __future__ import annotations

import math
from collections import OrderedDict
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import Broadcast, SparkContext
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from trigwatch.functions.ordering import ranked_within
from trigwatch.operators.trees import with_chances
from trigwatch.session import cut_lineage

#: bytes of kernel columns that a local problem keeps
KERNEL_BYTES = 256 * 1024 * 1024
#: rows and columns of a kernel block while rows are scored; a block stays in a core's cache
BLOCK = 512
#: rows that are solved at once; of larger problems, as many at a time
WORKING = 2000
#: rows up to which the parts of a problem are joined to one that a task solves
JOINED = 4000
#: rows of a working set of larger ones: its kernel in single precision has ``KERNEL_BYTES``
SET = math.isqrt(KERNEL_BYTES // 4)
#: least tolerance of a local problem, above the rounding of its sums
FINEST = 1e-9
#: rows of a level; ``model`` is the fold that the problem does not see
ROWS = "model INT, id BIGINT, part INT, y DOUBLE, cap DOUBLE, alpha DOUBLE, x ARRAY<DOUBLE>"


def rbf(a: np.ndarray, b: np.ndarray, gamma: float) -> np.ndarray:
    apart = (a * a).sum(1)[:, None] + (b * b).sum(1) - 2 * a @ b.T
    return np.exp(-gamma * np.maximum(apart, 0))


def sides(x: np.ndarray, gamma: float, kind: type = float) -> tuple[np.ndarray, np.ndarray]:
    """Two forms of the rows: the product of one of the first and one of the second is the logarithm of their kernel."""
    own, one = -gamma * (x * x).sum(1), np.ones(len(x))
    return np.c_[2 * gamma * x, own, one].astype(kind), np.c_[x, one, own].astype(kind)


def kernel_block(left: np.ndarray, right: np.ndarray, out: np.ndarray) -> np.ndarray:
    """Kernel of rows given by their ``sides``, in place."""
    np.matmul(left, right.T, out=out)
    np.minimum(out, 0, out=out)
    return np.exp(out, out=out)


def kernel_sums(x: np.ndarray, vectors: np.ndarray, weights: np.ndarray, gamma: float) -> np.ndarray:
    """Kernel of each row with all support vectors times their weights, block by block."""
    out, cells = np.zeros((len(x), weights.shape[1])), np.empty(BLOCK * BLOCK)
    if not len(x) or not len(vectors):
        return out
    left, right = sides(x, gamma)[0], sides(vectors, gamma)[1]
    for at in range(0, len(x), BLOCK):
        rows = left[at : at + BLOCK]
        for to in range(0, len(vectors), BLOCK):
            some = right[to : to + BLOCK]
            block = cells[: len(rows) * len(some)].reshape(len(rows), len(some))
            out[at : at + BLOCK] += kernel_block(rows, some, block) @ weights[to : to + BLOCK]
    return out


class Columns:
    """Kernel columns computed when asked for; the least lately used ones make room."""

    def __init__(self, x: np.ndarray, gamma: float) -> None:
        self.x, self.gamma, self.held = x, gamma, OrderedDict()
        self.most = max(2, KERNEL_BYTES // (8 * max(1, len(x))))

    def __getitem__(self, i: int) -> np.ndarray:
        if i not in self.held:
            if len(self.held) >= self.most:
                self.held.popitem(last=False)
            self.held[i] = rbf(self.x, self.x[i : i + 1], self.gamma)[:, 0]
        self.held.move_to_end(i)
        return self.held[i]


def solve_dual(x: np.ndarray, y: np.ndarray, cap: np.ndarray, alpha: np.ndarray, gamma: float, tolerance: float) -> tuple[np.ndarray, float]:
    """Multipliers and bias of the dual problem, from feasible multipliers on.

    Up to ``WORKING`` rows are one problem for ``pair_steps``. Of more rows, those that break the
    optimality conditions most are solved with the others held fixed, as often as it takes: a
    round computes the kernel of the rows it changed only, by matrix products.
    """
    alpha = alpha.copy()
    value = np.zeros(len(x))  # sum over the support vectors, without the bias
    if len(x) <= WORKING:
        k = Columns(x, gamma)
        for i in np.flatnonzero(alpha):
            value += alpha[i] * y[i] * k[i]
        return pair_steps(k, y, cap, alpha, value, tolerance)
    on = np.flatnonzero(alpha)
    value += kernel_sums(x, x[on], (alpha[on] * y[on])[:, None], gamma)[:, 0]
    while True:
        lack = y - value
        rise, fall = np.flatnonzero(np.where(y > 0, alpha < cap, alpha > 0)), np.flatnonzero(np.where(y > 0, alpha > 0, alpha < cap))
        if not len(rise) or not len(fall):
            return alpha, float(np.median(lack))
        most, least = lack[rise].max(), lack[fall].min()
        if most - least <= tolerance:
            return alpha, float((most + least) / 2)
        half = WORKING // 2
        some = np.union1d(rise[np.argsort(-lack[rise], kind="stable")[:half]], fall[np.argsort(lack[fall], kind="stable")[:half]])
        after, _ = pair_steps(rbf(x[some], x[some], gamma), y[some], cap[some], alpha[some], value[some], max(tolerance / 2, (most - least) / 10))
        changed = after != alpha[some]
        value += kernel_sums(x, x[some[changed]], ((after - alpha[some]) * y[some])[changed, None], gamma)[:, 0]
        alpha[some] = after


def pair_steps(k, y: np.ndarray, cap: np.ndarray, alpha: np.ndarray, value: np.ndarray, tolerance: float, most: float = math.inf) -> tuple[np.ndarray, float]:
    """Multipliers and bias, given the kernel by columns and the value of each row.

    Each step changes the pair that breaks the optimality conditions most (second choice by
    the gain it promises), until no pair breaks them by more than ``tolerance``, or ``most``
    steps are done.
    """
    if not len(y):
        return alpha.copy(), 0.0
    alpha, value, steps = alpha.copy(), value.copy(), 0
    # what is added to rows that can't rise, or can't fall, puts them last
    no_rise = np.where(np.where(y > 0, alpha < cap, alpha > 0), 0.0, -np.inf)
    no_fall = np.where(np.where(y > 0, alpha > 0, alpha < cap), 0.0, np.inf)
    lack, work, gain = np.empty(len(y)), np.empty(len(y)), np.empty(len(y))
    while True:
        np.subtract(y, value, out=lack)
        np.add(lack, no_rise, out=work)
        np.add(lack, no_fall, out=gain)
        i = int(work.argmax())
        top, least = work[i], gain.min()
        if np.isinf(top) or np.isinf(least):
            return alpha, float(np.median(lack))
        if top - least <= tolerance or steps >= most:
            return alpha, float((top + least) / 2)
        np.subtract(top, gain, out=gain)
        np.maximum(gain, 0, out=gain)
        np.multiply(gain, gain, out=gain)
        ki = k[i]
        np.multiply(ki, -2.0, out=work)
        np.add(work, 2.0, out=work)
        bend = np.maximum(work, 1e-12, out=work)
        j = int(np.divide(gain, bend, out=gain).argmax())
        room_i = cap[i] - alpha[i] if y[i] > 0 else alpha[i]
        room_j = alpha[j] if y[j] > 0 else cap[j] - alpha[j]
        step = min((top - lack[j]) / bend[j], room_i, room_j)
        for row, sign, room in ((i, 1.0, room_i), (j, -1.0, room_j)):
            alpha[row] += sign * y[row] * step
            if step == room:  # lands on its bound exactly
                alpha[row] = cap[row] if alpha[row] > cap[row] / 2 else 0.0
            below, above = (alpha[row] < cap[row], alpha[row] > 0)[:: 1 if y[row] > 0 else -1]
            no_rise[row], no_fall[row] = 0.0 if below else -np.inf, 0.0 if above else np.inf
        np.subtract(ki, k[j], out=work)
        np.multiply(work, step, out=work)
        value += work
        steps += 1


def solve_set(x: np.ndarray, y: np.ndarray, cap: np.ndarray, alpha: np.ndarray, value: np.ndarray, gamma: float, tolerance: float) -> np.ndarray:
    """Multipliers of a working set, the rows outside held fixed. Its kernel is in single
    precision: what that leaves over is seen in the values, which are exact, and the next sets."""
    left, right = sides(x, gamma, np.float32)
    k = kernel_block(left, right, np.empty((len(x), len(x)), np.float32))
    return pair_steps(k, y, cap, alpha, value, tolerance, 20 * len(x))[0]


def working_set(y: np.ndarray, cap: np.ndarray, alpha: np.ndarray, value: np.ndarray, alone: np.ndarray, size: int, draw: np.random.Generator) -> tuple[float, float, np.ndarray]:
    """Bias of a problem, by how much a pair breaks its conditions, and rows to solve together.

    A fifth of them are those that break the conditions most, the others are drawn among all that
    break them or are off their bounds: sets of the worst alone leave each other's traces. If no
    row can rise, or none can fall, the bias is that of the rows ``alone``.
    """
    lack = y - value
    can_rise, can_fall = np.where(y > 0, alpha < cap, alpha > 0), np.where(y > 0, alpha > 0, alpha < cap)
    rise, fall = np.flatnonzero(can_rise), np.flatnonzero(can_fall)
    if not len(rise) or not len(fall):
        return float(np.median(lack[alone])) if alone.any() else 0.0, 0.0, rise[:0]
    most, least = lack[rise].max(), lack[fall].min()
    bias, few = float((most + least) / 2), max(1, size // 10)
    worst = np.union1d(rise[np.argsort(-lack[rise], kind="stable")[:few]], fall[np.argsort(lack[fall], kind="stable")[:few]])
    others = np.setdiff1d(np.flatnonzero((can_rise & can_fall) | (can_rise & (lack > bias)) | (can_fall & (lack < bias))), worst)
    return bias, float(most - least), np.union1d(worst, draw.permutation(others)[: max(0, size - len(worst))])


def solved_sets(held: Broadcast, problems: list[tuple], gamma: float) -> list[tuple]:
    """``model, rows, multipliers`` of each working set, a task each."""

    def solve(problem: tuple) -> tuple:
        m, some, y, cap, alpha, value, tolerance = problem
        return m, some, solve_set(held.value[some], y, cap, alpha, value, gamma, tolerance)

    return SparkContext.getOrCreate().parallelize(problems, len(problems)).map(solve).collect()


def summed_changes(held: Broadcast, weights: np.ndarray, gamma: float) -> np.ndarray:
    """Kernel of each row with the rows that have a weight in any model times their weights, blocks of rows by task."""
    changed = np.flatnonzero(weights.any(axis=1))
    added = weights[changed]
    sc = SparkContext.getOrCreate()
    n_blocks = min(2 * sc.defaultParallelism, math.ceil(len(weights) / BLOCK))
    bounds = [len(weights) * i // n_blocks for i in range(n_blocks + 1)]

    def sums(block: tuple[int, int]) -> np.ndarray:
        return kernel_sums(held.value[block[0] : block[1]], held.value[changed], added, gamma)

    return np.concatenate(sc.parallelize(list(zip(bounds, bounds[1:])), n_blocks).map(sums).collect())


class KernelSvm:
    """RBF support vector classifier with calibrated probabilities.

    The rows are dealt to parts by hash. Every part solves its own dual problem; the support
    vectors of two parts meet and are solved again, until one part is left (Graf et al. 2004).
    All rows are scored by its support vectors, and those inside the margin that the cascade
    has dropped join the last part, which is solved on, and so on until the duality gap over
    all training rows is at most ``tolerance`` of the dual value: the result is that of one
    problem over all of them. The models that hold back a fold are fitted in the same passes, as
    further groups; their margins on the rows they have not seen calibrate the probabilities.

    Above ``JOINED`` rows the last part is too much for a task. Then the driver holds multipliers
    and values of all rows, and each round solves a working set for every model: the rows that
    break its conditions most, and others that break them, one model a task. All rows then get the change of the values, in
    tasks over blocks of them, with the same end: the duality gap over all training rows.

    Equal rows of a class are one row with a larger bound. All rows are fitted; ``most_rows``, if
    given, bounds the different rows of the classes to half of it each, the first ones by hash.
    Classes are weighed to balance, and the calibration counts them as they are in all rows. The
    time grows with the square of the rows; ``FourierSvm`` has an approximate kernel instead.
    Rows with null features or a null label are left out; of one class only, that class gets all
    the probability (of no rows, class 0).
    """

    def __init__(
        self, c: float = 1.0, gamma: float | None = None, tolerance: float = 1e-3, folds: int = 5, part_rows: int = 1000,
        most_rows: int | None = None, passes: int = 20,
    ) -> None:
        self.c, self.gamma, self.tolerance, self.folds = c, gamma, tolerance, folds
        self.part_rows, self.most_rows, self.passes = part_rows, most_rows, passes

    # --- fit ---------------------------------------------------------------------------------

    def fit(self, df: DataFrame) -> "KernelSvm":
        usable = df.where(F.col("features").isNotNull() & F.col("label").isNotNull())
        rows = usable.select(F.col("label").cast("double").alias("label"), vector_to_array("features").alias("x"))
        hashed = F.xxhash64("x", "label")
        found = rows.groupBy("label").agg(F.count(F.lit(1)), F.max(F.size("x")))
        sizes = {r[0]: r[1:] for r in found.limit(3).collect()}
        self.classes, self.dimension = sorted(sizes), max((s[1] for s in sizes.values()), default=0)
        if len(sizes) > 2:
            raise ValueError("a support vector classifier needs two classes")
        if self.gamma is None:
            spread = rows.select(F.explode("x").alias("v")).agg(F.var_pop("v")).first()[0]
            self.gamma = 1.0 / (self.dimension * spread) if spread else 1.0
        if len(sizes) < 2:
            self._constant(self.classes[0] if sizes else 0.0)
            return self
        place = F.pmod(hashed, F.lit(2**31)).alias("place")
        chosen = ranked_within(rows.groupBy("label", "x").agg(F.count(F.lit(1)).alias("copies")).select("*", place), "label", [F.col("place"), F.col("x")], "place")
        chosen = cut_lineage(chosen if self.most_rows is None else chosen.where(F.col("place") <= self.most_rows // 2))
        counted = chosen.groupBy("label").agg(F.sum("copies"), F.count(F.lit(1))).collect()
        taken, self.n_rows = {r[0]: r[1] for r in counted}, sum(r[2] for r in counted)
        second = F.col("label") == self.classes[1]
        caps, shares = ({y: v(y) for y in sizes} for v in (lambda y: self.c * sum(taken.values()) / (2 * taken[y]), lambda y: sizes[y][0] / taken[y]))
        base = chosen.select(
            (2 * F.col("place") + second.cast("int")).cast("long").alias("id"), (F.col("place") % self.folds).cast("int").alias("fold"),
            F.when(second, 1.0).otherwise(-1.0).alias("y"), "x",
            *[(F.col("copies") * F.when(second, of[self.classes[1]]).otherwise(of[self.classes[0]])).alias(n) for n, of in (("cap", caps), ("share", shares))],
        )
        if self.n_rows > JOINED:
            found = self._by_sets(base)
        else:
            base = cut_lineage(base.repartition(self._n_parts(), "id") if self._n_parts() > 1 else base)
            self._cascade(base)
            found = self._unseen(base)
        self.slope, self.offset = logistic_line(found["margin"].to_numpy(), found["y"].to_numpy() > 0, found["share"].to_numpy())
        return self

    def _constant(self, label: float) -> None:
        self.vectors, self.weights, self.bias = np.zeros((0, self.dimension)), np.zeros(0), 0.0
        self.slope, self.offset = 0.0, 500.0 if label > 0 else -500.0
        self.converged, self.gap, self.n_passes, self.n_rows, self.details = True, 0.0, 0, 0, None

    def _n_parts(self) -> int:
        return 1 << max(0, math.ceil(math.log2(max(1, self.n_rows) / self.part_rows)))

    def _cascade(self, base: DataFrame) -> None:
        everyone = F.array(*[F.lit(m) for m in range(self.folds + 1)])  # the last one sees every fold
        own = base.withColumn("model", F.explode(everyone)).where("model <> fold").withColumn("alpha", F.lit(0.0))
        open_, state, scored = set(range(self.folds + 1)), None, None
        for self.n_passes in range(1, self.passes + 1):
            tolerance = max(FINEST, self.tolerance / 10**self.n_passes)
            if state is None:
                state = self._level(own, tolerance)
            else:
                active = F.col("model").isin(*open_)
                state = cut_lineage(state.where(~active).unionByName(self._again(own.where(active), state.where(active), scored, tolerance)))
            self._take(state)
            scored = self._scored(base)
            gaps = self._gaps(scored)
            self.gap, open_ = gaps[self.folds], {m for m, gap in gaps.items() if gap > self.tolerance}
            if not open_:
                break
        self.converged = not open_
        mine = self.tables[self.folds]
        at = np.searchsorted(self.pool_ids, mine["id"])
        self.vectors, self.weights, self.bias = self.pool[at], self.pool_weights[at, self.folds], float(self.biases[self.folds])
        self.details = mine[["id", "y", "cap", "alpha"]].to_numpy()

    def _solver(self, tolerance: float):
        gamma = self.gamma

        def solve(group: pd.DataFrame) -> pd.DataFrame:
            y, cap = group["y"].to_numpy(), group["cap"].to_numpy()
            alpha, bias = solve_dual(np.stack(group["x"].to_numpy()), y, cap, group["alpha"].to_numpy(), gamma, tolerance)
            kept = alpha > 0
            if not kept.any():  # one class: a row hands on the bias
                kept[0] = True
            return group.assign(alpha=alpha, bias=bias)[kept]

        return solve

    def _level(self, own: DataFrame, tolerance: float) -> DataFrame:
        """The first pass: parts of the rows, solved and joined down to one part."""
        columns, parts, solve = ["model", "id", "part", "y", "cap", "alpha", "x"], self._n_parts(), self._solver(tolerance)
        rows = own.withColumn("part", F.pmod(F.hash("id"), F.lit(parts))).select(*columns)
        level = rows.groupBy("model", "part").applyInPandas(solve, ROWS + ", bias DOUBLE")
        while parts > 1:
            parts //= 2
            # both halves meet the constraints and share no row: so does their sum
            joined = cut_lineage(level).withColumn("part", F.col("part") % parts)
            level = joined.select(*columns).groupBy("model", "part").applyInPandas(solve, ROWS + ", bias DOUBLE")
        return cut_lineage(level)

    def _again(self, own: DataFrame, state: DataFrame, scored: DataFrame, tolerance: float) -> DataFrame:
        """The last part solved on, with the rows inside the margin that have no multiplier yet."""
        columns, support = ["model", "id", "part", "y", "cap", "alpha", "x"], state.where("alpha > 0")
        missed = own.join(scored.where("missed").select("model", "id"), ["model", "id"], "left_semi").withColumn("part", F.lit(0))
        rows = support.select(*columns).unionByName(missed.select(*columns))
        return rows.groupBy("model", "part").applyInPandas(self._solver(tolerance), ROWS + ", bias DOUBLE")

    def _take(self, state: DataFrame) -> None:
        """Support vectors of all models, each once, with a column of weights per model."""
        found = state.select("model", "id", "y", "cap", "alpha", "bias").toPandas()
        pool = state.where("alpha > 0").groupBy("id").agg(F.first("x").alias("x")).toPandas().sort_values("id")
        self.pool_ids = pool["id"].to_numpy()
        self.pool = np.stack(pool["x"].to_numpy()) if len(pool) else np.zeros((0, self.dimension))
        self.pool_weights, self.biases, self.tables = np.zeros((len(pool), self.folds + 1)), np.zeros(self.folds + 1), {}
        for m in range(self.folds + 1):
            one = found[found["model"] == m]
            held = one[one["alpha"] > 0].sort_values("id")
            self.biases[m] = one["bias"].iloc[0] if len(one) else 0.0
            self.pool_weights[np.searchsorted(self.pool_ids, held["id"]), m] = held["alpha"] * held["y"]
            self.tables[m] = held

    def _scorer(self):
        pool, weights, biases, gamma = self.pool, self.pool_weights, self.biases, self.gamma
        return lambda x: kernel_sums(x, pool, weights, gamma) + biases

    def _scored(self, base: DataFrame) -> DataFrame:
        """``model, id, loss, length, missed``: what each row a model sees adds to its loss and to the
        square of its weights, and whether it is inside the margin without a multiplier."""
        margins, n, ids, weights, biases = self._scorer(), self.folds + 1, self.pool_ids, self.pool_weights, self.biases

        def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                y, own = batch["y"].to_numpy()[:, None], np.zeros((len(batch), n))
                if len(ids):
                    at = np.minimum(np.searchsorted(ids, batch["id"]), len(ids) - 1)
                    own = np.where((ids[at] == batch["id"].to_numpy())[:, None], weights[at], 0.0)
                found = margins(np.stack(batch["x"].to_numpy()))
                inside = np.maximum(0, 1 - y * found)
                row, model = np.nonzero(batch["fold"].to_numpy()[:, None] != np.arange(n))
                yield pd.DataFrame({
                    "model": model, "id": batch["id"].to_numpy()[row], "loss": (batch["cap"].to_numpy()[:, None] * inside)[row, model],
                    "length": (own * (found - biases))[row, model], "missed": ((inside > 0) & (own == 0))[row, model],
                })

        return cut_lineage(base.mapInPandas(score, "model INT, id BIGINT, loss DOUBLE, length DOUBLE, missed BOOLEAN"))

    def _gaps(self, scored: DataFrame) -> dict[int, float]:
        """Duality gap of each model over all its rows, as a share of its dual value."""
        sums = {r.model: r for r in scored.groupBy("model").agg(F.sum("loss").alias("loss"), F.sum("length").alias("length")).collect()}
        gaps = {}
        for m in range(self.folds + 1):
            loss, length = (sums[m].loss, sums[m].length) if m in sums else (0.0, 0.0)
            dual = float(self.tables[m]["alpha"].sum() - length / 2)
            gaps[m] = (length / 2 + loss - dual) / max(dual, 1e-12)
        return gaps

    def _unseen(self, base: DataFrame) -> pd.DataFrame:
        """``y, share, margin`` of all rows, the margins by the models that did not see the row."""
        margins = self._scorer()

        def unseen(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                found = margins(np.stack(batch["x"].to_numpy()))
                yield batch[["y", "share"]].assign(margin=found[np.arange(len(batch)), batch["fold"].to_numpy()])

        return base.mapInPandas(unseen, "y DOUBLE, share DOUBLE, margin DOUBLE").orderBy("margin", "y").toPandas()

    def _by_sets(self, base: DataFrame) -> pd.DataFrame:
        """Fit of all models by working sets; returns ``y, share, margin`` of all rows, the margins by
        the models that did not see the row.

        The rows are sent to the executors once. What the driver holds for a row are its features
        and a few numbers for each model.
        """
        sc, n_models = base.sparkSession.sparkContext, self.folds + 1
        rows = base.select("id", "fold", "y", "cap", "share", "x").toArrow().sort_by("id")
        x = rows["x"].combine_chunks().flatten().to_numpy().reshape(len(rows), -1)
        ids, fold, y, own, share = (rows[c].to_numpy() for c in ("id", "fold", "y", "cap", "share"))
        seen = fold[:, None] != np.arange(n_models)  # the last one sees every fold
        cap = np.where(seen, own[:, None], 0.0)
        alpha, value, biases, gaps = np.zeros(cap.shape), np.zeros(cap.shape), np.zeros(n_models), np.full(n_models, np.inf)
        size = min(SET, max(WORKING, math.ceil(len(y) / 4)))
        held, draw = sc.broadcast(x), np.random.default_rng(len(y))
        for self.n_passes in range(self.passes * math.ceil(len(y) / size) + 1):
            problems = []
            for m in np.flatnonzero(gaps > self.tolerance):
                biases[m], apart, some = working_set(y, cap[:, m], alpha[:, m], value[:, m], seen[:, m], size, draw)
                gaps[m] = self._gap(y, cap[:, m], alpha[:, m], value[:, m], biases[m])
                if gaps[m] > self.tolerance:
                    problems.append((m, some, y[some], cap[some, m], alpha[some, m], value[some, m], max(FINEST, apart / 10)))
            if not problems:
                break
            weights = np.zeros(cap.shape)
            for m, some, after in solved_sets(held, problems, self.gamma):
                weights[some, m], alpha[some, m] = (after - alpha[some, m]) * y[some], after
            value += summed_changes(held, weights, self.gamma)
        held.destroy()
        self.gap, self.converged = float(gaps[-1]), bool((gaps <= self.tolerance).all())
        kept = alpha[:, -1] > 0
        self.vectors, self.weights, self.bias = x[kept], (alpha[:, -1] * y)[kept], float(biases[-1])
        self.details = np.c_[ids, y, own, alpha[:, -1]][kept]
        found = pd.DataFrame({"y": y, "share": share, "margin": (value + biases)[np.arange(len(y)), fold]})
        return found.sort_values(["margin", "y"])

    @staticmethod
    def _gap(y: np.ndarray, cap: np.ndarray, alpha: np.ndarray, value: np.ndarray, bias: float) -> float:
        """Duality gap as a share of the dual value."""
        length, loss = float((alpha * y) @ value), float(cap @ np.maximum(0, 1 - y * (value + bias)))
        dual = float(alpha.sum()) - length / 2
        return (length / 2 + loss - dual) / max(dual, 1e-12)

    # --- use ---------------------------------------------------------------------------------

    def margins(self, x: np.ndarray) -> np.ndarray:
        return kernel_sums(x, self.vectors, self.weights[:, None], self.gamma)[:, 0] + self.bias

    def chances(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * self.margins(x) + self.offset, -500, 500)))

    def transform(self, df: DataFrame) -> DataFrame:
        # each row meets all support vectors, and the few bytes of the rows would make one task of them
        spread = df.repartition(df.sparkSession.sparkContext.defaultParallelism) if len(self.vectors) > WORKING else df
        return with_chances(spread, self.chances)

    def parts(self) -> dict:
        names = ("c", "gamma", "tolerance", "folds", "part_rows", "most_rows", "passes")
        fitted = {n: getattr(self, n) for n in ("dimension", "n_rows", "bias", "slope", "offset", "converged", "gap", "n_passes", "classes")}
        return {"settings": {n: getattr(self, n) for n in names}, "fitted": fitted, "vectors": self.vectors.tolist(), "weights": self.weights.tolist()}

    @classmethod
    def from_parts(cls, parts: dict) -> "KernelSvm":
        model = cls(**parts["settings"])
        vars(model).update(parts["fitted"])
        model.weights = np.array(parts["weights"])
        model.vectors = np.array(parts["vectors"]).reshape(len(model.weights), model.dimension)
        return model


def logistic_line(margin: np.ndarray, y: np.ndarray, share: np.ndarray, rounds: int = 100) -> tuple[float, float]:
    """Slope and offset of the likeliest logistic curve, with class shares smoothed by one row
    (Platt 1999); ``share`` is the number of rows that each one stands for."""
    n1, n0 = float(share[y].sum()), float(share[~y].sum())
    target = np.where(y, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    w, x = np.array([0.0, math.log((n1 + 1) / (n0 + 1))]), np.c_[margin, np.ones(len(margin))]

    def loss(w: np.ndarray) -> float:
        z = x @ w
        return float((share * (np.logaddexp(0, z) - target * z)).sum())

    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -500, 500)))
        step = np.linalg.solve((x * (share * p * (1 - p))[:, None]).T @ x + 1e-10 * np.eye(2), x.T @ (share * (p - target)))
        size, now = 1.0, loss(w)
        while loss(w - size * step) > now and size > 1e-10:
            size /= 2
        w = w - size * step
        if np.abs(size * step).max() < 1e-10:
            break
    return float(w[0]), float(w[1])


def support_table(spark: SparkSession, model: KernelSvm) -> DataFrame:
    """Support vectors of a fit: ``support, y, cap, alpha, x``."""
    details = np.zeros((0, 4)) if model.details is None else model.details
    columns = {n: pa.array(details[:, i], pa.int64() if n == "support" else pa.float64()) for i, n in enumerate(("support", "y", "cap", "alpha"))}
    ends = pa.array(np.arange(len(details) + 1) * model.dimension, pa.int32())
    features = pa.ListArray.from_arrays(ends, pa.array(model.vectors.ravel(), pa.float64()))
    return spark.createDataFrame(pa.table(columns | {"x": features}), "support BIGINT, y DOUBLE, cap DOUBLE, alpha DOUBLE, x ARRAY<DOUBLE>")


def with_margins(df: DataFrame, model: KernelSvm) -> DataFrame:
    """Rows with ``f``, the margin of their ``x``: the kernel with each support vector, times its weight, and the bias."""
    vectors, weights, bias, gamma = model.vectors, model.weights[:, None], model.bias, model.gamma

    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield batch.assign(f=kernel_sums(np.stack(batch["x"].to_numpy()), vectors, weights, gamma)[:, 0] + bias)

    return df.mapInPandas(score, T.StructType([*df.schema.fields, T.StructField("f", T.DoubleType())]))
