"""Cluster figures, distance outliers and exact density clustering."""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import product

import numpy as np
import pandas as pd
from pyspark.ml.evaluation import ClusteringEvaluator
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trigwatch.functions.ordering import exact_percentile_by, running_totals
from trigwatch.session import cut_lineage, settled


def squared_distance(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, v: s + v)


def distance(a: Column, b: Column) -> Column:
    return F.sqrt(squared_distance(a, b))


def cluster_sizes(df: DataFrame, cluster: str = "cluster") -> DataFrame:
    return df.groupBy(cluster).agg(F.count(F.lit(1)).alias("n"))


def cluster_summary(df: DataFrame, cluster: str = "cluster") -> DataFrame:
    """Clusters found, noise points (-1) and their share."""
    return cluster_sizes(df, cluster).agg(
        F.count_if(F.col(cluster) >= 0).alias("n_clusters"),
        F.coalesce(F.sum(F.when(F.col(cluster) == -1, F.col("n"))), F.lit(0)).alias("noise_points"),
        (F.coalesce(F.sum(F.when(F.col(cluster) == -1, F.col("n"))), F.lit(0)) / F.sum("n")).alias("noise_ratio"),
    )


def centers(df: DataFrame, cluster: str = "cluster", features: str = "features") -> DataFrame:
    """Mean vector and size per cluster, averaged position by position (map-side combined)."""
    return (
        df.select(cluster, F.posexplode(features).alias("pos", "x"))
        .groupBy(cluster, "pos")
        .agg(F.avg("x").alias("mean"), F.count(F.lit(1)).alias("n"))
        .groupBy(cluster)
        .agg(F.sort_array(F.collect_list(F.struct("pos", "mean"))).alias("c"), F.max("n").alias("n"))
        .select(cluster, F.col("c.mean").alias("center"), "n")
    )


def point_center_distance(df: DataFrame, centers_df: DataFrame, cluster: str = "cluster", features: str = "features") -> DataFrame:
    """Distance of every point to its own centre."""
    return (
        df.join(settled(centers_df.select(cluster, "center")), cluster)
        .withColumn("distance", distance(F.col(features), F.col("center")))
        .drop("center")
    )


def distance_outliers(distances: DataFrame, key: str, cluster: str = "cluster", q: float = 0.95) -> DataFrame:
    """Points farther from their centre than the cluster's exact percentile."""
    limits = settled(exact_percentile_by(distances, cluster, "distance", key, q))
    return distances.join(limits, cluster).where(F.col("distance") > F.col("threshold"))


def small_clusters(df: DataFrame, cluster: str = "cluster", share: float = 0.05, fewest: int = 2) -> DataFrame:
    """Clusters (noise aside) with fewer members than the share of all rows."""
    sizes = cluster_sizes(df, cluster)
    limit = F.greatest(F.lit(fewest), F.floor(F.lit(share) * sizes.agg(F.sum("n")).scalar()))
    return sizes.where((F.col(cluster) != -1) & (F.col("n") < limit))


def cluster_anomalies(
    df: DataFrame, centers_df: DataFrame, key: str, cluster: str = "cluster", share: float = 0.05, q: float = 0.95
) -> DataFrame:
    """Noise points, members of small clusters and far points, each once with its reasons."""
    noise = df.where(F.col(cluster) == -1).select(key, F.lit("noise").alias("reason"))
    small = df.join(small_clusters(df, cluster, share).select(cluster), cluster, "left_semi").select(
        key, F.lit("small_cluster").alias("reason")
    )
    far = distance_outliers(point_center_distance(df, centers_df, cluster), key, cluster, q).select(
        key, F.lit("far").alias("reason")
    )
    found = noise.unionByName(small).unionByName(far)
    return found.groupBy(key).agg(F.concat_ws("+", F.sort_array(F.collect_set("reason"))).alias("reasons"))


#: centres that are compared as one list, and points whose silhouette is computed unless told otherwise
CENTRE_BLOCK, SILHOUETTE_POINTS = 256, 2000


def centre_similarity(spread: DataFrame, cluster: str = "cluster") -> DataFrame:
    """``cluster, worst``: the largest (s + s') / distance of a cluster's centre to any other.

    ``spread`` has ``center`` and ``s`` per cluster. Every centre meets every block of centres by
    an equi join on the block's number, so no task holds all centres.
    """
    blocks = -(-spread.count() // CENTRE_BLOCK)
    held = spread.groupBy(F.pmod(F.xxhash64(cluster), F.lit(max(1, blocks))).alias("block")).agg(
        F.collect_list(F.struct(F.col(cluster).alias("id"), "s", "center")).alias("others")
    )
    asked = spread.withColumn("block", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(max(1, blocks) - 1).cast("bigint"))))
    similar = F.transform(
        F.filter("others", lambda other: other["id"] != F.col(cluster)),
        lambda other: (F.col("s") + other["s"]) / distance(F.col("center"), other["center"]),
    )
    return asked.join(held, "block").select(cluster, F.array_max(similar).alias("worst")).groupBy(cluster).agg(F.max("worst").alias("worst"))


def cluster_quality(
    df: DataFrame, key: str, cluster: str = "cluster", features: str = "features", points: int = SILHOUETTE_POINTS, risk: float = 0.01
) -> DataFrame:
    """Calinski-Harabasz and Davies-Bouldin from centres and distances, and two silhouettes: with
    squared distances over all points, and with plain distances over ``points`` of them
    (``silhouette``, off by more than ``silhouette_error`` with a probability of at most ``risk``)."""
    middle = centers(df, cluster, features)
    spread = point_center_distance(df, middle, cluster, features).groupBy(cluster).agg(
        F.avg("distance").alias("s"), F.sum(F.col("distance") * F.col("distance")).alias("w")
    )
    overall = centers(df.withColumn("_all", F.lit(0)), "_all", features).select("center").scalar()
    per_cluster = cut_lineage(
        middle.join(spread, cluster)
        .withColumn("overall", overall)
        .withColumn("b", F.col("n") * squared_distance(F.col("center"), F.col("overall")))
    )
    sums = per_cluster.agg(F.sum("b").alias("b"), F.sum("w").alias("w"), F.sum("n").alias("n"), F.count(F.lit(1)).alias("k"))
    worst = centre_similarity(per_cluster.select(cluster, "s", "center"), cluster).agg(F.sum("worst").alias("total"))
    plain, error = silhouette(df, key, cluster, features, points, risk)
    return sums.select(
        F.col("k").alias("n_clusters"),
        ((F.col("b") / (F.col("k") - 1)) / (F.col("w") / (F.col("n") - F.col("k")))).alias("calinski_harabasz"),
        (worst.select("total").scalar() / F.col("k")).alias("davies_bouldin"),
        F.lit(silhouette_squared(df, cluster, features)).alias("silhouette_squared"),
        F.lit(plain).alias("silhouette"),
        F.lit(error).alias("silhouette_error"),
    )


def silhouette(
    df: DataFrame, key: str, cluster: str = "cluster", features: str = "features", points: int = SILHOUETTE_POINTS, risk: float = 0.01
) -> tuple[float, float]:
    """Mean silhouette with plain distances, and its error.

    The first ``points`` rows in the order of a hash of the key (and then the key) are compared with all rows, so
    each of their silhouettes is exact; their mean is that of all rows if there are no more. Else
    it is the mean of a sample of values between -1 and 1, which Hoeffding's bound keeps within
    ``sqrt(2 ln(2 / risk) / points)`` of the mean of all. Tasks send one sum and count per sampled point and cluster.
    """
    spark = df.sparkSession
    chosen = df.orderBy(F.xxhash64(key), key).limit(points).select(cluster, features).collect()
    if not chosen:
        return float("nan"), 0.0
    sample = spark.sparkContext.broadcast(np.array([r[1] for r in chosen], float))
    own = [r[0] for r in chosen]

    def summed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, totals = sample.value, {}
        for batch in batches:
            for name, part in batch.groupby("c", dropna=False):
                x = np.array(part["x"].tolist(), float)
                for start in range(0, len(x), 2048):
                    some = x[start : start + 2048]
                    squares = (at * at).sum(1)[:, None] + (some * some).sum(1) - 2 * at @ some.T
                    # a point's distance to itself is exactly 0
                    squares[(squares < 1e-6) & (squares != 0)] = _small_squares(at, some, squares)
                    total = totals.setdefault(name, [np.zeros(len(at)), 0])
                    total[0] += np.sqrt(np.maximum(squares, 0)).sum(1)
                    total[1] += len(some)
        for name, (total, n) in totals.items():
            yield pd.DataFrame({"c": name, "i": np.arange(len(at)), "total": total, "n": n})

    kind = df.schema[cluster].dataType.simpleString()
    sums = df.select(F.col(cluster).alias("c"), F.col(features).alias("x")).mapInPandas(summed, f"c {kind}, i BIGINT, total DOUBLE, n BIGINT")
    mine = spark.createDataFrame(list(enumerate(own)), f"i BIGINT, own {kind}")
    means = sums.groupBy("i", "c").agg(F.sum("total").alias("total"), F.sum("n").alias("n")).join(F.broadcast(mine), "i")
    same = F.col("c").eqNullSafe(F.col("own"))
    inside = F.max(F.when(same & (F.col("n") > 1), F.col("total") / (F.col("n") - 1)))
    outside = F.min(F.when(~same, F.col("total") / F.col("n")))
    per_point = means.groupBy("i").agg(inside.alias("a"), outside.alias("b"))
    value = F.when(F.col("a").isNull() | F.col("b").isNull(), 0.0).when(F.greatest("a", "b") == 0, 0.0).otherwise((F.col("b") - F.col("a")) / F.greatest("a", "b"))
    mean = per_point.agg(F.avg(value)).first()[0]
    rows = len(chosen) if len(chosen) < points else df.count()
    return mean, 0.0 if rows <= len(chosen) else math.sqrt(2 * math.log(2 / risk) / len(chosen))


def _small_squares(a: np.ndarray, b: np.ndarray, squares: np.ndarray) -> np.ndarray:
    """Small squared distances again, from the differences: the fast form cancels there."""
    i, j = np.nonzero((squares < 1e-6) & (squares != 0))
    return ((a[i] - b[j]) ** 2).sum(1)


def silhouette_squared(df: DataFrame, cluster: str = "cluster", features: str = "features") -> float:
    ready = df.select(F.col(cluster).cast("double").alias("prediction"), array_to_vector(F.col(features)).alias("features"))
    return ClusteringEvaluator(metricName="silhouette", distanceMeasure="squaredEuclidean").evaluate(ready)


# --- density clustering -------------------------------------------------------------------
#
# Points fall into cells of diameter eps, so points of one cell are neighbours without any
# comparison; only pairs of nearby non-empty cells are looked at. Cells that may touch are
# found by an equi join on a coarse grid over projections on orthonormal directions (a
# projection never lengthens a distance). Equal points are one weighted point.


def _directions(dimension: int, count: int) -> np.ndarray:
    if dimension <= count:
        return np.eye(dimension)
    q, _ = np.linalg.qr(np.random.default_rng(7).normal(size=(dimension, count)))
    return q.T


def _coords(features: Column, side: float) -> Column:
    return F.transform(features, lambda x: F.floor(x / F.lit(side)))


def _box_gap(a: Column, b: Column) -> Column:
    """Squared distance between two grid boxes in units of their side."""
    gap = F.zip_with(a, b, lambda x, y: F.greatest(F.abs(x - y) - 1, F.lit(0)))
    return F.aggregate(gap, F.lit(0).cast("bigint"), lambda s, v: s + v * v)


def _box_span(a: Column, b: Column) -> Column:
    """Squared largest distance inside two grid boxes in units of their side."""
    span = F.zip_with(a, b, lambda x, y: F.abs(x - y) + 1)
    return F.aggregate(span, F.lit(0).cast("bigint"), lambda s, v: s + v * v)


def _slot(position: Column, directions: np.ndarray, width: float) -> Column:
    """Grid slot of a position on each direction."""

    def along(direction: np.ndarray) -> Column:
        weights = F.array(*[F.lit(float(w)) for w in direction])
        return F.aggregate(F.zip_with(position, weights, lambda x, w: x * w), F.lit(0.0), lambda s, v: s + v)

    return F.array(*[F.floor(along(d) / width).cast("bigint") for d in directions])


def _around(slot: Column, axes: int) -> Column:
    """The slots next to one, itself included: a fixed number (27 on three axes)."""
    steps = F.array(*[F.array(*[F.lit(s) for s in step]) for step in product((-1, 0, 1), repeat=axes)])
    return F.transform(steps, lambda step: F.zip_with(slot, step, lambda s, d: s + d))


def _near_cells(cells: DataFrame, eps: float, side: float, dimension: int, axes: int = 3) -> DataFrame:
    """Pairs (a, b) of cells whose points can be within eps (some pairs too many, none missing)."""
    directions = _directions(dimension, axes)
    centre = F.transform("coords", lambda c: (c + 0.5) * F.lit(side))
    # centres of touching cells are at most eps + two half diameters apart
    gridded = cells.select("cell", "coords", _slot(centre, directions, 2 * eps).alias("slot"))
    reach = gridded.select(
        F.col("cell").alias("a"), F.col("coords").alias("a_coords"), F.explode(_around(F.col("slot"), len(directions))).alias("slot")
    )
    pairs = reach.join(gridded.select(F.col("cell").alias("b"), F.col("coords").alias("b_coords"), "slot"), "slot").drop("slot")
    if dimension <= BOX_TEST:
        pairs = pairs.where(_box_gap(F.col("a_coords"), F.col("b_coords")) <= (eps / side) ** 2 * (1 + 1e-9))
    return pairs


#: widest vectors for which the gap between two boxes says more than the projections do
BOX_TEST = 8


def connected_components(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """``node, component`` (smallest node id) by alternating large-star and small-star steps.

    Each step replaces the neighbours of a node by its minimum, an aggregate that combines
    map-side, so a hub costs no more than its edges. The edge list is checkpointed per round;
    the smallest node of a component spreads with every step, so the rounds end.
    """
    links = cut_lineage(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    mark = None
    while True:
        both = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = (
            large.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
            .unionByName(low.select("u", F.col("m").alias("v")))
            .distinct()
        )
        links = cut_lineage(small)
        state = links.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v"))).first()
        if state == mark:
            roots = links.groupBy("u").agg(F.min("v").alias("component")).withColumnRenamed("u", "node")
            return nodes.join(roots, "node", "left").withColumn("component", F.coalesce("component", "node"))
        mark = state


def _grid(df: DataFrame, key: str, features: str, eps: float, min_samples: int):
    """Distinct weighted points with their cell; ``dense`` cells have enough points by themselves."""
    dimension = df.select(F.size(features)).first()[0]
    side = eps / math.sqrt(dimension) * (1 - 1e-9)
    distinct = df.groupBy(F.col(features).alias("x")).agg(
        F.min(key).alias("pid"), F.count(F.lit(1)).alias("weight")
    ).withColumn("coords", _coords(F.col("x"), side))
    cells = distinct.groupBy("coords").agg(F.min("pid").alias("cell"), (F.sum("weight") >= min_samples).alias("dense"))
    points = cut_lineage(distinct.join(cells, "coords").select("pid", "x", "weight", "coords", "cell", "dense"))
    return dimension, side, points


#: points per block, two of which are compared as one small matrix, and blocks per side of a task's group
BLOCK, GROUP = 1024, 16


def compared_pairs(points: DataFrame, eps: float, dimension: int, axes: int = 3) -> int:
    """Point pairs that ``_neighbours`` compares, from the sizes of the slots alone."""
    directions = _directions(dimension, axes)
    sizes = points.groupBy(_slot(F.col("x"), directions, eps).alias("slot")).agg(
        F.count_if(~F.col("dense")).alias("lefts"), F.count(F.lit(1)).alias("rights")
    )
    reach = sizes.where("lefts > 0").select("lefts", F.explode(_around(F.col("slot"), len(directions))).alias("slot"))
    pairs = reach.join(sizes.select("slot", "rights"), "slot").agg(F.sum(F.col("lefts").cast("decimal(38,0)") * F.col("rights")))
    return int(pairs.first()[0] or 0)


def _neighbours(points: DataFrame, eps: float, dimension: int, most_pairs: int | None = None, axes: int = 3) -> DataFrame:
    """(p, q) within eps for every point p of a cell that is not dense.

    Exact pruning can fail: where eps is large next to the spread of the data, as between unit
    vectors of many dimensions, every point may be near every other. With ``most_pairs`` the
    comparisons are counted first, and a call with more is refused.

    A sparse cell has fewer than ``min_samples`` points, and two crowded cells are never
    compared here. Points meet by an equi join on pairs of projection slots, block by block: a
    slot of any size is cut into blocks of about ``BLOCK`` points, and the blocks of a pair of
    slots are dealt to tasks as a grid of ``GROUP`` by ``GROUP`` blocks. So no task gets more than
    one square of the grid, whatever a slot holds, a block travels once per row or column of
    squares, and only the pairs found within eps leave the task.
    """
    if most_pairs is not None and (work := compared_pairs(points, eps, dimension, axes)) > most_pairs:
        raise ValueError(f"{work} pairs of points would be compared; allow it by most_pairs, or choose a smaller eps")
    directions = _directions(dimension, axes)
    slotted = points.withColumn("slot", _slot(F.col("x"), directions, eps))
    sizes = cut_lineage(
        slotted.groupBy("slot").agg(F.ceil(F.count_if(~F.col("dense")) / BLOCK).alias("lefts"), F.ceil(F.count(F.lit(1)) / BLOCK).alias("rights"))
    )
    near = sizes.where("lefts > 0").select(F.col("slot").alias("l_slot"), "lefts", F.explode(_around(F.col("slot"), len(directions))).alias("r_slot"))
    near = cut_lineage(near.join(sizes.select(F.col("slot").alias("r_slot"), "rights"), "r_slot"))
    cut = slotted.join(sizes, "slot").withColumn("_h", F.xxhash64("pid"))
    groups = lambda blocks: F.sequence(F.lit(0).cast("bigint"), F.floor((blocks - 1) / GROUP))
    left = (
        cut.where("NOT dense")
        .groupBy(F.col("slot").alias("l_slot"), F.pmod("_h", F.col("lefts")).alias("block"))
        .agg(F.collect_list(F.struct("pid", "cell", "x")).alias("l"))
        .withColumn("l_group", F.floor(F.col("block") / GROUP)).drop("block")
        .join(near.select("l_slot", "r_slot", groups(F.col("rights")).alias("r_group")), "l_slot")
        .withColumn("r_group", F.explode("r_group"))
    )
    right = (
        cut.groupBy(F.col("slot").alias("r_slot"), F.pmod("_h", F.col("rights")).alias("block"))
        .agg(F.collect_list(F.struct("pid", "cell", "weight", "x")).alias("r"))
        .withColumn("r_group", F.floor(F.col("block") / GROUP)).drop("block")
        .join(near.select("l_slot", "r_slot", groups(F.col("lefts")).alias("l_group")), "r_slot")
        .withColumn("l_group", F.explode("l_group"))
    )
    blocks = left.join(right, ["l_slot", "r_slot", "l_group", "r_group"]).select(
        F.col("l.pid").alias("p"), F.col("l.cell").alias("p_cell"), F.flatten("l.x").alias("px"),
        F.col("r.pid").alias("q"), F.col("r.cell").alias("q_cell"), F.col("r.weight").alias("weight"), F.flatten("r.x").alias("qx"),
    )

    def within(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for row in batch.itertuples(index=False):
                a, b = np.reshape(row.px, (-1, dimension)), np.reshape(row.qx, (-1, dimension))
                i, j = maybe_within(a, b, eps)
                exact = ((a[i] - b[j]) ** 2).sum(1) <= eps * eps
                i, j = i[exact], j[exact]
                yield pd.DataFrame(
                    {"p": row.p[i], "p_cell": row.p_cell[i], "q": row.q[j], "q_cell": row.q_cell[j], "weight": row.weight[j]}
                )

    return cut_lineage(
        blocks.mapInPandas(within, "p BIGINT, p_cell BIGINT, q BIGINT, q_cell BIGINT, weight BIGINT")
    )


def maybe_within(a: np.ndarray, b: np.ndarray, eps: float) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of rows that single precision does not show to be farther apart than ``eps``: all
    pairs within it, and few more. One product gives minus half the squared distances."""
    aa, bb = (a * a).sum(1), (b * b).sum(1)
    top = float(aa.max() + bb.max())
    kind = np.float32 if top < 1e30 else np.float64
    left = np.c_[a, -aa / 2, np.ones(len(a))].astype(kind)
    right = np.c_[b, np.ones(len(b)), -bb / 2].astype(kind)
    # rounding of the values, their products and sums; not a number is for the exact test
    off = (a.shape[1] + 10) * 2.0**-22 * top + 1e-30
    return np.nonzero(~(left @ right.T < kind(-eps * eps / 2 * (1 + 1e-6) - off)))


def _core_points(points: DataFrame, neighbours: DataFrame, min_samples: int) -> DataFrame:
    """Distinct points with their core flag: all of a dense cell, and the others by their count."""
    counted = neighbours.groupBy(F.col("p").alias("pid")).agg((F.sum("weight") >= min_samples).alias("core"))
    return points.where("dense").withColumn("core", F.lit(True)).unionByName(
        points.where("NOT dense").join(counted, "pid").select(*points.columns, "core")
    )


# Below this many comparisons two cells are compared point by point.
DIRECT_PAIRS = 10_000


def _dense_links(core: DataFrame, eps: float, side: float, dimension: int, levels: int = 3) -> DataFrame:
    """Pairs of dense cells that hold two points within eps.

    Large pairs are refined by halving the boxes: boxes too far apart are dropped, boxes
    entirely within eps settle their pair, and only what stays undecided reaches the
    point-by-point test. So two crowded neighbours do not produce all their pairs.
    """
    sizes = core.groupBy("cell", "coords").agg(F.count(F.lit(1)).alias("m"))
    cells = sizes.select("cell", "coords")
    pairs = (
        _near_cells(cells, eps, side, dimension).where("a < b")
        .join(sizes.select(F.col("cell").alias("a"), F.col("m").alias("ma")), "a")
        .join(sizes.select(F.col("cell").alias("b"), F.col("m").alias("mb")), "b")
    )
    limit = eps * eps * (1 + 1e-9)

    def touching(pair_keys: DataFrame, on_a: list[str], on_b: list[str], left: DataFrame, right: DataFrame) -> DataFrame:
        return (
            pair_keys.join(left, on_a).join(right, on_b)
            .where(squared_distance(F.col("ax"), F.col("bx")) <= eps * eps)
            .select("a", "b").distinct()
        )

    left = core.select(F.col("cell").alias("a"), F.col("x").alias("ax"))
    right = core.select(F.col("cell").alias("b"), F.col("x").alias("bx"))
    links = touching(pairs.where(F.col("ma") * F.col("mb") <= DIRECT_PAIRS).select("a", "b"), ["a"], ["b"], left, right)
    open_pairs = pairs.where(F.col("ma") * F.col("mb") > DIRECT_PAIRS).select(
        "a", "b", F.col("a_coords").alias("sa"), F.col("b_coords").alias("sb")
    )
    if open_pairs.isEmpty():
        return links
    for level in range(1, levels + 1):
        fine = side / 2**level
        boxes = core.select(
            "cell", _coords(F.col("x"), side / 2 ** (level - 1)).alias("parent"), _coords(F.col("x"), fine).alias("box")
        ).distinct()
        a_boxes = boxes.select(F.col("cell").alias("a"), F.col("parent").alias("sa"), F.col("box").alias("ba"))
        b_boxes = boxes.select(F.col("cell").alias("b"), F.col("parent").alias("sb"), F.col("box").alias("bb"))
        split = cut_lineage(
            open_pairs.join(a_boxes, ["a", "sa"]).join(b_boxes, ["b", "sb"])
            .where(_box_gap(F.col("ba"), F.col("bb")) * (fine * fine) <= limit)
            .select("a", "b", F.col("ba").alias("sa"), F.col("bb").alias("sb"))
        )
        settled = split.where(_box_span(F.col("sa"), F.col("sb")) * (fine * fine) <= eps * eps * (1 - 1e-9)).select("a", "b").distinct()
        links = links.unionByName(settled)
        open_pairs = split.join(settled, ["a", "b"], "left_anti")
    fine = side / 2**levels
    left = core.select(F.col("cell").alias("a"), _coords(F.col("x"), fine).alias("sa"), F.col("x").alias("ax"))
    right = core.select(F.col("cell").alias("b"), _coords(F.col("x"), fine).alias("sb"), F.col("x").alias("bx"))
    return links.unionByName(touching(open_pairs, ["a", "sa"], ["b", "sb"], left, right)).distinct()


def core_points(df: DataFrame, key: str, eps: float, min_samples: int, features: str = "features", most_pairs: int | None = None) -> DataFrame:
    """Every row with its core flag (at least ``min_samples`` rows within eps, itself included)."""
    dimension, side, points = _grid(df, key, features, eps, min_samples)
    flags = _core_points(points, _neighbours(points, eps, dimension, most_pairs), min_samples)
    return df.join(flags.select(F.col("x").alias(features), "core"), features).select(*df.columns, "core")


def fit_dbscan(df: DataFrame, key: str, eps: float = 0.5, min_samples: int = 5, features: str = "features", most_pairs: int | None = None) -> DataFrame:
    """Exact density clusters: adds ``cluster`` (numbered by smallest core key, -1 = noise) and ``core``.

    A border point that several clusters reach joins the one with the smallest number.
    """
    dimension, side, points = _grid(df, key, features, eps, min_samples)
    neighbours = _neighbours(points, eps, dimension, most_pairs)
    flagged = cut_lineage(_core_points(points, neighbours, min_samples))
    core = flagged.where("core")
    is_core = core.select("pid", "cell")
    # links of cells: through a core point of a sparse cell, or between two dense cells
    mixed = (
        neighbours.join(is_core.select(F.col("pid").alias("p")), "p", "left_semi")
        .join(is_core.select(F.col("pid").alias("q")), "q", "left_semi")
        .select(F.col("p_cell").alias("a"), F.col("q_cell").alias("b"))
    )
    links = mixed.unionByName(_dense_links(core.where("dense"), eps, side, dimension))
    parts = connected_components(links, is_core.select(F.col("cell").alias("node")).distinct())
    members = core.join(parts.withColumnRenamed("node", "cell"), "cell").select("pid", "component")
    firsts = members.groupBy("component").agg(F.min("pid").alias("first"))
    numbered = running_totals(firsts, [F.col("first")], {"_n": F.lit(1)}).select("component", (F.col("_n") - 1).alias("cluster"))
    members = members.join(numbered, "component").select("pid", "cluster")
    border = (
        neighbours.join(is_core.select(F.col("pid").alias("p")), "p", "left_anti")
        .join(members.select(F.col("pid").alias("q"), "cluster"), "q")
        .groupBy(F.col("p").alias("pid"))
        .agg(F.min("cluster").alias("cluster"))
    )
    by_point = flagged.join(members.unionByName(border), "pid", "left").select(
        F.col("x").alias(features), F.coalesce("cluster", F.lit(-1)).cast("bigint").alias("cluster"), "core"
    )
    return df.join(by_point, features).select(*df.columns, "cluster", "core")
