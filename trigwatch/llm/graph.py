"""Connected components of links between documents."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trigwatch.llm.common import Scratch


def components(links: DataFrame, work: Scratch) -> DataFrame:
    """``node, comp`` for every end of a link ``a, b``: comp is the smallest node reachable.

    Alternates two star steps until nothing changes: every larger neighbour of a node moves to
    the node's smallest neighbour, then every smaller one. Both reduce neighbours to a minimum
    before the shuffle, and a hub's links are joined row by row, so no list of neighbours is
    ever held; rounds grow with the logarithm of the longest path.
    """
    ends = F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")
    edges = work.stored(links.where("a <> b").select(*ends).distinct(), "edges")
    state = None
    while True:
        both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").where("v <> m").select(F.greatest("v", "m").alias("u"), F.least("v", "m").alias("v"))
        edges = work.stored(small.unionByName(least.select("u", F.col("m").alias("v"))).distinct(), "edges")
        now = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == state:
            break
        state = now
    stars = edges.select(F.col("u").alias("node"), F.col("v").alias("comp"))
    return work.stored(stars.unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("comp")).distinct()), "components")
