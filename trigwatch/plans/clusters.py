"""Cluster figures, outliers and density clustering over the embeddings."""

from __future__ import annotations

from pyspark.sql import functions as F

from trigwatch.operators import anomaly
from trigwatch.plans.registry import query
from trigwatch.plans.tables import embeddings, rounded, with_ctes

# Clusters with some noise: every ninth vector is in none.
NOISY = "nz AS (SELECT vec_id, CASE WHEN vec_id % 9 = 0 THEN -1 ELSE CAST(label AS BIGINT) END AS cluster, CAST(embedding AS DOUBLE[]) AS e FROM embeddings)"


def noisy(spark, sf):
    return embeddings(spark, sf).withColumn("cluster", F.when(F.col("vec_id") % 9 == 0, -1).otherwise(F.col("cluster")))


@query("cluster_sizes", f"WITH {NOISY} SELECT cluster, count(*) AS n FROM nz GROUP BY 1")
def cluster_sizes(spark, sf):
    return anomaly.cluster_sizes(noisy(spark, sf))


@query(
    "cluster_summary",
    f"""WITH {NOISY} SELECT count(DISTINCT cluster) FILTER (cluster >= 0) AS n_clusters, count(*) FILTER (cluster = -1) AS noise_points,
  round(count(*) FILTER (cluster = -1) / count(*), 6) AS noise_ratio FROM nz""",
)
def cluster_summary(spark, sf):
    return rounded(anomaly.cluster_summary(noisy(spark, sf)), "noise_ratio")


DIST = """ctr AS (SELECT cluster, pos, avg(x) AS m FROM emb GROUP BY 1, 2),
dist AS (SELECT vec_id, emb.cluster, sqrt(sum((x - m) * (x - m))) AS d FROM emb JOIN ctr ON emb.cluster = ctr.cluster AND emb.pos = ctr.pos GROUP BY 1, 2)"""


@query("point_center_distance", with_ctes("emb", f"WITH {DIST} SELECT vec_id, cluster, round(d, 6) AS distance FROM dist"))
def point_center_distance(spark, sf):
    e = embeddings(spark, sf)
    return rounded(anomaly.point_center_distance(e, anomaly.centers(e)).select("vec_id", "cluster", "distance"), "distance")


@query(
    "distance_outliers",
    with_ctes("emb", f"""
WITH {DIST}, lim AS (SELECT cluster, quantile_cont(d, 0.95) AS threshold FROM dist GROUP BY 1)
SELECT vec_id, cluster, round(d, 6) AS distance, round(threshold, 6) AS threshold FROM dist JOIN lim USING (cluster) WHERE d > threshold"""),
)
def distance_outliers(spark, sf):
    e = embeddings(spark, sf)
    found = anomaly.distance_outliers(anomaly.point_center_distance(e, anomaly.centers(e)), "vec_id")
    return rounded(found.select("vec_id", "cluster", "distance", "threshold"), "distance", "threshold")


@query(
    "small_clusters",
    f"""WITH {NOISY}, s AS (SELECT cluster, count(*) AS n FROM nz GROUP BY 1)
SELECT cluster, n FROM s WHERE cluster <> -1 AND n < greatest(2, floor(0.09 * (SELECT sum(n) FROM s)))""",
)
def small_clusters(spark, sf):
    return anomaly.small_clusters(noisy(spark, sf), share=0.09)


@query(
    "cluster_anomalies",
    f"""WITH {NOISY}, s AS (SELECT cluster, count(*) AS n FROM nz GROUP BY 1),
small AS (SELECT cluster FROM s WHERE cluster <> -1 AND n < greatest(2, floor(0.09 * (SELECT sum(n) FROM s)))),
l AS (SELECT vec_id, cluster, unnest(e) AS x, generate_subscripts(e, 1) AS pos FROM nz WHERE cluster >= 0),
ctr AS (SELECT cluster, pos, avg(x) AS m FROM l GROUP BY 1, 2),
dist AS (SELECT vec_id, l.cluster, sqrt(sum((x - m) * (x - m))) AS d FROM l JOIN ctr ON l.cluster = ctr.cluster AND l.pos = ctr.pos GROUP BY 1, 2),
lim AS (SELECT cluster, quantile_cont(d, 0.95) AS threshold FROM dist GROUP BY 1),
r AS (SELECT vec_id, 'noise' AS reason FROM nz WHERE cluster = -1 UNION ALL SELECT vec_id, 'small_cluster' FROM nz JOIN small USING (cluster)
  UNION ALL SELECT vec_id, 'far' FROM dist JOIN lim USING (cluster) WHERE d > threshold)
SELECT vec_id, string_agg(reason, '+' ORDER BY reason) AS reasons FROM r GROUP BY 1""",
)
def cluster_anomalies(spark, sf):
    points = noisy(spark, sf)
    return anomaly.cluster_anomalies(points, anomaly.centers(points.where("cluster >= 0")), "vec_id", share=0.09)


@query(
    "cluster_quality",
    with_ctes("emb", f"""
WITH {DIST}, n AS (SELECT cluster, count(*) AS n, avg(d) AS s, sum(d * d) AS w FROM dist GROUP BY 1),
tot AS (SELECT pos, avg(x) AS m FROM emb GROUP BY 1),
b AS (SELECT c.cluster, sum((c.m - tot.m) * (c.m - tot.m)) AS bb FROM ctr c JOIN tot USING (pos) GROUP BY 1),
cd AS (SELECT a.cluster AS i, z.cluster AS j, sqrt(sum((a.m - z.m) * (a.m - z.m))) AS d FROM ctr a JOIN ctr z ON a.pos = z.pos AND a.cluster <> z.cluster GROUP BY 1, 2),
db AS (SELECT i, max((ni.s + nj.s) / cd.d) AS worst FROM cd JOIN n ni ON ni.cluster = i JOIN n nj ON nj.cluster = j GROUP BY 1),
p AS (SELECT vec_id, CAST(label AS BIGINT) AS cluster, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
pr AS (SELECT a.vec_id, a.cluster AS ci, z.cluster AS cj, sum(power(list_distance(a.e, z.e), 2)) AS sd, count(*) AS m FROM p a, p z GROUP BY 1, 2, 3),
own AS (SELECT vec_id, CASE WHEN m > 1 THEN sd / (m - 1) END AS a FROM pr WHERE ci = cj),
oth AS (SELECT vec_id, min(sd / m) AS b FROM pr WHERE ci <> cj GROUP BY 1),
sil AS (SELECT avg(CASE WHEN a IS NULL THEN 0 ELSE (b - a) / greatest(a, b) END) AS s FROM own JOIN oth USING (vec_id)),
pl AS (SELECT a.vec_id, a.cluster AS ci, z.cluster AS cj, sum(list_distance(a.e, z.e)) AS sd, count(*) AS m FROM p a, p z GROUP BY 1, 2, 3),
pown AS (SELECT vec_id, CASE WHEN m > 1 THEN sd / (m - 1) END AS a FROM pl WHERE ci = cj),
poth AS (SELECT vec_id, min(sd / m) AS b FROM pl WHERE ci <> cj GROUP BY 1),
psil AS (SELECT avg(CASE WHEN a IS NULL THEN 0 ELSE (b - a) / greatest(a, b) END) AS s FROM pown JOIN poth USING (vec_id))
SELECT (SELECT count(*) FROM n) AS n_clusters,
  round(((SELECT sum(n.n * bb) FROM b JOIN n USING (cluster)) / ((SELECT count(*) FROM n) - 1)) / ((SELECT sum(w) FROM n) / ((SELECT sum(n) FROM n) - (SELECT count(*) FROM n))), 6) AS calinski_harabasz,
  round((SELECT avg(worst) FROM db), 6) AS davies_bouldin, round((SELECT s FROM sil), 6) AS silhouette_squared,
  round((SELECT s FROM psil), 6) AS silhouette, 0.0::DOUBLE AS silhouette_error"""),
)
def cluster_quality(spark, sf):
    found = anomaly.cluster_quality(embeddings(spark, sf), "vec_id")
    return rounded(found, "calinski_harabasz", "davies_bouldin", "silhouette_squared", "silhouette")


EPS, MIN_SAMPLES = 1.12, 3

PAIRS = f"""p AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
nb AS (SELECT a.vec_id AS i, z.vec_id AS j FROM p a JOIN p z ON list_distance(a.e, z.e) <= {EPS}),
core AS (SELECT i FROM nb GROUP BY i HAVING count(*) >= {MIN_SAMPLES})"""


@query(
    "eps_neighbors",
    f"WITH {PAIRS} SELECT vec_id, CASE WHEN vec_id IN (SELECT i FROM core) THEN 1 ELSE 0 END AS core FROM p",
)
def eps_neighbors(spark, sf):
    found = anomaly.core_points(embeddings(spark, sf), "vec_id", EPS, MIN_SAMPLES)
    return found.select("vec_id", F.col("core").cast("int").alias("core"))


@query(
    "fit_dbscan",
    f"""WITH RECURSIVE {PAIRS},
link AS (SELECT nb.i, nb.j FROM nb JOIN core a ON a.i = nb.i JOIN core z ON z.i = nb.j),
reach(i, j) AS (SELECT i, j FROM link UNION SELECT reach.i, link.j FROM reach JOIN link ON link.i = reach.j),
comp AS (SELECT i, min(j) AS root FROM reach GROUP BY i),
num AS (SELECT root, row_number() OVER (ORDER BY root) - 1 AS cluster FROM (SELECT DISTINCT root FROM comp)),
lab AS (SELECT i, cluster FROM comp JOIN num USING (root)),
border AS (SELECT nb.i, min(lab.cluster) AS cluster FROM nb JOIN lab ON lab.i = nb.j WHERE nb.i NOT IN (SELECT i FROM core) GROUP BY 1)
SELECT vec_id, coalesce(lab.cluster, border.cluster, -1) AS cluster, CASE WHEN lab.i IS NULL THEN 0 ELSE 1 END AS core
FROM p LEFT JOIN lab ON lab.i = vec_id LEFT JOIN border ON border.i = vec_id""",
)
def fit_dbscan(spark, sf):
    found = anomaly.fit_dbscan(embeddings(spark, sf).drop("cluster"), "vec_id", EPS, MIN_SAMPLES)
    return found.select("vec_id", "cluster", F.col("core").cast("int").alias("core"))
