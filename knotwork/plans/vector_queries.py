"""Queries on vectors: scaling, neighbours, centroids, silhouette."""

from __future__ import annotations

from pyspark.sql import functions as F

from knotwork.functions.scalars import rounded
from knotwork.operators import descent, neighbors, vectors as ops
from knotwork.plans.bindings import vectors, with_tables
from knotwork.plans.registry import query
from knotwork.session import cut

VECTORS = with_tables("vectors")
K = 15


def clustered(spark, sf):
    """Vectors with their label as cluster; the last label stands for noise."""
    return vectors(spark, sf).withColumn("cluster", F.when(F.col("label") == 9, -1).otherwise(F.col("label")))


CLUSTERED = f"{VECTORS}, pts AS (SELECT key, vec, CASE WHEN label = 9 THEN -1 ELSE label END AS cluster FROM vectors)"
LONG = "SELECT key, cluster, unnest(vec) AS v, generate_subscripts(vec, 1) AS i FROM pts"
CENTERS = f"""{CLUSTERED}, long AS ({LONG}), means AS (SELECT cluster, i, avg(v) AS m FROM long WHERE cluster <> -1 GROUP BY ALL),
 centers AS (SELECT cluster, list(m ORDER BY i) AS centroid FROM means GROUP BY cluster)"""
NEIGHBORS = f"""{VECTORS}, pairs AS (SELECT a.key AS src, b.key AS dst, list_distance(a.vec, b.vec) AS distance FROM vectors a JOIN vectors b ON a.key <> b.key),
 knn AS (SELECT *, row_number() OVER (PARTITION BY src ORDER BY distance, dst) AS place FROM pairs QUALIFY place <= {K})"""


@query(
    "standardize",
    f"""{CLUSTERED}, long AS ({LONG}), s AS (SELECT i, avg(v) AS m, stddev_pop(v) AS d FROM long GROUP BY i)
 SELECT key, CAST(i - 1 AS INTEGER) AS position, round(CASE WHEN d > 0 THEN (v - m) / d ELSE 0 END, 6) AS value FROM long JOIN s USING (i)""",
)
def _(spark, sf):
    scaled = ops.standardize(vectors(spark, sf))
    return scaled.select("key", F.posexplode("vec").alias("position", "value")).withColumn("value", rounded(F.col("value")))


@query("centroids", f"{CENTERS} SELECT cluster, CAST(i - 1 AS INTEGER) AS position, round(m, 6) AS value FROM means")
def _(spark, sf):
    centers = ops.centroids(clustered(spark, sf))
    long = centers.select("cluster", F.posexplode("centroid").alias("position", "value"))
    return long.withColumn("value", rounded(F.col("value")))


@query("pairwise_distance", f"{CENTERS} SELECT key, c.cluster, round(list_distance(vec, centroid), 6) AS distance FROM pts, centers c")
def _(spark, sf):
    points = clustered(spark, sf)
    pairs = ops.pairwise_distance(points, ops.centroids(points))
    return pairs.withColumn("distance", rounded(F.col("distance")))


@query(
    "nearest_centroid",
    f"{CENTERS} SELECT key, arg_min(c.cluster, list_distance(vec, centroid)) AS nearest, round(min(list_distance(vec, centroid)), 6) AS distance FROM pts, centers c GROUP BY key",
)
def _(spark, sf):
    points = clustered(spark, sf)
    placed = ops.nearest_centroid(points, ops.centroids(points))
    return placed.select("key", "nearest", rounded(F.col("nearest_distance")).alias("distance"))


@query(
    "centroid_distances",
    f"""{CLUSTERED}, train AS (SELECT * FROM pts WHERE cluster < 6), long AS (SELECT cluster, unnest(vec) AS v, generate_subscripts(vec, 1) AS i FROM train),
 means AS (SELECT cluster, i, avg(v) AS m FROM long WHERE cluster <> -1 GROUP BY ALL), centers AS (SELECT cluster, list(m ORDER BY i) AS c FROM means GROUP BY cluster),
 g AS (SELECT list(m ORDER BY i) AS c FROM (SELECT i, avg(v) AS m FROM long GROUP BY i)),
 near AS (SELECT key, min(list_distance(vec, c)) AS d FROM pts, centers GROUP BY key)
 SELECT p.key, round(coalesce(list_distance(vec, o.c), near.d), 6) AS dist_assigned, round(near.d, 6) AS dist_nearest, round(list_distance(vec, g.c), 6) AS dist_global
 FROM pts p JOIN near USING (key) CROSS JOIN g LEFT JOIN centers o ON o.cluster = p.cluster""",
)
def _(spark, sf):
    rows = ops.centroid_distances(clustered(spark, sf), F.col("cluster") < 6)
    return rows.select("key", *[rounded(F.col(c)).alias(c) for c in ("dist_assigned", "dist_nearest", "dist_global")])


def _neighbors(spark, sf, **options):
    return neighbors.knn(vectors(spark, sf), K, **options)


@query("knn_topk", f"{NEIGHBORS} SELECT src, dst, round(distance, 6) AS distance, place FROM knn")
def _(spark, sf):
    rows = _neighbors(spark, sf)
    return rows.select("src", "dst", rounded(F.col("distance")).alias("distance"), F.col("place").cast("long").alias("place"))


@query(
    "knn_graph",
    f"{NEIGHBORS} SELECT DISTINCT least(src, dst) AS src, greatest(src, dst) AS dst, round(1 / (1 + distance), 6) AS weight FROM knn",
)
def _(spark, sf):
    # Many small cells: the search by bounds is what is checked here.
    edges = neighbors.knn_graph(vectors(spark, sf), K, weighted=True, block_rows=100)
    return edges.withColumn("weight", rounded(F.col("weight")))


@query("knn_approx")
def _(spark, sf):
    points = vectors(spark, sf)
    rows = cut(descent.knn_approx(points, K))
    share = descent.recall(points, rows, K).select(rounded(F.col("recall")).alias("recall"))
    # The share is one row.
    return rows.select("src", "dst", rounded(F.col("distance")).alias("distance")).join(F.broadcast(share))


@query("simplify_edges", f"{NEIGHBORS} SELECT least(src, dst) AS src, greatest(src, dst) AS dst, round(min(distance), 6) AS weight FROM knn GROUP BY ALL")
def _(spark, sf):
    edges = _neighbors(spark, sf).select("src", "dst", F.col("distance").alias("weight"))
    return neighbors.simplify_edges(edges).withColumn("weight", rounded(F.col("weight")))


@query("core_distance", f"{NEIGHBORS} SELECT src AS key, round(distance, 6) AS core FROM knn WHERE place = 10")
def _(spark, sf):
    return neighbors.core_distance(_neighbors(spark, sf), 10).withColumn("core", rounded(F.col("core")))


@query(
    "mutual_reachability",
    f"""{NEIGHBORS}, core AS (SELECT src AS key, distance AS core FROM knn WHERE place = 10)
 SELECT least(src, dst) AS src, greatest(src, dst) AS dst, round(min(greatest(a.core, b.core, distance)), 6) AS weight FROM knn JOIN core a ON a.key = src JOIN core b ON b.key = dst GROUP BY ALL""",
)
def _(spark, sf):
    near = cut(_neighbors(spark, sf))
    edges = neighbors.mutual_reachability(near, neighbors.core_distance(near, 10))
    return edges.withColumn("weight", rounded(F.col("weight")))


@query("fuzzy_knn_weights")
def _(spark, sf):
    edges = neighbors.fuzzy_knn_weights(cut(_neighbors(spark, sf)), K)
    return edges.withColumn("weight", rounded(F.col("weight")))


@query(
    "silhouette",
    f"""{CLUSTERED}, m AS (SELECT * FROM pts WHERE cluster <> -1),
 t AS (SELECT a.key, a.cluster AS own, b.cluster, sum(list_distance(a.vec, b.vec)) AS total, count(*) AS n FROM m a, m b GROUP BY ALL),
 s AS (SELECT key, max(CASE WHEN own = cluster THEN n END) AS size, max(CASE WHEN own = cluster AND n > 1 THEN total / (n - 1) END) AS a, min(CASE WHEN own <> cluster THEN total / n END) AS b FROM t GROUP BY key)
 SELECT round(avg(CASE WHEN size <= 1 THEN 0 ELSE (b - a) / greatest(a, b) END), 6) AS silhouette FROM s""",
)
def _(spark, sf):
    return ops.silhouette(clustered(spark, sf)).withColumn("silhouette", rounded(F.col("silhouette")))


@query("pca")
def _(spark, sf):
    flat, shares = ops.pca(vectors(spark, sf).select("key", "vec"), 8)
    explained = F.lit(round(sum(shares), 6))
    return flat.select("key", F.posexplode("vec").alias("position", "value"), explained.alias("explained"))


@query("project_2d")
def _(spark, sf):
    return ops.project_2d(vectors(spark, sf))


@query(
    "cluster_density_grid",
    f"""{CLUSTERED}, xy AS (SELECT vec[1] AS x, vec[2] AS y, cluster FROM pts), r AS (SELECT min(x) AS x0, max(x) AS x1, min(y) AS y0, max(y) AS y1 FROM xy)
 SELECT CAST(least(floor((x - x0) / ((x1 - x0) / 20)), 19) AS INTEGER) AS bin_x, CAST(least(floor((y - y0) / ((y1 - y0) / 20)), 19) AS INTEGER) AS bin_y, cluster, count(*) AS n FROM xy, r GROUP BY ALL""",
)
def _(spark, sf):
    rows = clustered(spark, sf).select(F.col("vec")[0].alias("x"), F.col("vec")[1].alias("y"), "cluster")
    return ops.cluster_density_grid(rows)
