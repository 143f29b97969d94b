"""Queries on graphs: components, communities, spanning forests and density clusters."""

from __future__ import annotations

from pyspark.sql import functions as F

from knotwork.functions.scalars import rounded
from knotwork.operators import density, graph, neighbors
from knotwork.operators.sampling import stratified_split
from knotwork.operators.spanning import spanning_tree
from knotwork.plans.bindings import vectors
from knotwork.plans.registry import query
from knotwork.plans.vector_queries import K, NEIGHBORS
from knotwork.session import cut


def neighbor_edges(spark, sf):
    """The undirected k-NN graph of the vectors, weight 1."""
    return cut(neighbors.knn_graph(vectors(spark, sf), K))


def reach_edges(spark, sf):
    near = cut(neighbors.knn(vectors(spark, sf), K))
    return cut(neighbors.mutual_reachability(near, neighbors.core_distance(near, 10)))


EDGES = f"{NEIGHBORS}, edges AS (SELECT DISTINCT least(src, dst) AS src, greatest(src, dst) AS dst, 1.0::DOUBLE AS weight FROM knn), around AS (SELECT src, dst FROM edges UNION ALL SELECT dst, src FROM edges)"
REACH = f"""{NEIGHBORS}, core AS (SELECT src AS key, distance AS core FROM knn WHERE place = 10),
 reach AS (SELECT least(src, dst) AS src, greatest(src, dst) AS dst, min(greatest(a.core, b.core, distance)) AS weight FROM knn JOIN core a ON a.key = src JOIN core b ON b.key = dst GROUP BY ALL)"""


def _recursive(sql: str) -> str:
    return sql.replace("WITH ", "WITH RECURSIVE ", 1)


@query(
    "modularity",
    f"""{EDGES}, labels AS (SELECT key, label FROM vectors),
 joined AS (SELECT a.label AS a, b.label AS b, weight FROM edges JOIN labels a ON a.key = src JOIN labels b ON b.key = dst),
 inner_w AS (SELECT a AS c, sum(weight) AS w FROM joined WHERE a = b GROUP BY a),
 deg AS (SELECT c, sum(weight) AS k FROM (SELECT a AS c, weight FROM joined UNION ALL SELECT b, weight FROM joined) GROUP BY c), m AS (SELECT sum(weight) AS m FROM edges)
 SELECT round(sum(coalesce(w, 0) / m.m - (k / (2 * m.m)) * (k / (2 * m.m))), 6) AS modularity FROM deg LEFT JOIN inner_w USING (c), m""",
)
def _(spark, sf):
    labels = vectors(spark, sf).select("key", "label")
    return graph.modularity(neighbor_edges(spark, sf), labels).withColumn("modularity", rounded(F.col("modularity")))


STEP = "{0} AS (SELECT key, label FROM (SELECT a.src AS key, l.label, row_number() OVER (PARTITION BY a.src ORDER BY count(*) DESC, l.label) AS r FROM around a JOIN {1} l ON l.key = a.dst GROUP BY a.src, l.label) WHERE r = 1)"


@query(
    "label_propagation",
    f"{EDGES}, l0 AS (SELECT DISTINCT src AS key, src AS label FROM around), {STEP.format('l1', 'l0')}, {STEP.format('l2', 'l1')}, {STEP.format('l3', 'l2')} SELECT * FROM l3",
)
def _(spark, sf):
    return graph.label_propagation(neighbor_edges(spark, sf), rounds=3)


@query(
    "connected_components",
    _recursive(
        f"""{REACH}, near AS (SELECT src, dst FROM reach WHERE weight <= 1.06), around AS (SELECT src, dst FROM near UNION SELECT dst, src FROM near),
 walk(key, root) AS (SELECT key, key FROM vectors UNION SELECT a.dst, w.root FROM walk w JOIN around a ON a.src = w.key)
 SELECT key, min(root) AS component FROM walk GROUP BY key"""
    ),
)
def _(spark, sf):
    edges = reach_edges(spark, sf).filter(F.col("weight") <= 1.06)
    return graph.connected_components(edges, vectors(spark, sf).select("key"))


@query("communities")
def _(spark, sf):
    edges = neighbor_edges(spark, sf)
    found = cut(graph.communities(edges))
    quality = graph.modularity(edges, found.select("key", F.col("community").alias("label"))).first()[0]
    return found.withColumn("modularity", F.lit(round(quality, 6)))


@query(
    "density_at_epsilon",
    _recursive(
        f"""{REACH}, near AS (SELECT src, dst FROM reach WHERE weight <= 1.06), around AS (SELECT src, dst FROM near UNION SELECT dst, src FROM near),
 walk(key, root) AS (SELECT key, key FROM vectors UNION SELECT a.dst, w.root FROM walk w JOIN around a ON a.src = w.key),
 parts AS (SELECT key, min(root) AS part FROM walk GROUP BY key)
 SELECT key, CASE WHEN count(*) OVER (PARTITION BY part) >= 10 THEN part ELSE -1 END AS cluster FROM parts"""
    ),
)
def _(spark, sf):
    return density.density_at(reach_edges(spark, sf), vectors(spark, sf).select("key"), 1.06)


@query("minimum_spanning_forest")
def _(spark, sf):
    """The tree over all vectors under mutual reachability, beyond the neighbour lists too."""
    points = vectors(spark, sf).select(F.col("key").cast("long").alias("key"), "vec")
    near = cut(neighbors.knn(points, K))
    tree = spanning_tree(points, near, cut(neighbors.core_distance(near, 10)))
    return tree.withColumn("weight", rounded(F.col("weight")))


@query("k_nearest_forest")
def _(spark, sf):
    """The forest of the neighbour graph alone."""
    return graph.minimum_spanning_forest(reach_edges(spark, sf)).withColumn("weight", rounded(F.col("weight")))


@query("density_clusters")
def _(spark, sf):
    return density.density_clusters(vectors(spark, sf).select("key", "vec"), min_cluster_size=10)


@query("density_assign")
def _(spark, sf):
    points = vectors(spark, sf).select("key", "vec", "y")
    split = cut(stratified_split(points))
    train = split.filter(~F.col("is_test")).select("key", "vec")
    model = density.fit_density(train, min_cluster_size=10)
    return density.density_assign(model, train, split.filter("is_test").select("key", "vec"))
