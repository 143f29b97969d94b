"""What the members of each cluster have in common."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from knotwork.operators.patterns import cluster_triples_join
from knotwork.operators.skew import HOT_ROWS, salted_join
from knotwork.operators.triples import PATIENT_PREFIX, category_filter

TOP_K = 15


def cluster_category_counts(
    clusters: DataFrame, triples: DataFrame, cluster: str = "community", prefix: str = PATIENT_PREFIX, hot_rows: int = HOT_ROWS
) -> DataFrame:
    """Category nodes of each cluster's patients, most frequent first."""
    joined = cluster_triples_join(clusters, category_filter(triples), cluster, prefix, hot_rows)
    counted = joined.groupBy("cluster", F.col("obj").alias("category")).agg(F.count(F.lit(1)).alias("n"))
    return counted.orderBy("cluster", F.desc("n"), "category")


def cluster_edge_counts(
    clusters: DataFrame, triples: DataFrame, cluster: str = "community", hot_rows: int = HOT_ROWS
) -> DataFrame:
    """(predicate, category node) counts for all clusters in one grouped pass."""
    members = clusters.select(F.col("key").alias("subj"), F.col(cluster).alias("cluster"))
    joined = salted_join(category_filter(triples, "loose"), members, ["subj"], hot_rows=hot_rows)
    return joined.groupBy("cluster", "pred", "obj").agg(F.count(F.lit(1)).alias("n"))


def topk_per_cluster(counts: DataFrame, k: int = TOP_K) -> DataFrame:
    """The k most frequent rows of each cluster.

    Spark keeps at most k rows per cluster and map task before the shuffle (WindowGroupLimit),
    so a cluster with very many distinct rows does not end up whole in one task.
    """
    order = Window.partitionBy("cluster").orderBy(F.desc("n"), "pred", "obj")
    return counts.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= k)


def order_limit(rows: DataFrame, count: str, ties: list[str], limit: int) -> DataFrame:
    """Greatest counts first, cut to ``limit``; ties by the named columns."""
    return rows.orderBy(F.desc(count), *ties).limit(limit)
