"""Sparse feature rows against the dense ones."""

import pytest
from pyspark.sql import functions as F

from knotwork.operators import features, learn, sparse


def made(spark, n=60, communities=4):
    rows = spark.range(n)
    noise = F.when(F.col("id") % 7 == 3, -1).otherwise(F.col("id") % 3).cast("int")
    table = rows.select(F.col("id").alias("key"), (F.col("id") % 2).cast("int").alias("y"), (F.col("id") * 0.5 - 3).alias("a"), (F.col("id") % 5 * 1.0).alias("b"))
    clusters = rows.select(F.col("id").alias("key"), (F.col("id") % communities).cast("int").alias("community"), noise.alias("density_cluster"))
    return table, clusters


def test_equal_to_the_dense_rows(spark):
    table, clusters = made(spark)
    vec = table.filter("key < 50").select("key", F.array(F.col("a") * 2, F.lit(0.0), F.col("b")).alias("vec"))
    rules = table.filter("key % 3 = 0").select("key", (F.col("b") + 1).alias("r"))
    few = clusters.filter("key % 5 <> 1")
    dense = features.long_form(features.assemble_features(table, vec, few, rules)).filter("value <> 0")
    found = sparse.entries(sparse.assemble_sparse(table, vec, few, rules))
    assert sorted(map(tuple, found.collect())) == sorted(map(tuple, dense.collect())) and found.count() > 200


def test_labels_of_training_rows_only(spark):
    table, clusters = made(spark)
    rows = sparse.assemble_sparse(table, clusters=clusters, train=F.col("key") < 2)
    found = {r["key"]: r["features"] for r in rows.collect()}
    # Two numbers, communities 0 and 1, density clusters 0 and 1.
    assert all(v.size == 6 for v in found.values())
    assert list(found[1])[2:] == [0, 1, 0, 1] and list(found[2])[2:] == [0, 0, 0, 0] and list(found[3])[2:] == [0, 0, 0, 0]
    nobody = sparse.assemble_sparse(table, clusters=clusters, train=F.lit(False)).first()["features"]
    assert nobody.size == 4 and list(nobody)[2:] == [0, 0]


def test_a_million_communities(spark):
    table, clusters = made(spark, 1_000_000, 1_000_000)
    rows = sparse.assemble_sparse(table.select("key", "y", "a"), clusters=clusters)
    last = rows.filter("key = 999999").first()["features"]
    assert last.size == 1 + 1_000_000 + 4 and last[1_000_000] == 1.0 and len(last.indices) == 3
    count = sparse.entries(rows).agg(F.count("*"), F.countDistinct("position")).first()
    assert count[0] == 3_000_000 - 1 and count[1] == 1 + 1_000_000 + 4


@pytest.mark.parametrize("fit", [learn.logistic(), learn.forest(trees=3, depth=3)])
def test_learners_take_sparse_rows(spark, fit):
    table, clusters = made(spark)
    table = table.withColumn("y", ((F.col("key") % 4 == 0) | (F.col("b") > 3)).cast("int"))
    found = []
    for rows in (features.assemble_features(table, clusters=clusters), sparse.assemble_sparse(table, clusters=clusters)):
        rows = rows.repartition(1).sortWithinPartitions("key")
        found.append({r["key"]: r["probability"] for r in fit(rows)(rows).collect()})
    assert len(found[0]) == 60 and all(abs(found[0][key] - found[1][key]) < 1e-3 for key in found[0])
