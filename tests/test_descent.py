"""Neighbour descent against the exact search."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from knotwork.operators import descent, neighbors

rng = np.random.default_rng(11)


def frame(spark, values):
    return spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(values)], "key long, vec array<double>")


def share(values, found, k):
    """Recall of the lists by brute force over all points."""
    away = np.sqrt(((values[:, None, :] - values[None, :, :]) ** 2).sum(axis=2))
    np.fill_diagonal(away, np.inf)
    edge = np.sort(away, axis=1)[:, k - 1]
    return sum(away[r.src, r.dst] <= edge[r.src] + 1e-9 for r in found) / (len(values) * k)


def test_recall_in_64_dimensions(spark):
    values = rng.normal(size=(1600, 64))
    points = frame(spark, values)
    lists = descent.knn_approx(points, 10)
    found = lists.collect()
    assert len(found) == 16_000 and len({(r.src, r.dst) for r in found}) == 16_000
    assert all(r.src != r.dst for r in found)
    for r in found[::97]:
        assert r.distance == pytest.approx(np.linalg.norm(values[r.src] - values[r.dst]))
    whole = share(values, found, 10)
    assert whole >= 0.9
    # The first partitions alone miss many of them.
    assert share(values, descent._leaf_lists(points, 10, 1600, 42).collect(), 10) < 0.7
    told = descent.recall(points, lists, 10, sample_rows=1600).first()
    assert told.n_queries == 1600 and told.recall == pytest.approx(whole, abs=1e-9)


def test_small_tables_are_exact(spark):
    points = frame(spark, rng.normal(size=(80, 4)))
    exact = neighbors.knn(points, 5).select("src", "dst", "place").collect()
    assert sorted(descent.knn_approx(points, 5).select("src", "dst", "place").collect()) == sorted(exact)


def test_copies_nulls_and_empty_tables(spark):
    values = np.vstack([np.zeros((700, 3)), rng.normal(size=(100, 3))])
    points = frame(spark, values).unionByName(spark.createDataFrame([(None, [0.0] * 3), (9999, None)], "key long, vec array<double>"))
    lists = descent.knn_approx(points.withColumn("distance", F.lit(1)).withColumn("src", F.lit("x")), 4)
    found = lists.collect()
    assert len(found) == 800 * 4 and share(values, found, 4) >= 0.9
    assert all(r.distance == 0 for r in found if r.src < 700)
    for rows in (0, 1):
        assert descent.knn_approx(points.limit(0) if not rows else frame(spark, values[:1]), 4).collect() == []
    assert {r.dst for r in descent.knn_approx(frame(spark, values[699:701]), 4).collect()} == {0, 1}


def test_codes_are_short_and_near(spark):
    values = rng.normal(size=(900, 16))
    for stretched, most in ((False, 16 + 2), (True, 16 * 8)):
        if stretched:
            values[0] = 1e9
        points = frame(spark, values)
        lists = descent._leaf_lists(points, 10, 900, 42)
        grid = descent._grid(points)
        rows = sorted(descent._codes(points, lists, grid).collect())
        found = descent._decoded(descent.pa.array([bytes(r.code) for r in rows], descent.pa.binary()), grid)
        near = {r.src: r.least for r in lists.groupBy("src").agg(F.min("distance").alias("least")).collect()}
        error = np.linalg.norm(found - values, axis=1)
        assert all(error[i] <= near[i] * descent.CODE_ERROR for i in near)
        assert np.mean([len(r.code) for r in rows]) <= most


def test_a_vector_goes_once_to_a_block(spark):
    values = rng.normal(size=(700, 8))
    points = descent.cut(frame(spark, values))
    lists = descent.cut(descent._best(descent._leaf_lists(points, 10, 700, 42).withColumn("fresh", F.lit(1)), 10))
    grid = descent._grid(points)
    blocks = descent._leaves(points, 700, 350, 42).select("key", F.concat_ws("-", "leaf", "part").alias("block"))
    better, around = descent._improvements(descent._codes(points, lists, grid), grid, blocks, lists, 10)
    n_blocks = blocks.select("block").distinct().count()
    assert n_blocks > 1 and around.select("block", "key").distinct().count() <= n_blocks * 700 < around.count()
    edge = {r.src: r.edge for r in lists.groupBy("src").agg(F.max("distance").alias("edge")).collect()}
    pairs = better.collect()
    assert pairs
    for r in pairs:
        assert r.src != r.dst and r.distance < edge[r.src]
        assert r.distance == pytest.approx(np.linalg.norm(values[r.src] - values[r.dst]), rel=0.1)


def test_tight_clusters_far_apart_and_text_keys(spark):
    centres = rng.normal(size=(6, 8)) * 1e6
    values = np.repeat(centres, 150, axis=0) + rng.normal(size=(900, 8)) * 1e-3
    values[0] = 1e9
    points = frame(spark, values)
    named = points.select(F.concat(F.lit("k"), F.col("key").cast("string")).alias("key"), "vec")
    found = [r.asDict() for r in descent.knn_approx(named, 5).collect()]
    assert len(found) == 4500
    rows = [type("Row", (), {"src": int(r["src"][1:]), "dst": int(r["dst"][1:])}) for r in found if r["src"] != "k0"]
    for row, r in zip(rows[::50], [r for r in found if r["src"] != "k0"][::50]):
        assert r["distance"] == pytest.approx(np.linalg.norm(values[row.src] - values[row.dst]), rel=1e-6)
    assert share(values, rows, 5) >= 0.9


def test_repeated_keys(spark):
    values = rng.normal(size=(900, 8))
    points = frame(spark, values).unionByName(frame(spark, values[:300]))
    found = descent.knn_approx(points, 5).collect()
    assert len({(r.src, r.dst) for r in found}) == len(found) == 4500
    # Only a key with two rows may list itself.
    assert all(r.src < 300 and r.distance == 0 for r in found if r.src == r.dst)
    others = [r for r in found if r.src != r.dst]
    for r in others[::50]:
        assert r.distance == pytest.approx(np.linalg.norm(values[r.src] - values[r.dst]))
