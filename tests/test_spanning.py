"""Spanning trees of all points against a plain search over all pairs."""

import numpy as np
import pytest

from knotwork.operators import neighbors, spanning


def plain_tree(rows, core):
    """Kruskal over all pairs by (weight, ends)."""
    n = len(rows)
    edges = sorted((max(float(np.sqrt(((rows[i] - rows[j]) ** 2).sum())), core[i], core[j]), i, j) for i in range(n) for j in range(i + 1, n))
    parent = list(range(n))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    out = []
    for w, i, j in edges:
        if find(i) != find(j):
            parent[find(i)] = find(j)
            out.append((i, j, w))
    return sorted(out)


def points(kind):
    rng = np.random.default_rng(9)
    if kind == "blobs":
        return np.concatenate([rng.normal(size=(30, 3)) * 0.2 + c for c in ([0, 0, 0], [9, 0, 0], [0, 9, 0], [40, 40, 0])])
    if kind == "grid":
        return np.array([[i, j] for i in range(9) for j in range(9)], dtype=float)
    return np.concatenate([np.zeros((12, 2)), np.ones((12, 2)) * 5, rng.normal(size=(40, 2)) * 3])


@pytest.mark.parametrize(("kind", "k", "block_rows"), [("blobs", 4, 20), ("grid", 3, 16_384), ("copies", 6, 16)])
def test_tree_equals_plain_search(spark, kind, k, block_rows):
    rows = points(kind)
    frame = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(rows)], "key long, vec array<double>")
    near = neighbors.knn(frame, k).cache()
    cores = neighbors.core_distance(near, 3).cache()
    core = {r.key: r.core for r in cores.collect()}
    found = sorted(map(tuple, spanning.spanning_tree(frame, near, cores, block_rows).collect()))
    wanted = plain_tree(rows, core)
    assert [(a, b) for a, b, _ in found] == [(a, b) for a, b, _ in wanted]
    assert [w for *_, w in found] == pytest.approx([w for *_, w in wanted], rel=1e-12)


def test_one_point(spark):
    frame = spark.createDataFrame([(0, [1.0])], "key long, vec array<double>")
    near = spark.createDataFrame([], "src long, dst long, distance double, place int")
    cores = spark.createDataFrame([(0, 0.0)], "key long, core double")
    assert spanning.spanning_tree(frame, near, cores).count() == 0


def test_query_equals_plain_search(spark):
    from knotwork.plans import catalog
    from knotwork.plans.bindings import vectors

    folder = "/root/testdata/sf0.001"
    rows = [r.vec for r in vectors(spark, folder).orderBy("key").collect()]
    keys = [r.key for r in vectors(spark, folder).orderBy("key").select("key").collect()]
    rows = np.array(rows)
    distance = np.sqrt(((rows[:, None, :] - rows[None, :, :]) ** 2).sum(axis=2))
    core = np.sort(distance, axis=1)[:, 10].tolist()
    found = sorted((r.src, r.dst, r.weight) for r in catalog.queries()["minimum_spanning_forest"](spark, folder).collect())
    wanted = sorted((keys[a], keys[b], round(w, 6)) for a, b, w in plain_tree(rows, core))
    assert [(a, b) for a, b, _ in found] == [(a, b) for a, b, _ in wanted]
    assert [w for *_, w in found] == pytest.approx([w for *_, w in wanted], abs=2e-6)
