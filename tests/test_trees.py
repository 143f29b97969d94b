"""Forests against plain loops: every gap between two values is a split, and nothing but pure leaves ends a tree."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from knotwork.operators import learn, trees

rng = np.random.default_rng(5)


def sorted_rows(values, labels, chunk=7):
    values = np.asarray(values)
    return trees.Sorted([values[i : i + chunk] for i in range(0, len(values), chunk)], np.asarray(labels, float))


def depth_of(tree, at=0):
    return 0 if tree["feature"][at] < 0 else 1 + max(depth_of(tree, tree["left"][at]), depth_of(tree, tree["left"][at] + 1))


def plain_best(values, labels, weights, leaf):
    """The greatest sum of squares by weight over all gaps of one feature."""
    best = -np.inf
    for bound in np.unique(values)[:-1]:
        sides = [values <= bound, values > bound]
        if min(s.sum() for s in sides) >= leaf:
            best = max(best, sum(sum(weights[s & (labels == c)].sum() ** 2 for c in np.unique(labels)) / weights[s].sum() for s in sides))
    return best


@pytest.mark.parametrize("cells", [2**16, 40])
@pytest.mark.parametrize("leaf", [1, 3])
def test_best_split_of_each_node_and_feature(monkeypatch, cells, leaf):
    monkeypatch.setattr(trees, "SORTED_CELLS", cells)
    values, labels = rng.integers(0, 9, (60, 4)).astype(float), rng.integers(0, 3, 60).astype(float)
    values[:, 3] = 2.0
    data = sorted_rows(values, labels)
    values, labels = values[data.order], labels[data.order]
    weights, node = rng.integers(1, 4, 60), np.sort(rng.integers(0, 5, 60))
    drawn = np.array([rng.permutation(4) for _ in range(5)])
    pairs = [np.where(labels == 0, weights, 0) + (np.where(labels == 1, weights, 0) << trees.LABEL_BITS), np.where(labels == 2, weights, 0)]
    score, left, right, varied = trees._best_splits(data, np.arange(60), node, pairs, drawn, leaf)
    for n in range(5):
        for slot in range(4):
            own, feature = node == n, drawn[n, slot]
            best = plain_best(values[own, feature], labels[own], weights[own], leaf)
            assert score[n, slot] == pytest.approx(best) if np.isfinite(best) else np.isneginf(score[n, slot])
            assert varied[n, slot] == (len(np.unique(values[own, feature])) > 1)
            if np.isfinite(best):
                bound = values[left[n, slot], feature]
                assert values[right[n, slot], feature] == values[own, feature][values[own, feature] > bound].min()


def test_trees_grow_until_their_leaves_are_pure():
    """Labels alternate along the one feature, so a tree needs a leaf for nearly each row and far more than 30 levels."""
    values, labels = np.arange(4000.0)[:, None], np.arange(4000) % 2
    data = sorted_rows(values, labels)
    tree = trees.grow(data, [1, 0], None, 1)
    assert set(tree["value"][tree["feature"] < 0]) == {0.0, 1.0}
    drawn = np.flatnonzero(np.bincount(np.random.default_rng([1, 0]).integers(0, 4000, 4000), minlength=4000))
    inside = data.order[drawn]
    assert (trees.shares(tree, values)[inside] == labels[inside]).all()
    assert depth_of(tree) > 30
    assert depth_of(trees.grow(data, [1, 0], 4, 1)) == 4


def test_trees_do_not_depend_on_the_order_of_rows_or_where_numbers_lie(monkeypatch):
    values, labels = rng.normal(size=(90, 5)), rng.integers(0, 2, 90)
    values[3, 1], values[4, 1] = np.nan, -0.0
    tree, mixed = trees.grow(sorted_rows(values, labels), [2, 7], None, 2), rng.permutation(90)
    monkeypatch.setattr(trees, "HELD_NUMBERS", 10)
    other = trees.grow(sorted_rows(values[mixed], labels[mixed], 20), [2, 7], None, 2)
    assert (tree == other).all() and len(tree) > 5


def test_equal_rows_of_different_labels_end_in_one_leaf():
    tree = trees.grow(sorted_rows(np.ones((40, 3)), np.arange(40) % 2), [1, 1], None, 1)
    assert len(tree) == 1 and 0 < tree["value"][0] < 1
    alone = trees.grow(sorted_rows(rng.normal(size=(9, 2)), np.zeros(9)), [1, 1], None, 1)
    assert len(alone) == 1 and alone["value"][0] == 0


def test_forest_tells_neighbouring_values_apart(spark, monkeypatch):
    """More values than bins: the forest before knew 32 gaps of a feature and could not tell most rows apart."""
    monkeypatch.setattr(trees, "SCORE_ROWS", 100)
    monkeypatch.setattr(trees, "HELD_NUMBERS", 300)
    rows = [(i // 2, i % 2, [float(i), float(i % 3)]) for i in range(600)]
    train = spark.createDataFrame(rows, "key long, y int, features array<double>").repartition(3)
    found = learn.forest(trees=20)(train)(train)
    assert found.columns == ["key", "y", "features", "probability"] and found.count() == 600
    right = found.filter((F.col("probability") > 0.5) == (F.col("y") == 1)).count()
    assert right > 500
    again = {tuple(r.features): r.probability for r in learn.forest(trees=20)(train.orderBy(F.desc("key")))(train).collect()}
    assert again == {tuple(r.features): r.probability for r in found.collect()}
