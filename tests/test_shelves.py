"""Neighbours from shelves of cells and from single precision: the same lists, few copies of a query."""

import numpy as np
import pytest

from knotwork.operators import neighbors


def points(spark, rows):
    return spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(rows)], "key long, vec array<double>")


def wanted_lists(rows, k):
    lists = {}
    for i, row in enumerate(rows):
        squares = ((rows - row) ** 2).sum(axis=1)
        squares[i] = np.inf
        lists[i] = np.lexsort([np.arange(len(rows)), squares])[:k].tolist()
    return lists


def test_a_query_is_sent_to_shelves_and_not_to_cells(spark, monkeypatch):
    rng = np.random.default_rng(1)
    rows = rng.normal(size=(2_000, 24))
    seen = []
    plain = neighbors.meet_in_cells

    def spy(left, right, *rest, **options):
        seen.append((left.count(), right.count()))
        return plain(left, right, *rest, **options)

    monkeypatch.setattr(neighbors, "meet_in_cells", spy)
    found = neighbors.knn(points(spark, rows), 3, block_rows=20)
    got = {}
    for r in found.orderBy("src", "place").collect():
        got.setdefault(r.src, []).append(r.dst)
    assert got == wanted_lists(rows, 3)
    # 100 cells, of which noise visits nearly all.
    assert seen == [(seen[0][0], 2_000)] and seen[0][0] <= neighbors.FEW_SHELVES * 2_000


@pytest.mark.parametrize("offset", [0.0, 1e6])
@pytest.mark.parametrize("far", [0.0, 1e12])
def test_single_precision_gives_the_same_lists(spark, offset, far):
    rng = np.random.default_rng(2)
    rows = rng.integers(-3, 4, (1_400, 6)).astype(float) + offset
    rows[:200] += np.round(rng.normal(size=(200, 6)) * 2**10) / 2**30
    rows[7] = rows[8] = rows[9]
    rows[10] += far
    found = neighbors.knn(points(spark, rows), 5)
    got = {}
    for r in found.orderBy("src", "place").collect():
        got.setdefault(r.src, []).append(r.dst)
    assert got == wanted_lists(rows, 5)


def test_a_strip_of_uncertain_values_is_left_to_doubles():
    rng = np.random.default_rng(3)
    base = rng.normal(size=(2_048, 4))
    rough, out = neighbors.Rough(base), np.empty((8, 2_048), dtype=np.float32)
    near = neighbors._rough_pairs(rough, base[:8] + 1e-3, np.full(8, -1), 4, out)
    assert near is not None and len(near[0]) < 8 * 64
    base[100] = 1e12
    assert neighbors._rough_pairs(neighbors.Rough(base), base[:8], np.full(8, -1), 4, out) is None
    assert not neighbors.Rough(np.full((4, 2), np.nan)).sound
