"""Ranks counted from single precision and distance sums in small blocks, against brute force."""

import numpy as np
import pyarrow as pa
import pytest

from knotwork.operators import blocks, linkpred, vectors


def tables(rng, model, offset):
    entities = rng.integers(-40, 41, (700, 4)) / 8 + (offset if model == "transe" else 0.0)
    entities[5:25] = entities[4]
    entities[30:40] += 2.0**-27
    queries = entities[rng.integers(0, 700, 300)] + rng.integers(-4, 5, (300, 4)) / 8
    target = rng.integers(0, 700, 300)
    target[:40] = np.arange(40)
    queries[40:60] = entities[4]
    target[40:60] = 5
    return entities, queries, target


@pytest.mark.parametrize("model", ["transe", "distmult"])
@pytest.mark.parametrize("offset", [0.0, 1e5])
def test_counts_come_from_single_precision(monkeypatch, model, offset):
    entities, queries, target = tables(np.random.default_rng(1), model, offset)
    distance = model == "transe"
    scores = -np.sqrt(((queries[:, None] - entities[None]) ** 2).sum(axis=2)) if distance else queries @ entities.T
    own = np.round(scores[np.arange(300), target], 9)
    gap = scores - own[:, None]
    gap[np.arange(300), target] = -np.inf

    def forbidden(*_):
        raise AssertionError("all distances in doubles")

    monkeypatch.setattr(linkpred, "squared_distances", forbidden)
    monkeypatch.setattr(linkpred, "ROUGH_COLUMNS", 256)
    candidates = pa.table({"id": np.arange(700), "vec": blocks.list_column(entities)})
    asked = pa.table({"row": np.arange(300), "side": ["tail"] * 300, "query": blocks.list_column(queries), "target": target, "own": own})
    found = linkpred._count_better(distance)(candidates)(asked)
    assert found.column("greater").to_pylist() == (gap > 0.5e-9).sum(axis=1).tolist()
    assert found.column("equal").to_pylist() == (np.abs(gap) <= 0.5e-9).sum(axis=1).tolist()


@pytest.mark.parametrize("offset", [0.0, 1e6])
def test_sums_of_distances_in_small_blocks(monkeypatch, offset):
    monkeypatch.setattr(vectors, "SUM_ROWS", 16)
    monkeypatch.setattr(vectors, "SUM_COLUMNS", 40)
    rng = np.random.default_rng(2)
    base, rows = rng.normal(size=(333, 5)) + offset, rng.normal(size=(77, 5)) + offset
    rows[:30] = base[:30] + 2.0**-20
    cluster = rng.integers(0, 4, 333)
    right = pa.table({"key": np.arange(333), "cluster": cluster, "vec": blocks.list_column(base)})
    left = pa.table({"key": np.arange(77), "cluster": np.zeros(77, dtype=np.int64), "vec": blocks.list_column(rows)})
    found = vectors._distance_sums(right)(left)
    exact = np.sqrt(((rows[:, None] - base[None]) ** 2).sum(axis=2))
    wanted = np.stack([exact[:, cluster == c].sum(axis=1) for c in range(4)], axis=1)
    assert np.array(found.column("total")).reshape(77, 4) == pytest.approx(wanted, rel=1e-9)
    assert found.column("members").to_pylist() == np.bincount(cluster).tolist() * 77


def test_tiles_outnumber_cores_and_are_bounded(spark):
    left = spark.range(20_000).selectExpr("id AS key")
    seen = blocks.tile_join(left, left, "key", "key", lambda right: lambda rows: pa.table({"n": [rows.num_rows]}), "n long", 20_000, 20_000)
    assert seen.rdd.getNumPartitions() > 2 * spark.sparkContext.defaultParallelism
    sides = blocks.tile_sides(10_000_000, 10_000_000, 48)
    assert 1e14 / (sides[0] * sides[1]) <= 2**32


@pytest.mark.parametrize("columns", [10, 16_384, 65_536])
def test_a_strip_of_doubles_stays_small(columns):
    parts = blocks.strips(2_000, columns)
    assert [i for part in parts for i in range(2_000)[part]] == list(range(2_000))
    assert max(part.stop - part.start for part in parts) * columns * 8 <= 2**24
