"""Distances of vectors with large offsets, tiles of any size, and both ways to the nearest center."""

import itertools
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from knotwork.operators import blocks, linkpred, vectors

OFFSETS = [0.0, 1e4, 1e6, 1.7e9]


def exact_squares(a, b):
    from fractions import Fraction

    return [[float(sum((Fraction(x) - Fraction(y)) ** 2 for x, y in zip(p, q))) for q in b] for p in a]


@pytest.mark.parametrize("offset", OFFSETS)
def test_squared_distances_keep_their_digits(offset):
    rng = np.random.default_rng(1)
    a, b = rng.normal(size=(30, 5)) + offset, rng.normal(size=(40, 5)) + offset
    b[:10] = a[:10] + np.outer(np.logspace(-9, 0, 10), np.ones(5))
    b[10] = a[3]
    assert blocks.squared_distances(a, b) == pytest.approx(np.array(exact_squares(a, b)), rel=1e-9, abs=0)


def frame(spark, rows, name="vec"):
    return spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(rows)], f"key long, {name} array<double>")


@pytest.mark.parametrize("offset", OFFSETS)
def test_both_ways_to_the_nearest_center_agree(spark, offset, monkeypatch):
    rng = np.random.default_rng(2)
    steps = [1e-5, 1e-3, 0.1, 1.0] if offset <= 1e6 else [0.25, 0.5, 2.0, 8.0]
    points = np.concatenate([rng.integers(-4, 5, (60, 3)) + offset, [[offset] * 3] * 5])
    centers = np.array([[offset + s, offset, offset] for s in steps] * 2 + (rng.integers(-4, 5, (20, 3)) + offset).tolist())
    left, right = frame(spark, points), frame(spark, centers, "centroid").withColumnRenamed("key", "cluster")
    squares = exact_squares(points, centers)
    wanted = {i: min(range(len(centers)), key=lambda c, i=i: (squares[i][c], c)) for i in range(len(points))}
    held = vectors.nearest_centroid(left, right).collect()
    monkeypatch.setattr(blocks, "BLOCK_ROWS", 7)
    monkeypatch.setattr(vectors, "HELD_BYTES", 0)
    joined = vectors.nearest_centroid(left, right).collect()
    for found in (held, joined):
        assert {r.key: r.nearest for r in found} == wanted
        for r in found:
            assert r.nearest_distance == pytest.approx(math.sqrt(squares[r.key][r.nearest]), rel=1e-12)


@pytest.mark.parametrize("offset", [0.0, 1.7e9])
@pytest.mark.parametrize("held", [10, 65_536])
def test_silhouette_does_not_hang_on_an_offset(spark, monkeypatch, offset, held):
    monkeypatch.setattr(blocks, "HELD_ROWS", held)
    rng = np.random.default_rng(3)
    rows = np.round(rng.normal(size=(60, 2)) * 4) / 4 + np.repeat([[0, 0], [30, 0], [0, 30]], 20, axis=0)
    distance = np.sqrt(np.array(exact_squares(rows, rows)))
    own = np.repeat([0, 1, 2], 20)
    values = []
    for i in range(60):
        a = distance[i][own == own[i]].sum() / 19
        b = min(distance[i][own == c].mean() for c in range(3) if c != own[i])
        values.append((b - a) / max(a, b))
    table = frame(spark, rows + offset).withColumn("cluster", F.floor(F.col("key") / 20).cast("int"))
    assert vectors.silhouette(table).first()[0] == pytest.approx(np.mean(values), rel=1e-9)
    assert vectors.silhouette_samples(table).count() == 60


def test_pairwise_distances_in_tiles(spark, monkeypatch):
    monkeypatch.setattr(blocks, "HELD_ROWS", 3)
    rng = np.random.default_rng(4)
    points, centers = rng.normal(size=(40, 4)) + 1e8, rng.normal(size=(11, 4)) + 1e8
    found = vectors.pairwise_distance(frame(spark, points), frame(spark, centers, "centroid").withColumnRenamed("key", "cluster"))
    squares = exact_squares(points, centers)
    got = {(r.key, r.cluster): r.distance for r in found.collect()}
    assert set(got) == set(itertools.product(range(40), range(11)))
    assert all(got[i, c] == pytest.approx(math.sqrt(squares[i][c]), rel=1e-12) for i, c in got)


@pytest.mark.parametrize("offset", [0.0, 1e6])
def test_ranks_do_not_hang_on_an_offset(spark, offset):
    rng = np.random.default_rng(5)
    entities = frame(spark, rng.integers(0, 50, (40, 3)) + offset).withColumnRenamed("key", "id")
    relations = frame(spark, [[1.0, 0.0, -1.0]]).withColumnRenamed("key", "id")
    triples = spark.createDataFrame([(i, 0, (i * 7 + 3) % 40) for i in range(40)], "head long, relation long, tail long")
    ranks = linkpred.rank_candidates(triples, triples, entities, relations, "transe").orderBy("head", "side").collect()
    plain = entities.withColumn("vec", F.transform("vec", lambda x: x - offset))
    wanted = linkpred.rank_candidates(triples, triples, plain, relations, "transe").orderBy("head", "side").collect()
    assert ranks == wanted


@pytest.mark.parametrize("rows", [1_000_000, 100_000_000])
def test_copies_of_a_row_are_bounded_by_the_root_of_the_tiles(rows):
    left, right = blocks.tile_sides(rows, rows, 1000)
    assert right == max(math.ceil(rows / blocks.HELD_ROWS), math.isqrt(1000))
    assert max(left, right) <= 1.1 * max(math.sqrt(left * right), rows / blocks.HELD_ROWS) + 1
    assert blocks.tile_sides(10, 10, 8) == (1, 1)
