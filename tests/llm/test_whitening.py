"""Whitening against the same in exact integers and NumPy."""

import math
import random
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from knotwork.llm import queries, whitening

VECTORS = "vec_id long, embedding array<float>, label int"


def plain(rows):
    """id, scaled vector of the rows that take part; covariance and sums in exact numbers."""
    kept = [(i, [float(np.float32(c)) for c in v]) for i, v, *_ in rows if v is not None and all(c is not None and math.isfinite(c) for c in v)]
    width = max((len(v) for _, v in kept), default=0)
    scaled = [(i, [math.floor(1024 * c) + 100_000 for c in v + [0.0] * (width - len(v))]) for i, v in kept]
    n = len(scaled)
    sums = [sum(x[d] for _, x in scaled) for d in range(width)]
    return scaled, n, sums


def check(found, rows, components=8):
    scaled, n, sums = plain(rows)
    width = len(sums)
    exact = np.array([[n * a - s for a, s in zip(x, sums)] for _, x in scaled], dtype=object)
    scatter = exact.T @ exact
    covariance = np.array([[float(Fraction(int(scatter[i, j]), n**3)) for j in range(width)] for i in range(width)])
    values, vectors = np.linalg.eigh(covariance)
    values, vectors = values[::-1], vectors[:, ::-1]
    kept = min(components, int((values > values[0] * 1e-12).sum()))
    by_id = {}
    for r in found:
        by_id.setdefault(r.vec_id, []).append(r)
    assert len(found) == n * kept
    centred = exact.astype(np.float64) / n
    wanted = centred @ vectors[:, :kept] / np.sqrt(values[:kept])
    deviations = (exact**2).sum(axis=1)
    signs = None
    got = np.zeros((n, kept))
    for place, (i, _) in enumerate(scaled):
        own = sorted((r for r in by_id[i]), key=lambda r: r.component)
        if len(own) == kept:
            assert [r.component for r in own] == list(range(1, kept + 1))
            got[place] = [r.whitened for r in own]
        assert all(r.n == n and r.identity_error <= 1e-8 for r in own)
        assert {r.deviation for r in own} & {int(deviations[place])}
        for r in own:
            assert r.explained == pytest.approx(values[r.component - 1] / np.trace(covariance), rel=1e-9)
    whole = [p for p, (i, _) in enumerate(scaled) if len(by_id[i]) == kept]
    signs = np.sign((got[whole] * wanted[whole]).sum(axis=0))
    assert np.abs(got[whole] * signs - wanted[whole]).max() < 1e-6


def spread(seed, count, width):
    """Rows whose dimensions have clearly different variances."""
    pick = random.Random(seed)
    mix = np.linalg.qr(np.random.default_rng(seed).normal(size=(width, width)))[0]
    return [(mix @ [pick.gauss(1, 1.5 ** (width - d)) for d in range(width)]).tolist() for _ in range(count)]


@pytest.mark.parametrize(("count", "width"), [(700, 12), (30, 5), (9, 3)])
def test_equals_exact_numbers(spark, count, width):
    rows = [(i, v, 0) for i, v in enumerate(spread(count, count, width))]
    frame = spark.createDataFrame(rows, VECTORS).repartition(5)
    names = "number place part n deviation ids values whitened component vec matrix"
    found = whitening.whiten(frame.withColumns({c: F.lit("x") for c in names.split()})).collect()
    check(found, rows)


def test_many_blocks(spark, monkeypatch):
    monkeypatch.setattr(whitening, "LEAST_BLOCK_ROWS", 16)
    monkeypatch.setattr(whitening, "BLOCKS_A_TASK", 3)
    rows = [(i, v, 0) for i, v in enumerate(spread(3, 500, 6))]
    check(whitening.whiten(spark.createDataFrame(rows, VECTORS).repartition(3)).collect(), rows)


def test_odd_rows(spark):
    rows = [(i, v, 0) for i, v in enumerate(spread(4, 60, 4))]
    rows += [(100, None, 0), (101, [1.0, None, 1.0, 1.0], 0), (102, [float("nan")] * 4, 0), (103, [float("inf"), 1.0, 1.0, 1.0], 0)]
    rows += [(None, [3.0, 1.0, -2.0, 5.0], 0), (5, rows[5][1], 0), (5, rows[5][1], 0), (104, [2.0], 0), (105, [], 0)]
    check(whitening.whiten(spark.createDataFrame(rows, VECTORS)).collect(), rows)


def test_no_variance_and_empty(spark):
    same = spark.createDataFrame([(i, [1.0, 2.0], 0) for i in range(5)], VECTORS)
    for frame in (same, same.limit(0), same.limit(1), spark.createDataFrame([(1, [], 0), (2, None, 0)], VECTORS)):
        found = whitening.whiten(frame)
        assert found.columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]
        assert found.count() == 0


def test_deviations_are_exact_up_to_64_bits(spark):
    rows = [(0, [0.0, 0.0], 0), (1, [1.0e5, 7.0], 0), (2, [-3.0e5, 1.0], 0), (3, [2.0e30, 0.0], 0)]
    exact = [(i, v, 0) for i, v, _ in rows[:3]]
    check(whitening.whiten(spark.createDataFrame(exact, VECTORS)).collect(), exact)
    found = whitening.whiten(spark.createDataFrame(rows, VECTORS)).collect()
    assert {r.deviation for r in found} == {None}
    x = np.array([[2**31 + 5, 1], [3, -7]])
    sums = [2**31 + 8, -6]
    assert whitening.deviations(x, 2, sums) == [(2**31 + 2) ** 2 + 8**2] * 2


def test_query_equals_exact_numbers(spark):
    folder = "/root/testdata/sf0.001"
    rows = [(r.vec_id, list(r.embedding) if r.embedding is not None else None) for r in spark.read.parquet(f"{folder}/embeddings.parquet").collect()]
    check(queries.QUERIES["op11_whitening"](spark, folder).collect(), rows)
