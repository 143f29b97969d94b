"""Top-k lists against brute force."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from knotwork.llm import topk

SCHEMA = "vec_id long, embedding array<float>, label int"


def brute_force(rows, k=10, every=100):
    known = {}
    for id_, vec in rows:
        if id_ is None or vec is None or any(x is None or not math.isfinite(x) for x in vec):
            continue
        held = [min(max(math.floor(1024 * float(np.float32(x))), -(2**63)), 2**63 - 1) for x in vec]
        known.setdefault(id_, []).append(held)
    out = []
    for q in sorted(i for i in known if i % every == 0):
        query = min(known[q])
        scored = [(-sum(a * b for a, b in zip(query, v)), i) for i, vs in known.items() if i != q for v in vs]
        held = [(-min(max(-s, -(2**63)), 2**63 - 1), i) for s, i in scored]
        out += [(q, rank, i, -s) for rank, (s, i) in enumerate(sorted(held)[:k], 1)]
    return out


def check(spark, rows, **options):
    table = spark.createDataFrame([(i, v, 0) for i, v in rows], SCHEMA)
    table = table.withColumns({name: F.lit("x") for name in ("vec", "row", "query_id", "rank", "score", "radius", "_lb", "_rb")})
    found = sorted(tuple(r) for r in topk.top_products(table, **options).collect())
    assert found == brute_force(rows, **options)


def test_random_and_copied_vectors(spark):
    rng = np.random.default_rng(0)
    centers = rng.normal(size=(6, 16))
    rows = [(i, (centers[i % 6] + 0.3 * rng.normal(size=16)).tolist()) for i in range(1500)]
    rows += [(2000 + i, rows[100][1]) for i in range(700)]
    check(spark, rows)


def test_odd_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0]), (1, None), (2, [nan, 1.0]), (3, [inf, 1.0]), (4, [None, 1.0]), (None, [1.0, 1.0])]
    rows += [(5, [0.5]), (6, [0.5, 2.0]), (6, [0.5, 2.0]), (100, [0.0, 0.0]), (7, []), (200, [-0.001, 0.0009])]
    check(spark, rows)


def test_fewer_than_k_and_empty(spark):
    check(spark, [(0, [1.0, 2.0]), (5, [1.0, 2.0])])
    assert topk.top_products(spark.createDataFrame([], SCHEMA)).count() == 0


def test_blocks(spark, monkeypatch):
    from knotwork.operators import blocks

    monkeypatch.setattr(blocks, "BLOCK_ROWS", 100)
    rng = np.random.default_rng(1)
    check(spark, [(i, rng.integers(-2, 3, 4).astype(float).tolist()) for i in range(900)], k=7, every=50)


@pytest.mark.parametrize("size", [1e3, 1e5, 2e6, 1e9, 1e18])
def test_scores_are_exact_at_any_size(spark, size):
    """From 53-bit products over 64-bit ones to scores that are held at the ends of the range."""
    rng = np.random.default_rng(2)
    base = rng.normal(size=8) * size
    rows = [(i, (base + rng.integers(-3, 4, 8) * max(1.0, size * 2.0**-22)).tolist()) for i in range(400)]
    check(spark, rows + [(500 + i, rows[7][1]) for i in range(30)])


def test_close_scores_keep_their_order():
    whole = np.array([[1_024_000_000, 3, 1], [1_024_000_000, 2, 3], [1_024_000_000, 1, 2]])
    tree = topk.build(whole, np.array([7, 8, 9]))
    query = np.array([2_048_000_000, 11, 18])
    wanted = sorted(((int(sum(int(a) * int(b) for a, b in zip(query, row))), i) for row, i in zip(whole, (7, 8, 9))), key=lambda e: (-e[0], e[1]))
    assert topk.search(tree, query, -1, 3) == wanted


def test_rows_that_repeat_are_candidates_each(spark):
    rows = [(0, [1.0, 1.0])] * 3 + [(5, [2.0, 1.0])] * 40 + [(6, [1.0, 1.0])]
    check(spark, rows)


@pytest.mark.parametrize("page", [4, topk.PAGE])
def test_a_tree_of_several_levels_reads_few_pages_in_noise(monkeypatch, page):
    monkeypatch.setattr(topk, "PAGE", page)
    rng = np.random.default_rng(9)
    rows = rng.integers(-1024, 1024, (page * 9, 32))
    ids = rng.permutation(len(rows))
    tree = topk.build(rows, ids)
    assert tree.children is not None
    for own in range(5):
        scores = rows @ rows[own]
        order = [i for i in np.lexsort([ids, -scores]) if i != own][:10]
        assert topk.search(tree, rows[own], int(ids[own]), 10) == [(int(scores[i]), int(ids[i])) for i in order]

    def leaves(node):
        return 1 if node.children is None else sum(leaves(child) for child in node.children)

    # A step of the search costs the same for a few entries as for hundreds.
    assert page < 512 or leaves(tree) <= len(rows) // 64
