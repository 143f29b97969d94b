"""Components against brute force over full shingle sets."""

import random
import re

import pytest
from cases import clashing, document, frame, odd_documents, words

from knotwork.llm import minhash_dedup


def shingles(text):
    found = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    if len(found) < 5:
        return {tuple(found)} if found else set()
    return {tuple(found[i : i + 5]) for i in range(len(found) - 4)}


def brute_force(rows, percent=85):
    parent = {r.doc_id: r.doc_id for r in rows if r.doc_id is not None}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    sets = [(r.doc_id, shingles(r.text)) for r in rows if r.doc_id is not None]
    for i, (a, left) in enumerate(sets):
        for b, right in sets[:i]:
            if left and right and 100 * len(left & right) >= percent * len(left | right):
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    return {k: find(k) for k in parent}


def check(spark, rows):
    wanted = brute_force(rows)
    found = minhash_dedup.near_duplicates(frame(spark, rows)).collect()
    assert len(found) == len(rows)
    for row in found:
        assert row.component_id == (None if row.doc_id is None else wanted[row.doc_id])
        assert row.kept == (row.doc_id is None or row.doc_id == row.component_id)
    by_text = sorted((r.doc_id is None, r.doc_id or 0, len(shingles(r.text))) for r in rows)
    assert by_text == sorted((r.doc_id is None, r.doc_id or 0, r.n_shingles) for r in found)


def edited(base, seed, edits):
    picker = random.Random(seed)
    out = list(base)
    for _ in range(edits):
        out[picker.randrange(len(out))] = f"edit{picker.randrange(10**6)}"
    return " ".join(out)


def test_near_copies_equal_brute_force(spark):
    rows = [document(i, edited(words(i // 12, 220), i, i % 12)) for i in range(240)]
    rows += [document(1000 + i, " ".join(words(50 + i % 3, 90))) for i in range(90)]
    check(spark, rows)


def test_large_group_is_cut_into_blocks(spark, monkeypatch):
    monkeypatch.setattr(minhash_dedup, "BLOCK_ROWS", 40)
    base = words(7, 200)
    check(spark, [document(i, edited(base, i, i % 9)) for i in range(300)])


def crowd(count, shared, own):
    """Texts with the same first words and others of their own, in pieces so that many shingles are shared."""
    base = words(11, shared)
    return [document(i, " ".join(base + [f"own{i}x{j}" for j in range(own)])) for i in range(count)]


@pytest.mark.parametrize(("shared", "own"), [(60, 40), (80, 28), (90, 13)])
def test_crowds_that_look_alike_cost_few_copies(spark, monkeypatch, shared, own):
    """Mutual similarities of about 0.4, 0.6 and 0.8 link nothing; copies are bounded by candidates, not by blocks."""
    monkeypatch.setattr(minhash_dedup, "BLOCK_ROWS", 4)
    rows = crowd(500, shared, own)
    classes = minhash_dedup.signatures(frame(spark, rows)).withColumnRenamed("doc_id", "rep").cache()
    candidates = minhash_dedup.forest_candidates(classes).cache()
    groups = minhash_dedup.components(candidates.filter("tie"))
    wanted = minhash_dedup.wanted_blocks(candidates, groups)
    copies = wanted.selectExpr("coalesce(sum(size(others)), 0) as n").first().n
    pairs = candidates.count()
    assert copies <= 2 * pairs <= 2 * 500 * minhash_dedup.TREES * minhash_dedup.WINDOW
    if own == 40:
        assert pairs < 50
    check(spark, rows + [document(1000 + i, r.text + " more") for i, r in enumerate(rows[:40])])


def test_pairs_over_the_edges_of_ranges_count(spark, monkeypatch):
    monkeypatch.setattr(minhash_dedup, "EDGE_ROWS", 30)
    rows = [document(i, edited(words(i // 2, 120), i, 2 * (i % 2))) for i in range(60)]
    classes = minhash_dedup.signatures(frame(spark, rows)).withColumnRenamed("doc_id", "rep").cache()
    found = {(r.src, r.dst) for r in minhash_dedup.forest_candidates(classes).collect()}
    ordered = minhash_dedup.forest_candidates(classes.coalesce(1)).collect()
    assert {(2 * i + 1, 2 * i) for i in range(30)} <= found
    assert found >= {(r.src, r.dst) for r in ordered if r.src - r.dst == 1 and r.dst % 2 == 0}


def test_rows_that_repeat_send_one_set(spark):
    rows = [document(1, edited(words(1, 80), 1, 1))] * 300 + [document(2, edited(words(1, 80), 2, 1))] * 300
    check(spark, rows + [document(3, "other words")])


def test_odd_rows(spark):
    check(spark, odd_documents())


def test_ids_that_repeat_tie_their_texts(spark):
    a, b = " ".join(words(1, 50)), " ".join(words(2, 50))
    rows = [document(5, a), document(9, b), document(7, a), document(7, b)]
    found = minhash_dedup.near_duplicates(frame(spark, rows)).collect()
    assert {r.component_id for r in found} == {5}


def test_empty_table_and_clashing_columns(spark):
    empty = frame(spark, [])
    assert minhash_dedup.near_duplicates(empty).columns == ["doc_id", "n_shingles", "component_id", "kept"]
    assert minhash_dedup.keep_first(empty).count() == 0
    rows = odd_documents()
    kept = minhash_dedup.keep_first(clashing(frame(spark, rows)))
    assert kept.columns == clashing(frame(spark, rows)).columns
    assert {6, 4, 5, 9, 1, 2, 3, 11, 12} <= {r.doc_id for r in kept.collect()}
    assert 7 not in {r.doc_id for r in kept.collect()}
