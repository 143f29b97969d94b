"""Replication against a direct inversion of the Poisson distribution."""

import hashlib
import math
from collections import Counter

from cases import clashing, document, frame, odd_documents, words

from knotwork.llm import mixing


def uniform(seed, *parts):
    text = "|".join([str(seed), *["" if p is None else str(p) for p in parts]])
    return (int(hashlib.md5(text.encode()).hexdigest()[:12], 16) + 0.5) / 16**12


def brute_force(rows, weights=None, seed=mixing.SEED):
    sizes = Counter()
    for r in rows:
        sizes[r.source] += len(r.text or "")
    weight = {s: (math.sqrt(n) if weights is None else weights.get(s or "", 0.0)) for s, n in sizes.items()}
    out = Counter()
    for r in rows:
        rate = weight[r.source] / sum(weight.values()) * sum(sizes.values()) / sizes[r.source] if sizes[r.source] else 1.0
        steps = max(1, math.ceil(rate / mixing.MEAN_STEP))
        for step in range(1, steps + 1):
            u, mean = uniform(seed, r.doc_id, step), rate / steps
            p = total = math.exp(-mean)
            k = 0
            while total <= u and k < mean + 10 * math.sqrt(mean) + 20:
                k += 1
                p *= mean / k
                total += p
            out[(r.doc_id, r.source, r.text)] += k
    return +out


def check(spark, rows, weights=None):
    found = mixing.replicate(frame(spark, rows), weights)
    got = Counter((r.doc_id, r.source, r.text) for r in found.collect())
    assert got == brute_force(rows, weights)


def mixed_rows():
    rows = [document(i, " ".join(words(i, 20)), source="big") for i in range(600)]
    rows += [document(1000 + i, " ".join(words(i, 20)), source=f"s{i % 7}") for i in range(70)]
    return rows + [document(2000, "tiny", source="tiny")]


def test_counts(spark):
    check(spark, mixed_rows())
    check(spark, mixed_rows(), {"big": 1.0, "s1": 1.0, "tiny": 1.0})


def test_shares_reach_their_targets(spark):
    rows = mixed_rows()
    weights = {"big": 1.0} | {f"s{i}": 1.0 for i in range(7)}
    found = mixing.mix_sources(frame(spark, rows), weights).collect()
    sizes = Counter()
    for r in found:
        sizes[r.source] += len(r.text)
    assert abs(sizes["big"] / sum(sizes.values()) - 1 / 8) < 0.04
    assert "tiny" not in sizes
    keys = [r.shuffle_key for r in found]
    assert keys == sorted(keys) and len(set(keys)) == len(keys)


def test_wide_join_gives_the_same_rows(spark, monkeypatch):
    from knotwork.llm import common

    monkeypatch.setattr(common.sized_join, "__defaults__", ("left", 3))
    check(spark, mixed_rows())


def test_odd_rows(spark):
    check(spark, odd_documents())
    docs = clashing(frame(spark, odd_documents()))
    assert mixing.mix_sources(docs).columns == docs.columns
    assert mixing.mix_sources(frame(spark, [])).count() == 0
