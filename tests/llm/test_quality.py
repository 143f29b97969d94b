"""Quality: held-out separation, the size of the draw, odd rows."""

import numpy as np
from cases import LABELS, clashing, document, frame, odd_documents, words

from knotwork.llm import common, quality


def corpus(count=400):
    rows, labels = [], []
    for i in range(count):
        junk = i % 5 == 0
        text = " ".join(f"{w.upper()}!!" if i % 2 else f"{w}%%%" for w in words(i, 60)) if junk else " ".join(words(i, 3 + i % 90)) + "."
        rows.append(document(i, text))
        if i % 2 == 0 or i % 3 == 0:
            labels.append((i, 0 if junk else 1, 0))
    return rows, labels


def test_rejects_junk_and_keeps_clean(spark):
    rows, labels = corpus()
    found = quality.importance_resample(frame(spark, rows), spark.createDataFrame(labels, LABELS)).collect()
    assert len(found) == len(rows)
    taught = {d for d, _, _ in labels}
    for r in found:
        assert r.selected == (r.doc_id % 5 != 0), (r, r.doc_id in taught)


def test_weights_equal_direct_sums(spark):
    import pyarrow as pa

    texts = ["the cat, the dog!", "", None, "a  b\n c"]
    single, owner, pair, pair_owner = quality.ngram_buckets(pa.array(texts), 64)
    assert np.bincount(owner, minlength=4).tolist() == [6, 0, 0, 3]
    assert np.bincount(pair_owner, minlength=4).tolist() == [5, 0, 0, 2]
    ratios = quality.log_ratios(np.array([3.0, 1.0]), np.array([1.0, 1.0]))
    assert np.allclose(ratios, np.log([2 / 4, 2 / 4]) - np.log([4 / 6, 2 / 6]))


def test_best_cut():
    weights = np.array([-5.0, -4.0, -1.0, 0.0, 1.0, 2.0])
    assert quality.best_cut(weights, np.array([False, False, True, False, True, True])) == -2.5
    assert quality.best_cut(weights, np.array([False, True, False, False, True, True]), good_cost=1) == 0.5
    assert quality.best_cut(weights, np.array([False, True, False, False, True, True]), good_cost=5) == -4.5
    assert quality.best_cut(weights, np.ones(6, bool)) == -np.inf


def test_kth_largest(spark):
    values = [((i * 7919) % 1000) / 10 for i in range(3000)] + [5.0] * 500
    table = spark.createDataFrame([(v,) for v in values], "x double")
    for k in (1, 2, 499, 1500, 3499, 3500):
        assert common.kth_largest(table, "x", k, bins=16) == sorted(values, reverse=True)[k - 1]


def test_odd_rows_and_columns(spark):
    docs = clashing(frame(spark, odd_documents()))
    labels = spark.createDataFrame([(6, 1, 0), (9, 0, 0), (None, 1, 0), (4, None, 1), (6, 1, 0)], LABELS)
    found = quality.importance_resample(docs, labels).collect()
    assert len(found) == len(odd_documents())
    assert {r.log_weight for r in found if r.doc_id in (1, 2, 3)} == {0.0}
    assert quality.keep_quality(docs, labels).columns == docs.columns
    none = spark.createDataFrame([], LABELS)
    assert quality.keep_quality(docs, none).count() == len(odd_documents())
    assert quality.importance_resample(frame(spark, []), labels).count() == 0
