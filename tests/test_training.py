"""How training holds its state, and that models are trained at the same time."""

import threading

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from knotwork.operators import kge, stacking
from knotwork.plans import catalog
from knotwork.plans.embedding_queries import graph_triples

FOLDER = "/root/testdata/sf0.001"


def test_packed_rows_come_back_from_slices_and_chunks(monkeypatch):
    monkeypatch.setattr(kge, "PACKED_ROWS", 4)
    values = np.arange(60, dtype=np.float32).reshape(10, 6) / 7
    column = kge.packed(values)
    assert column.num_chunks == 3
    assert (kge.unpacked(column) == values).all() and (kge.unpacked(column.slice(3, 5)) == values[3:8]).all()
    assert len(kge.unpacked(kge.packed(values[:0]))) == 0
    assert (kge.unpacked(pa.chunked_array([column.combine_chunks().slice(2, 3)])) == values[2:5]).all()


def meeting_of_three(monkeypatch):
    """A stand-in for training that goes on only when three models are trained at the same time."""
    gate = threading.Barrier(3)

    def train(triples, model, **_):
        gate.wait(60)
        raise InterruptedError(model)

    monkeypatch.setattr(kge, "train_kge", train)


def test_models_are_trained_side_by_side(spark, monkeypatch):
    meeting_of_three(monkeypatch)
    graph = graph_triples(spark, FOLDER)
    for way in (lambda: catalog.queries()["train_kge"](spark, FOLDER), lambda: stacking.heldout_ranks(graph), lambda: stacking.compare_embeddings(graph)):
        with pytest.raises(InterruptedError):
            way()


def test_a_visit_is_one_write(spark, monkeypatch):
    """Each visit adds one written table and reads nothing back to the driver."""
    ids = spark.range(40).select(F.col("id").alias("head"), (F.col("id") % 3).alias("relation"), ((F.col("id") * 7 + 1) % 40).alias("tail"))
    counts = []
    real = kge.cut
    monkeypatch.setattr(kge, "cut", lambda df: counts.append(1) or real(df))
    kge.train_kge(ids, "complex", dim=4, epochs=2, batch=8, buckets=4, passes=1)
    few = len(counts)
    counts.clear()
    kge.train_kge(ids, "complex", dim=4, epochs=6, batch=8, buckets=4, passes=1)
    assert len(counts) == few


def test_relations_without_triples_in_a_round_are_kept(spark):
    """One triple for each relation: most pairs of buckets have none of it."""
    rows = spark.createDataFrame([(i, i, i + 50) for i in range(12)], "head long, relation long, tail long")
    entities, relations, losses = kge.train_kge(rows, "rotate", dim=4, epochs=4, batch=4, buckets=8, passes=2)
    assert sorted(r.id for r in relations.collect()) == list(range(12))
    assert entities.count() == 24 and entities.select("id").distinct().count() == 24
    assert all(len(r.vec) == 4 for r in relations.collect()) and all(x > 0 for x in losses)


def test_a_forest_is_grown_in_parts_side_by_side(spark, monkeypatch):
    """All trees are grown, several fits at a time, and the probability is the mean over all of them."""
    from pyspark.ml import Pipeline

    from knotwork.operators import learn

    rng = np.random.default_rng(3)
    rows = [(i, int(v[0] > 0), [float(x) for x in v]) for i, v in enumerate(rng.normal(size=(80, 3)))]
    train = spark.createDataFrame(rows, "key long, y int, features array<double>").cache()
    gate, grown, real = threading.Barrier(3), [], Pipeline.fit

    def fit(self, *args):
        gate.wait(60)
        grown.append(real(self, *args))
        return grown[-1]

    monkeypatch.setattr(learn, "PART_TREES", 3)
    with monkeypatch.context() as patch:
        patch.setattr(Pipeline, "fit", fit)
        score = learn.forest(trees=8)(train)
    forests = [model.stages[-1] for model in grown]
    assert sorted(f.getNumTrees for f in forests) == [2, 3, 3]
    vectors = learn._vectors(train)
    found = {r.key: r.probability for r in score(train).collect()}
    total = {r.key: 0.0 for r in train.collect()}
    for forest in forests:
        for r in forest.transform(vectors).collect():
            total[r.key] += r._probability[1] * forest.getNumTrees / 8
    assert found == pytest.approx(total)
    assert np.mean([(p > 0.5) == (rows[k][1] == 1) for k, p in found.items()]) > 0.95
