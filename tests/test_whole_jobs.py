"""Registered queries run their operators as a whole: the library's own sizes, every row of the graph."""

import inspect

from knotwork.operators import kge, learn, stacking
from knotwork.plans import catalog
from knotwork.plans.bindings import kg_triples
from knotwork.plans.embedding_queries import graph_triples

FOLDER = "/root/testdata/sf0.001"


def given(function, seen):
    """A stand-in that notes the arguments, defaults included, and ends the query."""
    shape = inspect.signature(function)

    def stand_in(*args, **options):
        bound = shape.bind(*args, **options)
        bound.apply_defaults()
        seen.append(bound.arguments)
        raise InterruptedError

    return stand_in


def arguments(monkeypatch, spark, module, function, query):
    seen = []
    with monkeypatch.context() as patch:
        patch.setattr(module, function, given(getattr(module, function), seen))
        try:
            catalog.queries()[query](spark, FOLDER)
        except InterruptedError:
            pass
    return seen[0]


def test_training_takes_full_width_and_epochs(spark, monkeypatch):
    for query in ("train_kge", "patient_vectors"):
        found = arguments(monkeypatch, spark, kge, "train_kge", query)
        assert (found["dim"], found["epochs"]) == (64, 50) == (kge.DIM, kge.EPOCHS)


def test_forest_query_has_the_default_trees(spark, monkeypatch):
    found = arguments(monkeypatch, spark, learn, "forest", "clf_forest")
    assert (found["trees"], found["depth"]) == (500, None)


def test_rdfxml_gives_back_the_whole_graph(spark):
    found = catalog.queries()["read_rdfxml_graph"](spark, FOLDER)
    wanted = kg_triples(spark, FOLDER).select(*found.columns).distinct()
    assert found.exceptAll(wanted).count() == wanted.exceptAll(found).count() == 0
    assert found.filter("obj_kind = 'bnode'").count() > 0


def test_main_flow_has_a_row_for_each_trained_model(spark):
    rows = stacking.compare_embeddings(graph_triples(spark, FOLDER), ["rotate"], epochs=10).collect()
    patients = kg_triples(spark, FOLDER).filter("contains(subj, 'Patient_')").select("subj").distinct().count()
    assert [(r["model"], r["patients"], r["epochs"], r["dimension"]) for r in rows] == [("rotate", patients, 10, 128)]
    r = rows[0]
    assert r["communities"] > 1 and r["modularity"] > 0
    assert 0 <= r["noise_ratio"] <= 1 and -1 <= r["silhouette"] <= 1


def test_trained_models_rank_held_out_triples_far_above_chance(spark):
    """Most triples of this graph lead from an order to a patient drawn at random; the rest can be learnt."""
    rows = catalog.queries()["heldout_ranks"](spark, FOLDER).filter("side = 'both' and rank_type = 'realistic'").collect()
    found = {(r["model"], r["metric"]): r["value"] for r in rows}
    for model in ("transe", "rotate", "complex"):
        # Standard deviations above the mean of random ranks.
        assert found[model, "z_inverse_harmonic_mean_rank"] > 10
