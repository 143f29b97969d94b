"""Triples as a set: no task holds the triples of a whole split."""

from knotwork.operators import triples as ops
from knotwork.plans import catalog

FOLDER = "/root/testdata/sf0.001"


def test_parts_of_bounded_rows():
    assert [ops._parts(rows) for rows in (0, 5, 2**18, 2**27, 200 * 2**20)] == [1, 1, 2, 200, 200]
    assert ops._parts(2**40) == 2**20


def test_a_set_of_triples(spark):
    rows = [("a", "p", str(i % 7)) for i in range(5000)] + [("a", None, "0")] * 3 + [(f"s{i}", "p", "x") for i in range(50)] * 2
    triples = spark.createDataFrame(rows, ops.LABELLED).repartition(5)
    found = ops.distinct_triples(triples, rows=2**19)
    assert found.rdd.getNumPartitions() == 4
    assert len(found.collect()) == 58 and set(map(tuple, found.collect())) == set(rows)
    assert ops.distinct_triples(triples.limit(0), rows=0).collect() == []


def test_schema_triples_deals_before_it_aggregates(spark):
    plan = catalog.queries()["schema_triples"](spark, FOLDER)._jdf.queryExecution().executedPlan().toString()
    # Upper nodes come first: both aggregates of the whole triple stand above its exchange.
    above = plan[: plan.index("REPARTITION_BY_NUM")]
    assert above.count("HashAggregate(keys=[head") == 2
    assert "HashAggregate(keys=[head" not in plan[len(above) :]


def test_rdfxml_deals_before_it_aggregates(spark):
    for name in ("read_rdfxml", "read_rdfxml_graph"):
        plan = catalog.queries()[name](spark, FOLDER)._jdf.queryExecution().executedPlan().toString()
        above, _, below = plan.partition("REPARTITION_BY_NUM")

        def whole(text):
            return [line for line in text.splitlines() if "HashAggregate(keys=[" in line and "pred#" in line]

        assert len(whole(above)) == 2 and not whole(below)
