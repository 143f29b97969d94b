"""Texts that files must give back as they were, null groups, kinds in patterns, one result for any size."""

import math

import pytest
from pyspark.sql import functions as F

from knotwork.functions.scalars import safe_float
from knotwork.operators import blocks, features, kge, metrics, patterns, sampling, vectors
from knotwork.operators.ordering import grouped_quantiles
from knotwork.sources import rdf, tables

TEXTS = ["line1\nline2", " sp ", "", "tab\there", "back\\slash \\n \\N", "\\N", 'say "x", y', "\x01m \x01b \x02", "cr\r\nlf", "ü \U0001f600", '"', "'", "#"]


def test_header_is_the_first_line_of_each_file_and_no_other(spark, tmp_path):
    (tmp_path / "a.tsv").write_text("h\tr\tt\n1\tp\t2\nhead\trelation\ttail\n")
    (tmp_path / "b.tsv").write_text("head\trelation\ttail\n3\tp\t4\n")
    (tmp_path / "c.tsv").write_text("".join(f"{i}\tq\t{i}\n" for i in range(3000)))
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
        found = [tuple(r) for r in rdf.read_triples_tsv(spark, str(tmp_path), header=True).collect()]
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    wanted = [("1", "p", "2"), ("head", "relation", "tail"), ("3", "p", "4")] + [(str(i), "q", str(i)) for i in range(1, 3000)]
    assert sorted(found) == sorted(wanted)


@pytest.mark.parametrize("header", [False, True])
def test_triples_tsv(spark, header):
    rows = [(f"h{i}", text, text) for i, text in enumerate(TEXTS)] + [("h", None, "t"), (" ", "", "")]
    table = spark.createDataFrame(rows, "head string, relation string, tail string")
    found = rdf.read_triples_tsv(spark, rdf.write_triples_tsv(table, header), header)
    assert sorted(map(tuple, found.collect()), key=str) == sorted(rows, key=str)


def test_feature_table(spark):
    # CSV has one sign for null, which no text may be.
    rows = [(f"k{i}", text, float(i)) for i, text in enumerate(TEXTS) if text != "\\N"] + [("n", None, None)]
    table = spark.createDataFrame(rows, "key string, note string, x double")
    found = tables.read_feature_table(spark, tables.write_table(table, "features"))
    assert sorted((r.key, r.note) for r in found.collect() if r.note is not None) == sorted((k, t) for k, t, _ in rows if t is not None)
    assert found.count() == len(rows)


def test_ntriples_marks_and_bad_lines(spark, tmp_path):
    rows = [("http://e/s", "iri", "http://e/p", text, "literal") for text in TEXTS]
    table = spark.createDataFrame(rows, "subj string, subj_kind string, pred string, obj string, obj_kind string")
    path = rdf.write_ntriples(table)
    assert sorted(r.obj for r in rdf.read_ntriples(spark, path).collect()) == sorted(TEXTS)
    bad = tmp_path / "bad.nt"
    bad.write_text("<http://e/s> <http://e/p> <http://e/o> .\n# note\n\nnot a triple\n")
    with pytest.raises(Exception, match="no triple"):
        rdf.read_ntriples(spark, str(bad), strict=True).collect()
    assert rdf.read_ntriples(spark, str(bad)).count() == 1
    assert [r.value for r in rdf.bad_ntriples(spark, str(bad)).collect()] == ["not a triple"]


def test_null_groups_stay(spark):
    rows = [(i, g, i % 2, float(i % 3)) for i in range(24) for g in ("a", None)]
    table = spark.createDataFrame(rows, "key long, g string, y int, score double")
    found = {r.g: r.roc_auc for r in metrics.roc_auc(table, ["g"]).collect()}
    assert found.keys() == {"a", None} and found["a"] == found[None]
    assert {r.g for r in grouped_quantiles(table, ["g"], "score", {"half": 0.5}).collect()} == {"a", None}
    scored = table.withColumn("probability", F.col("score") / 3)
    assert {r.g for r in metrics.evaluate(scored, ["g"]).collect()} == {"a", None}
    assert sampling.stratified_split(table, label="g").count() == len(rows)
    assert sampling.stratified_folds(table, label="g").count() == len(rows)


def test_patterns_tell_kinds_apart(spark):
    schema = "subj string, subj_kind string, pred string, obj string, obj_kind string"
    rows = [
        ("s", "iri", "p", "x", "literal"),
        ("s", "iri", "p", "y", "iri"),
        ("t", "iri", "p", "z", "bnode"),
        ("x", "iri", "q", "o", "iri"),
        ("y", "iri", "q", "o", "iri"),
        ("z", "iri", "q", "o", "iri"),
        ("z", "bnode", "q", "o", "iri"),
    ]
    graph = spark.createDataFrame(rows, schema)
    found = patterns.bgp_match(graph, [("?a", "p", "?b"), ("?b", "q", "?c")]).collect()
    assert sorted((r.a, r.b, r.b_kind) for r in found) == [("s", "y", "iri"), ("t", "z", "bnode")]
    found = patterns.bgp_match(graph, [("?a", "p", ("x", "iri"))]).collect()
    assert found == []


def test_patterns_tell_datatypes_and_languages_apart(spark):
    number, plain = "http://www.w3.org/2001/XMLSchema#int", patterns.PLAIN_TYPE
    schema = "subj string, subj_kind string, pred string, obj string, obj_kind string, obj_datatype string, obj_lang string"
    rows = [("a", "iri", "p", "1", "literal", *tag) for tag in ((number, None), (None, "en"), (None, None))]
    rows += [("b", "iri", "q", "1", "literal", *tag) for tag in ((number, None), (None, "EN"), (plain, None), (None, "de"))]
    graph = spark.createDataFrame(rows, schema)
    found = patterns.bgp_match(graph, [("?a", "p", "?x"), ("?b", "q", "?x")]).collect()
    assert sorted((r.a, r.b, r.x, r.x_tag) for r in found) == [("a", "b", "1", ""), ("a", "b", "1", "@en"), ("a", "b", "1", number)]
    assert sorted(found[0].asDict()) == ["a", "b", "x", "x_kind", "x_tag"]
    found = patterns.bgp_match(graph, [("?b", "q", ("1", "literal", "@de"))]).collect()
    assert [tuple(r) for r in found] == [("b",)]
    assert patterns.bgp_match(graph, [("?b", "q", ("1", "literal"))]).count() == 4


def test_nearest_centroid_is_one_path(spark, monkeypatch):
    points = spark.createDataFrame([(i, [float(i % 5), 0.0]) for i in range(300)], "key long, vec array<double>")
    for kind, names in (("int", [9, 10]), ("string", ["9", "10"])):
        centers = spark.createDataFrame([(names[0], [0.0, 1.0]), (names[1], [0.0, -1.0])], f"cluster {kind}, centroid array<double>")
        seen = []
        for rows in (1, 16_384):
            monkeypatch.setattr(blocks, "BLOCK_ROWS", rows * 50 if rows == 1 else rows)
            found = vectors.nearest_centroid(points, centers)
            assert dict(found.dtypes)["nearest"] == kind
            seen.append(sorted((r.key, r.nearest, r.nearest_distance) for r in found.collect()))
        assert seen[0] == seen[1]
        assert {n for _, n, _ in seen[0]} == {min(names)}


def test_numbers_with_blanks(spark):
    table = spark.createDataFrame([("\t1.5\n",), (" 2 ",), ("\x0b3e1",), ("1 2",)], "t string")
    assert [r[0] for r in table.select(safe_float(F.col("t"))).collect()] == [1.5, 2.0, 30.0, None]


def test_joins_refuse_repeated_keys(spark):
    rows = spark.createDataFrame([(1, 0)], "key long, y int")
    twice = spark.createDataFrame([(1, [1.0]), (1, [2.0])], "key long, vec array<double>")
    for join in (features.inner_join_align, features.left_join_dropna):
        with pytest.raises(ValueError, match="not unique"):
            join(rows, twice)


def test_best_candidate_takes_the_first_of_the_grid(spark):
    rows = spark.createDataFrame([("a", 0.5), ("b", 0.5), ("c", 0.4)], "candidate string, auc double")
    assert metrics.best_candidate(rows, grid=["b", "a", "c"]).first().candidate == "b"
    assert metrics.best_candidate(rows).first().candidate == "a"


def test_training_loss_falls_for_translation(spark):
    rows = [(i, 0, (i + 1) % 40) for i in range(40)] + [(i, 1, (i + 5) % 40) for i in range(40)]
    triples = spark.createDataFrame(rows, "head long, relation long, tail long")
    _, _, losses = kge.train_kge(triples, "transe", dim=16, epochs=40)
    assert losses[-1] < losses[0] and all(math.isfinite(x) for x in losses)
