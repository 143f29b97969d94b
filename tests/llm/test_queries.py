"""Registered queries against their SQL on the smallest tables, and the pipeline's stages."""

import math

import corpus_pipeline
import pytest
from cases import clashing, frame, odd_documents

from knotwork.llm import queries

FOLDER = "/root/testdata/sf0.001"


def cell(value):
    if value is None or isinstance(value, float) and math.isnan(value):
        return "none"
    return f"{value:.9g}" if isinstance(value, float) else str(value)


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query_equals_sql(spark, duck, name):
    found = queries.QUERIES[name](spark, FOLDER)
    columns = sorted(found.columns)
    result = duck.execute(queries.ORACLES[name])
    names = [d[0] for d in result.description]
    assert sorted(names) == columns
    wanted = sorted(tuple(cell(r[names.index(c)]) for c in columns) for r in result.fetchall())
    assert sorted(tuple(cell(r[c]) for c in columns) for r in found.collect()) == wanted


def test_one_query_for_each_operator():
    assert sorted(int(n.split("_")[0][2:]) for n in queries.QUERIES) == list(range(1, 14))


def test_pipeline(spark, tmp_path):
    documents = spark.read.parquet(f"{FOLDER}/documents.parquet")
    before = {r.doc_id for r in documents.select("doc_id").collect()}
    docs = documents
    for place, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, FOLDER).write.parquet(str(tmp_path / str(place)))
        docs = spark.read.parquet(str(tmp_path / str(place)))
        if place < len(corpus_pipeline.STAGES) - 1:
            assert docs.columns == documents.columns
        ids = {r.doc_id for r in docs.select("doc_id").collect()}
        assert ids and ids <= before
        before = ids
    assert sorted(docs.columns) == sorted(["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])


def test_stages_take_odd_and_empty_tables(spark):
    odd = frame(spark, odd_documents())
    for place, (name, stage) in enumerate(corpus_pipeline.STAGES):
        for docs in (odd, odd.limit(0), clashing(odd)):
            found = stage(spark, docs, FOLDER)
            if place < len(corpus_pipeline.STAGES) - 1:
                assert found.columns == docs.columns, name
            found.collect()
