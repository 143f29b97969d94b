"""What the readers of triples hold and repeat."""

import pyarrow as pa
import pytest

from knotwork.sources import rdf, rdfxml

HEAD = f'<rdf:RDF xmlns:rdf="{rdf.RDF_NAMESPACE}" xmlns:e="http://e/">'


def test_triples_of_many_elements_leave_in_bounded_batches(monkeypatch):
    monkeypatch.setattr(rdfxml, "BATCH_ROWS", 20)
    texts = ["".join(f'<rdf:Description rdf:about="s{i}_{j}"><e:p>{j}</e:p></rdf:Description>' for j in range(6)) for i in range(50)]
    batch = pa.RecordBatch.from_pydict({"file": ["f"] * 50, "start": list(range(50)), "number": [0] * 50, "head": [HEAD] * 50, "text": texts})
    sizes, subjects = [], []
    for out in rdfxml.parsed(iter([batch, batch.slice(0, 0)])):
        sizes.append(out.num_rows)
        subjects += out.column(0).to_pylist()
    assert max(sizes) < 20 + 6
    assert subjects == [f"s{i}_{j}" for i in range(50) for j in range(6)]


LINES = [
    ('<http://a> <http://p> <> .', ("http://a", "iri", "http://p", "", "iri", None, None)),
    ('<http://a> <http://p> "" .', ("http://a", "iri", "http://p", "", "literal", None, None)),
    ('_:x <http://p> _:y.z .', ("x", "bnode", "http://p", "y.z", "bnode", None, None)),
    ('<http://a> <http://p> "a\\"b\\\\n\\n\\u00e9"@de-AT . # c', ("http://a", "iri", "http://p", 'a"b\\n\né', "literal", None, "de-AT")),
    ('<http://\\u00e9> <http://p> "1"^^<http://t> .\u2028', ("http://é", "iri", "http://p", "1", "literal", "http://t", None)),
    ('<http://a> <http://p> "m\u0001s\u0001m$1" .', ("http://a", "iri", "http://p", "m\u0001s\u0001m$1", "literal", None, None)),
]


def test_ntriples_lines_of_all_kinds(spark):
    rows = spark.createDataFrame([(line,) for line, _ in LINES] + [("",), ("# c",), ("\u0001s broken",)], "value string")
    triples, bad = rdf.parse_ntriples(rows)
    assert sorted(map(str, map(tuple, triples.collect()))) == sorted(map(str, (t for _, t in LINES)))
    assert [r.value for r in bad.collect()] == ["\u0001s broken"]
    with pytest.raises(Exception, match="no triple"):
        rdf.parse_ntriples(rows, strict=True)[0].collect()


@pytest.mark.parametrize("strict", [False, True])
def test_a_line_is_matched_once(spark, tmp_path, strict):
    (tmp_path / "g.nt").write_text("<http://a> <http://p> <http://b> .\n")
    frame = rdf.read_ntriples(spark, str(tmp_path), strict=strict)
    assert len(frame.collect()) == 1
    # The form of the object stands in the plan as often as a line is matched.
    assert frame._jdf.queryExecution().optimizedPlan().toString().count("A-Za-z0-9-") == 1
