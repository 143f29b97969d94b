"""Queries that write the bound tables in a file format and read them back."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import functions as F

from knotwork.functions.scalars import rounded
from knotwork.operators import features as feature_ops
from knotwork.operators.triples import entity_triples, labelled
from knotwork.plans.bindings import kg_triples, order_rules, patient_clusters, table, vectors, with_tables
from knotwork.plans.registry import query
from knotwork.session import scratch
from knotwork.sources import rdf, rdfxml, tables

KG = with_tables("kg")
COLUMNS = ["subj", "subj_kind", "pred", "obj", "obj_kind"]
IRI = "subj_kind = 'iri' AND obj_kind = 'iri' AND NOT contains(lower(pred), 'comment') AND NOT contains(lower(pred), 'label')"
# Text with quotes, line breaks and letters beyond ASCII.
NT_SQL = f"{KG} SELECT subj, subj_kind, pred, obj, obj_kind FROM kg UNION ALL SELECT 'http://example.org/kg#document_' || doc_id, 'iri', 'http://example.org/kg#text', text, 'literal' FROM documents"


def _documents(spark, sf):
    return table(spark, sf, "documents").select(
        F.concat(F.lit("http://example.org/kg#document_"), F.col("doc_id").cast("string")).alias("subj"),
        F.lit("iri").alias("subj_kind"),
        F.lit("http://example.org/kg#text").alias("pred"),
        F.col("text").alias("obj"),
        F.lit("literal").alias("obj_kind"),
    )


@query("read_ntriples", NT_SQL)
def _(spark, sf):
    path = rdf.write_ntriples(kg_triples(spark, sf).unionByName(_documents(spark, sf)))
    return rdf.read_ntriples(spark, path, strict=True).select(*COLUMNS)


GRAPH_SQL = f"{KG} SELECT subj, subj_kind, pred, obj, obj_kind FROM kg"


@query("read_rdfxml", GRAPH_SQL)
def _(spark, sf):
    """The short forms: typed nodes, property attributes, nodes inside of properties."""
    return _through_rdfxml(spark, kg_triples(spark, sf), _short_form)


@query("read_rdfxml_graph", GRAPH_SQL)
def _(spark, sf):
    return _through_rdfxml(spark, kg_triples(spark, sf), _description)


def _escaped(column):
    out = F.col(column)
    for found, meant in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("\r", "&#13;")):
        out = F.replace(out, F.lit(found), F.lit(meant))
    return out


def _about(side):
    """The attribute that names a node."""
    return F.concat(F.when(F.col(f"{side}_kind") == "bnode", "rdf:nodeID").otherwise("rdf:about"), F.lit('="'), _escaped(side), F.lit('"'))


def _property():
    return F.when(F.endswith("pred", F.lit("#type")), "rdf:type").otherwise(F.concat(F.lit("ex:"), F.substring_index("pred", "#", -1)))


def _description():
    """A description block for one triple; a subject may be described in several blocks."""
    name, obj = _property(), _escaped("obj")
    link = F.concat(F.lit("<"), name, F.when(F.col("obj_kind") == "iri", ' rdf:resource="').otherwise(' rdf:nodeID="'), obj, F.lit('"/>'))
    literal = F.concat(F.lit("<"), name, F.lit(">"), obj, F.lit("</"), name, F.lit(">"))
    element = F.when(F.col("obj_kind") == "literal", literal).otherwise(link)
    return F.concat(F.lit("<rdf:Description "), _about("subj"), F.lit(">"), element, F.lit("</rdf:Description>"))


def _short_form():
    """One triple as a typed node, an attribute or two nodes in one another."""
    name, local = _property(), F.substring_index("obj", "#", -1)
    typed = F.concat(F.lit("<ex:"), local, F.lit(" "), _about("subj"), F.lit("/>"))
    value = F.replace(F.replace(_escaped("obj"), F.lit("\n"), F.lit("&#10;")), F.lit("\t"), F.lit("&#9;"))
    attribute = F.concat(F.lit("<rdf:Description "), _about("subj"), F.lit(" "), name, F.lit('="'), value, F.lit('"/>'))
    inner = F.concat(F.lit("<"), name, F.lit("><rdf:Description "), _about("obj"), F.lit("/></"), name, F.lit(">"))
    nested = F.concat(F.lit("<rdf:Description "), _about("subj"), F.lit(">"), inner, F.lit("</rdf:Description>"))
    is_class = (name == "rdf:type") & (F.col("obj_kind") == "iri") & F.col("obj").rlike(r"^http://example\.org/kg#[A-Za-z_][\w.-]*$")
    return F.when(is_class, typed).when((F.col("obj_kind") == "literal") & (name != "rdf:type"), attribute).when(
        F.col("obj_kind") == "literal", _description()
    ).otherwise(nested)


def _through_rdfxml(spark, triples, form):
    """The triples written in a form of RDF/XML and read back; blank nodes are written by rdf:nodeID."""
    lines = triples.select(form().alias("value"))
    path = scratch(spark, "rdfxml")
    lines.mapInArrow(_document, lines.schema).write.text(path)
    return rdfxml.read_rdfxml(spark, path).select(*COLUMNS)


def _document(batches):
    """A root element around the blocks of each written file."""
    head = f'<rdf:RDF xmlns:rdf="{rdf.RDF_NAMESPACE}" xmlns:ex="http://example.org/kg#">'
    yield pa.RecordBatch.from_pydict({"value": [head]})
    yield from batches
    yield pa.RecordBatch.from_pydict({"value": ["</rdf:RDF>"]})


TSV_SQL = f"{KG} SELECT subj AS head, pred AS relation, obj AS tail FROM kg WHERE {IRI}"


@query("read_triples_tsv", TSV_SQL)
def _(spark, sf):
    path = rdf.write_triples_tsv(labelled(entity_triples(kg_triples(spark, sf))))
    return rdf.read_triples_tsv(spark, path)


@query("write_triples_tsv", TSV_SQL)
def _(spark, sf):
    path = rdf.write_triples_tsv(labelled(entity_triples(kg_triples(spark, sf))), header=True)
    return rdf.read_triples_tsv(spark, path, header=True)


@query("read_feature_table", f"{with_tables('rules')} SELECT key, orders, urgent FROM rules")
def _(spark, sf):
    rules = order_rules(spark, sf).withColumnRenamed("key", "patient_uri")
    rows = tables.read_feature_table(spark, tables.write_table(rules, "rules"))
    return feature_ops.numeric_rule_columns(rows.withColumn("key", F.col("key").cast("long")))


@query(
    "read_embedding_table",
    f"{with_tables('vectors')} SELECT key, CAST(i - 1 AS INTEGER) AS position, round(v, 6) AS value FROM (SELECT key, unnest(vec) AS v, generate_subscripts(vec, 1) AS i FROM vectors)",
)
def _(spark, sf):
    wide = vectors(spark, sf).select(F.col("key").alias("entity"), *[F.col("vec")[i].alias(f"emb_{i}") for i in range(64)])
    rows = tables.read_embedding_table(spark, tables.write_table(wide, "embeddings"))
    long = rows.select(F.col("key").cast("long").alias("key"), F.posexplode("vec").alias("position", "value"))
    return long.withColumn("value", rounded(F.col("value")))


@query("find_artifacts", "SELECT DISTINCT density_cluster AS cluster FROM (" + with_tables("clusters") + " SELECT * FROM clusters)")
def _(spark, sf):
    folder = scratch(spark, "artifacts")
    patient_clusters(spark, sf).write.partitionBy("density_cluster").parquet(folder)
    found = tables.find_artifacts(spark, folder, "*.parquet")
    return found.select(F.regexp_extract("path", r"density_cluster=(-?\d+)", 1).cast("int").alias("cluster")).distinct()


@query("write_tables", f"{with_tables('clusters')} SELECT key, community, density_cluster FROM clusters")
def _(spark, sf):
    path = tables.write_table(patient_clusters(spark, sf), "clusters", "json")
    return spark.read.json(path, schema="key string, community int, density_cluster int")


@query("write_vectors", f"{with_tables('vectors')} SELECT key, len(vec) AS width, round(list_sum(vec), 6) AS total FROM vectors")
def _(spark, sf):
    rows = tables.read_vectors(spark, tables.write_vectors(vectors(spark, sf)))
    total = F.aggregate("vec", F.lit(0.0), lambda acc, x: acc + x)
    return rows.select("key", F.size("vec").cast("long").alias("width"), rounded(total).alias("total"))
