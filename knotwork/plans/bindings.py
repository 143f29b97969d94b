"""The driver tables seen as a knowledge graph, vectors, clusters and scored rows.

Each binding exists twice: as a DataFrame and as a SQL text for the check.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from knotwork.operators.triples import RDF_TYPE

NS = "http://example.org/kg#"
PATIENT_CLASS = f"{NS}Patient"
LABEL = f"{NS}segment"


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def _node(prefix: str, column: str) -> Column:
    return F.concat(F.lit(f"{NS}{prefix}_"), F.col(column).cast("string"))


def _edges(df: DataFrame, subj: Column, edges: list[tuple[str, Column, str]]) -> DataFrame:
    """Several triples from each row of one scan."""
    rows = [
        F.struct(
            subj.alias("subj"),
            F.lit("iri").alias("subj_kind"),
            F.lit(pred).alias("pred"),
            obj.cast("string").alias("obj"),
            F.lit(kind).alias("obj_kind"),
        )
        for pred, obj, kind in edges
    ]
    return df.select(F.inline(F.array(*rows)))


def customer_triples(spark: SparkSession, folder: str) -> DataFrame:
    customer = table(spark, folder, "customer")
    balance = F.col("c_acctbal")
    level = F.when(balance < 3000, "Low").when(balance < 7000, "Medium").otherwise("High")
    return _edges(
        customer,
        _node("Patient", "c_custkey"),
        [
            (RDF_TYPE, F.lit(PATIENT_CLASS), "iri"),
            (f"{NS}nation", _node("nation", "c_nationkey"), "iri"),
            (f"{NS}acctbal_Category", F.concat(F.lit(f"{NS}acctbal_"), level), "iri"),
            (f"{NS}acctbal", balance, "literal"),
            (f"{NS}nationkey", F.col("c_nationkey"), "literal"),
            (LABEL, F.col("c_mktsegment"), "literal"),
            (f"{NS}label", F.col("c_name"), "literal"),
        ],
    )


def kg_triples(spark: SparkSession, folder: str) -> DataFrame:
    """Customers as patients, nations, regions and orders."""
    nation = _edges(
        table(spark, folder, "nation"),
        _node("nation", "n_nationkey"),
        [
            (f"{NS}region", _node("region", "n_regionkey"), "iri"),
            (f"{NS}note", F.concat(F.lit("b"), F.col("n_regionkey").cast("string")), "bnode"),
        ],
    )
    orders = _edges(
        table(spark, folder, "orders"),
        _node("order", "o_orderkey"),
        [
            (f"{NS}placedBy", _node("Patient", "o_custkey"), "iri"),
            (f"{NS}totalprice", F.col("o_totalprice"), "literal"),
            (f"{NS}priority", F.col("o_orderpriority"), "literal"),
        ],
    )
    return reduce(DataFrame.unionByName, [customer_triples(spark, folder), nation, orders])


def patient_clusters(spark: SparkSession, folder: str) -> DataFrame:
    """key, x, y, community, density_cluster; one density label stands for noise."""
    nation = F.col("c_nationkey")
    return table(spark, folder, "customer").select(
        _node("Patient", "c_custkey").alias("key"),
        (nation % 5).alias("community"),
        F.when(nation % 7 == 6, -1).otherwise(nation % 7).alias("density_cluster"),
    )


def vectors(spark: SparkSession, folder: str) -> DataFrame:
    """key, vec, label, y."""
    return table(spark, folder, "embeddings").select(
        F.col("vec_id").alias("key"),
        F.col("embedding").cast("array<double>").alias("vec"),
        "label",
        (F.col("label") < 5).cast("int").alias("y"),
    )


def scored(spark: SparkSession, folder: str) -> DataFrame:
    """key, y, toxic, lang, score: length of a labelled document against its quality, ties included."""
    documents = table(spark, folder, "documents").select("doc_id", "lang", "n_chars")
    hundreds = F.floor(F.col("n_chars") / 100)
    return (
        table(spark, folder, "labels")
        .join(documents, "doc_id")
        .select(
            F.col("doc_id").alias("key"),
            F.col("quality").alias("y"),
            "toxic",
            "lang",
            (hundreds / (hundreds + 10)).alias("score"),
        )
    )


def customer_features(spark: SparkSession, folder: str) -> DataFrame:
    """key, y and two raw columns."""
    return table(spark, folder, "customer").select(
        F.col("c_custkey").alias("key"),
        (F.col("c_mktsegment") == "BUILDING").cast("int").alias("y"),
        F.col("c_acctbal").alias("balance"),
        F.col("c_nationkey").cast("double").alias("nation"),
    )


def supplier_clusters(spark: SparkSession, folder: str) -> DataFrame:
    """Clusters for the keys that are also suppliers; the others have none."""
    nation = F.col("s_nationkey")
    return table(spark, folder, "supplier").select(
        F.col("s_suppkey").alias("key"),
        (nation % 5).alias("community"),
        F.when(nation % 7 == 6, -1).otherwise(nation % 7).alias("density_cluster"),
    )


def order_rules(spark: SparkSession, folder: str) -> DataFrame:
    """Rule features of customers with orders: number of orders, number of urgent ones, and a text."""
    urgent = F.startswith(F.col("o_orderpriority"), F.lit("1"))
    return (
        table(spark, folder, "orders")
        .groupBy(F.col("o_custkey").alias("key"))
        .agg(
            F.count(F.lit(1)).cast("string").alias("orders"),
            F.when(F.count_if(urgent) > 0, F.count_if(urgent).cast("string")).otherwise("none").alias("urgent"),
            F.min("o_orderstatus").alias("status"),
        )
    )


CUSTOMER_SQL = f"""
 SELECT '{NS}Patient_' || c_custkey AS subj, 'iri' AS subj_kind, p.pred, p.obj, p.obj_kind
 FROM customer, LATERAL (VALUES
  ('{RDF_TYPE}', '{PATIENT_CLASS}', 'iri'),
  ('{NS}nation', '{NS}nation_' || c_nationkey, 'iri'),
  ('{NS}acctbal_Category', '{NS}acctbal_' || CASE WHEN c_acctbal < 3000 THEN 'Low' WHEN c_acctbal < 7000 THEN 'Medium' ELSE 'High' END, 'iri'),
  ('{NS}acctbal', CAST(c_acctbal AS VARCHAR), 'literal'),
  ('{NS}nationkey', CAST(c_nationkey AS VARCHAR), 'literal'),
  ('{LABEL}', c_mktsegment, 'literal'),
  ('{NS}label', c_name, 'literal')) AS p(pred, obj, obj_kind)"""

KG_SQL = f"""{CUSTOMER_SQL}
 UNION ALL
 SELECT '{NS}nation_' || n_nationkey, 'iri', p.pred, p.obj, p.obj_kind
 FROM nation, LATERAL (VALUES
  ('{NS}region', '{NS}region_' || n_regionkey, 'iri'),
  ('{NS}note', 'b' || n_regionkey, 'bnode')) AS p(pred, obj, obj_kind)
 UNION ALL
 SELECT '{NS}order_' || o_orderkey, 'iri', p.pred, p.obj, p.obj_kind
 FROM orders, LATERAL (VALUES
  ('{NS}placedBy', '{NS}Patient_' || o_custkey, 'iri'),
  ('{NS}totalprice', CAST(o_totalprice AS VARCHAR), 'literal'),
  ('{NS}priority', o_orderpriority, 'literal')) AS p(pred, obj, obj_kind)"""

CLUSTERS_SQL = f"""
 SELECT '{NS}Patient_' || c_custkey AS key, c_nationkey % 5 AS community,
  CASE WHEN c_nationkey % 7 = 6 THEN -1 ELSE c_nationkey % 7 END AS density_cluster
 FROM customer"""

VECTORS_SQL = """
 SELECT vec_id AS key, CAST(embedding AS DOUBLE[]) AS vec, label, CAST(label < 5 AS INTEGER) AS y FROM embeddings"""

SCORED_SQL = """
 SELECT doc_id AS key, quality AS y, toxic, lang, (n_chars // 100) / ((n_chars // 100) + 10) AS score
 FROM labels JOIN documents USING (doc_id)"""


FEATURES_SQL = """
 SELECT c_custkey AS key, CAST(c_mktsegment = 'BUILDING' AS INTEGER) AS y, c_acctbal AS balance, CAST(c_nationkey AS DOUBLE) AS nation FROM customer"""

SUPPLIER_CLUSTERS_SQL = """
 SELECT s_suppkey AS key, s_nationkey % 5 AS community, CASE WHEN s_nationkey % 7 = 6 THEN -1 ELSE s_nationkey % 7 END AS density_cluster FROM supplier"""

RULES_SQL = """
 SELECT o_custkey AS key, CAST(count(*) AS DOUBLE) AS orders, CAST(count_if(starts_with(o_orderpriority, '1')) AS DOUBLE) AS urgent FROM orders GROUP BY o_custkey"""


def with_tables(*names: str) -> str:
    """WITH clause for the named bindings."""
    texts = {
        "kg": KG_SQL,
        "clusters": CLUSTERS_SQL,
        "vectors": VECTORS_SQL,
        "scored": SCORED_SQL,
        "features": FEATURES_SQL,
        "supplier_clusters": SUPPLIER_CLUSTERS_SQL,
        "rules": RULES_SQL,
    }
    return "WITH " + ",\n".join(f"{name} AS ({texts[name]})" for name in names)
