"""Queries on the triples table: literals, selection, patterns, explanation, scalar functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from knotwork.functions import arrays, scalars
from knotwork.operators import explain, patterns, triples as ops
from knotwork.plans.bindings import (
    LABEL,
    NS,
    PATIENT_CLASS,
    customer_triples,
    kg_triples,
    patient_clusters,
    table,
    vectors,
    with_tables,
)
from knotwork.plans.registry import query

KG = with_tables("kg")
LOCAL = "CASE WHEN contains({0}, '#') THEN regexp_extract({0}, '[^#]*$') ELSE regexp_extract({0}, '[^/]*$') END"
NUMBER = r"regexp_matches(trim({0}), '^[+-]?([0-9]+(_[0-9]+)*([.]([0-9]+(_[0-9]+)*)?)?|[.][0-9]+(_[0-9]+)*)([eE][+-]?[0-9]+(_[0-9]+)*)?$')"
FLOAT = f"CASE WHEN {NUMBER} THEN TRY_CAST(replace(trim({{0}}), '_', '') AS DOUBLE) END"
RELATION = LOCAL.format("pred")

# Thresholds and buckets of every numeric literal, by SQL.
BUCKETS = f"""{KG},
nums AS (SELECT subj, obj_kind, {RELATION} AS relation, {FLOAT.format('obj')} AS value FROM kg WHERE obj_kind <> 'iri'),
cuts AS (SELECT relation, count(*) AS n,
  CASE WHEN count(*) >= 10 THEN quantile_cont(value, 0.3333333333333333::DOUBLE) WHEN count(*) >= 3 THEN quantile_cont(value, 0.33::DOUBLE) ELSE min(value) END AS q1,
  CASE WHEN count(*) >= 10 THEN quantile_cont(value, 0.6666666666666666::DOUBLE) WHEN count(*) >= 3 THEN quantile_cont(value, 0.66::DOUBLE) ELSE max(value) END AS q2
 FROM nums WHERE value IS NOT NULL AND obj_kind = 'literal' AND starts_with({LOCAL.format('subj')}, 'Patient_') GROUP BY relation),
buckets AS (SELECT subj, n.relation, value, CASE WHEN value <= coalesce(q1, value) THEN 'Low' WHEN value <= coalesce(q2, value) THEN 'Med' ELSE 'High' END AS level
 FROM nums n LEFT JOIN cuts USING (relation) WHERE value IS NOT NULL)"""
EXPAND = f"""SELECT head, e.relation, tail FROM (SELECT subj, relation AS rel, level,
   'MEAS::' || {LOCAL.format('subj')} || '::' || relation AS meas, 'ATTR::' || relation AS attr, 'CAT::' || relation || '::' || level AS cat FROM buckets) b,
  LATERAL (VALUES (subj, 'hasMeasurement', meas), (meas, 'measurementType', attr), (meas, 'hasCategory', cat),
   (attr, 'instanceOf', 'Attribute'), (cat, 'instanceOf', 'Category'), (cat, 'categoryLevel', level)) AS e(head, relation, tail)"""
TOKENS = f"""SELECT subj AS head, {RELATION} AS relation, 'LIT::' || {RELATION} || '::' || substr(sha1(obj), 1, 10) AS tail
  FROM kg WHERE obj_kind <> 'iri' AND ({FLOAT.format('obj')}) IS NULL"""
IRI_EDGES = f"SELECT subj AS head, {RELATION} AS relation, obj AS tail FROM kg WHERE obj_kind = 'iri'"


@query(
    "entity_triples",
    f"{KG} SELECT subj, subj_kind, pred, obj, obj_kind FROM kg WHERE subj_kind = 'iri' AND obj_kind = 'iri' "
    "AND NOT contains(lower(pred), 'comment') AND NOT contains(lower(pred), 'label')",
)
def _(spark, sf):
    return ops.entity_triples(kg_triples(spark, sf))


@query(
    "drop_predicates_like",
    f"{KG} SELECT pred, obj_kind, count(*) AS n FROM kg WHERE NOT contains(lower(pred), 'comment') AND NOT contains(lower(pred), 'label') GROUP BY ALL",
)
def _(spark, sf):
    kept = ops.drop_predicates_like(kg_triples(spark, sf))
    return kept.groupBy("pred", "obj_kind").agg(F.count(F.lit(1)).alias("n"))


@query("drop_rdf_type", f"{KG} SELECT * FROM kg WHERE pred <> '{ops.RDF_TYPE}'")
def _(spark, sf):
    return ops.drop_rdf_type(kg_triples(spark, sf))


@query(
    "literals_as_nodes",
    f"{KG} SELECT subj AS head, pred AS relation, CASE obj_kind WHEN 'literal' THEN 'lit:' || obj WHEN 'bnode' THEN '_:' || obj ELSE obj END AS tail FROM kg",
)
def _(spark, sf):
    return ops.literals_as_nodes(kg_triples(spark, sf))


@query("literal_drop", f"{KG} {IRI_EDGES}")
def _(spark, sf):
    return ops.literal_drop(kg_triples(spark, sf))


@query(
    "literal_entity",
    f"{KG} SELECT subj AS head, {RELATION} AS relation, CASE WHEN obj_kind = 'iri' THEN obj ELSE 'LIT::' || {RELATION} || '::' || substr(sha1(obj), 1, 10) END AS tail FROM kg",
)
def _(spark, sf):
    return ops.literal_entity(kg_triples(spark, sf))


@query(
    "literal_auto",
    f"""{BUCKETS}, share AS (SELECT avg(CAST(obj_kind = 'literal' AS INTEGER)) > 0.5 AS many FROM kg)
 SELECT * FROM ({IRI_EDGES}) UNION ALL SELECT * FROM ({EXPAND}) WHERE (SELECT many FROM share) UNION ALL SELECT * FROM ({TOKENS}) WHERE (SELECT many FROM share)""",
)
def _(spark, sf):
    return ops.convert_literals(kg_triples(spark, sf), "auto")


@query("literal_thresholds", f"{BUCKETS} SELECT relation, n, round(q1, 6) AS q1, round(q2, 6) AS q2 FROM cuts")
def _(spark, sf):
    cuts = ops.literal_thresholds(kg_triples(spark, sf))
    return cuts.select("relation", "n", scalars.rounded(F.col("q1")).alias("q1"), scalars.rounded(F.col("q2")).alias("q2"))


@query("literal_bucket", f"{BUCKETS} SELECT subj, relation, value, level FROM buckets")
def _(spark, sf):
    kg = kg_triples(spark, sf)
    buckets = ops.literal_bucket(ops.numeric_literals(kg), ops.literal_thresholds(kg))
    return buckets.select("subj", "relation", "value", "level")


@query("measurement_expand", f"{BUCKETS} {EXPAND}")
def _(spark, sf):
    kg = kg_triples(spark, sf)
    return ops.measurement_expand(ops.literal_bucket(ops.numeric_literals(kg), ops.literal_thresholds(kg)))


@query("nonnumeric_token", f"{KG} {TOKENS}")
def _(spark, sf):
    return ops.nonnumeric_token(kg_triples(spark, sf))


@query(
    "schema_triples",
    f"""{BUCKETS} SELECT DISTINCT * FROM ({IRI_EDGES} UNION ALL {EXPAND} UNION ALL {TOKENS}
 UNION ALL SELECT * FROM (VALUES ('Patient', 'subClassOf', 'Entity'), ('Measurement', 'subClassOf', 'Entity'), ('Attribute', 'subClassOf', 'Entity'), ('Category', 'subClassOf', 'Entity'),
  ('Low', 'instanceOf', 'Category'), ('Med', 'instanceOf', 'Category'), ('High', 'instanceOf', 'Category')) AS s(head, relation, tail))""",
)
def _(spark, sf):
    kg = kg_triples(spark, sf)
    return ops.distinct_triples(ops.categorize(kg, schema_relations=True), rows=kg.count())


@query(
    "conversion_stats",
    f"""{KG}, c AS (SELECT count(*) AS total_triples, count_if(obj_kind <> 'iri') AS others, count_if(obj_kind = 'literal') AS lits,
  count_if(obj_kind = 'literal' AND {NUMBER.format('obj')}) AS num, count_if(obj_kind <> 'iri' AND {NUMBER.format('obj')}) AS measured FROM kg)
 SELECT total_triples, CAST(CASE WHEN lits / total_triples > 0.5 THEN total_triples + 5 * measured ELSE total_triples - others END AS BIGINT) AS kept_triples,
  CAST(CASE WHEN lits / total_triples > 0.5 THEN 0 ELSE others END AS BIGINT) AS dropped_literal_triples,
  CASE WHEN lits / total_triples > 0.5 THEN 'categorize' ELSE 'drop' END AS literal_strategy,
  CAST(num AS BIGINT) AS numeric_literal_triples, CAST(lits - num AS BIGINT) AS nonnumeric_literal_triples FROM c""",
)
def _(spark, sf):
    return ops.conversion_stats(kg_triples(spark, sf))


@query("select_patients", f"{KG} SELECT DISTINCT subj FROM kg WHERE starts_with({LOCAL.format('subj')}, 'Patient_')")
def _(spark, sf):
    return ops.select_patients(kg_triples(spark, sf), match="local_prefix", fallback_below=2)


@query(
    "base_namespace",
    f"{KG} SELECT coalesce(min(coalesce(nullif(regexp_extract(subj, '^[^#]*#'), ''), nullif(regexp_extract(subj, '^.*/'), ''))), '{ops.DEFAULT_NAMESPACE}') AS namespace FROM kg WHERE subj_kind = 'iri'",
)
def _(spark, sf):
    return ops.base_namespace(kg_triples(spark, sf))


@query(
    "resolve_predicate",
    f"""SELECT event_type AS name, CASE WHEN starts_with(event_type, 'http://') OR starts_with(event_type, 'https://') THEN event_type ELSE '{NS}' || event_type END AS predicate, count(*) AS n FROM events GROUP BY ALL
 UNION ALL SELECT url, CASE WHEN starts_with(url, 'http://') OR starts_with(url, 'https://') THEN url ELSE '{NS}' || url END, count(*) FROM pages GROUP BY ALL""",
)
def _(spark, sf):
    names = table(spark, sf, "events").select(F.col("event_type").alias("name"))
    names = names.unionAll(table(spark, sf, "pages").select("url"))
    counted = names.groupBy("name").agg(F.count(F.lit(1)).alias("n"))
    return counted.select("name", ops.resolve_predicate(F.col("name"), F.lit(NS)).alias("predicate"), "n")


@query(
    "category_filter",
    f"""{KG} SELECT 'suffix' AS mode, pred, obj, count(*) AS n FROM kg WHERE starts_with(obj, 'http') AND (ends_with(obj, '_High') OR ends_with(obj, '_Medium') OR ends_with(obj, '_Low')) GROUP BY ALL
 UNION ALL SELECT 'loose', pred, obj, count(*) FROM kg WHERE obj_kind <> 'literal' AND regexp_matches(lower(obj), 'low|med|medium|high') GROUP BY ALL""",
)
def _(spark, sf):
    kg = kg_triples(spark, sf)

    def counted(mode):
        rows = ops.category_filter(kg, mode).groupBy("pred", "obj").agg(F.count(F.lit(1)).alias("n"))
        return rows.select(F.lit(mode).alias("mode"), "pred", "obj", "n")

    return counted("suffix").unionByName(counted("loose"))


BGP = [("?patient", ops.RDF_TYPE, PATIENT_CLASS), ("?patient", f"{NS}nation", "?nation"), ("?nation", f"{NS}region", "?region")]


@query(
    "bgp_match",
    f"""{KG} SELECT a.subj AS patient, b.obj AS nation, c.obj AS region FROM kg a JOIN kg b ON a.subj = b.subj JOIN kg c ON b.obj = c.subj
 WHERE a.pred = '{ops.RDF_TYPE}' AND a.obj = '{PATIENT_CLASS}' AND b.pred = '{NS}nation' AND c.pred = '{NS}region'""",
)
def _(spark, sf):
    return patterns.bgp_match(kg_triples(spark, sf), BGP).select("patient", "nation", "region")


@query(
    "lookup_spo",
    f"{KG} SELECT subj, pred, obj, obj_kind FROM kg WHERE (subj, pred) IN (SELECT '{NS}Patient_' || o_custkey, '{NS}acctbal' FROM orders)",
)
def _(spark, sf):
    patient = F.concat(F.lit(f"{NS}Patient_"), F.col("o_custkey").cast("string"))
    keys = table(spark, sf, "orders").select(patient.alias("subj"), F.lit(f"{NS}acctbal").alias("pred"))
    return patterns.lookup_spo(kg_triples(spark, sf), keys).select("subj", "pred", "obj", "obj_kind")


KG_CLUSTERS = with_tables("kg", "clusters")


@query(
    "cluster_triples_join",
    f"{KG_CLUSTERS} SELECT community AS cluster, subj, pred, obj FROM kg JOIN clusters ON key = subj WHERE contains(key, 'Patient_')",
)
def _(spark, sf):
    joined = patterns.cluster_triples_join(patient_clusters(spark, sf), kg_triples(spark, sf))
    return joined.select("cluster", "subj", "pred", "obj")


@query("semi_members", f"{KG_CLUSTERS} SELECT subj, pred, obj FROM kg WHERE subj IN (SELECT key FROM clusters WHERE density_cluster = -1)")
def _(spark, sf):
    noise = patient_clusters(spark, sf).filter(F.col("density_cluster") == -1)
    return patterns.semi_members(kg_triples(spark, sf), noise).select("subj", "pred", "obj")


@query(
    "threshold_join",
    f"""{BUCKETS} SELECT relation, count(*) AS n, CAST(count_if(q1 IS NULL) AS BIGINT) AS without_cuts, round(coalesce(max(q2 - q1), -1), 6) AS width
 FROM (SELECT n.relation, q1, q2 FROM nums n LEFT JOIN cuts USING (relation) WHERE value IS NOT NULL) GROUP BY relation""",
)
def _(spark, sf):
    kg = kg_triples(spark, sf)
    joined = ops.threshold_join(ops.numeric_literals(kg), ops.literal_thresholds(kg))
    return joined.groupBy("relation").agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if(F.col("q1").isNull()).alias("without_cuts"),
        scalars.rounded(F.coalesce(F.max(F.col("q2") - F.col("q1")), F.lit(-1.0))).alias("width"),
    )


@query(
    "cluster_category_counts",
    f"""{KG_CLUSTERS} SELECT community AS cluster, obj AS category, count(*) AS n FROM kg JOIN clusters ON key = subj
 WHERE starts_with(obj, 'http') AND (ends_with(obj, '_High') OR ends_with(obj, '_Medium') OR ends_with(obj, '_Low')) GROUP BY ALL""",
)
def _(spark, sf):
    return explain.cluster_category_counts(patient_clusters(spark, sf), kg_triples(spark, sf))


EDGE_COUNTS = """SELECT community AS cluster, pred, obj, count(*) AS n FROM kg JOIN clusters ON key = subj
 WHERE obj_kind <> 'literal' AND regexp_matches(lower(obj), 'low|med|medium|high') GROUP BY ALL"""


@query("cluster_edge_counts", f"{KG_CLUSTERS} {EDGE_COUNTS}")
def _(spark, sf):
    return explain.cluster_edge_counts(patient_clusters(spark, sf), kg_triples(spark, sf))


@query(
    "sparql_top_categories",
    f"""{KG} SELECT obj AS category, count(*) AS n FROM kg WHERE contains(subj, 'Patient_') AND (contains(obj, '_High') OR contains(obj, '_Medium') OR contains(obj, '_Low'))
 GROUP BY obj ORDER BY n DESC, obj LIMIT 20""",
)
def _(spark, sf):
    return patterns.top_categories(kg_triples(spark, sf))


@query(
    "sparql_label_distribution",
    f"{KG} SELECT obj AS label_value, count(*) AS n FROM kg WHERE pred = '{LABEL}' AND contains(subj, 'Patient_') GROUP BY obj",
)
def _(spark, sf):
    return patterns.label_distribution(kg_triples(spark, sf), LABEL)


TYPED = f"FROM kg a JOIN kg b ON a.subj = b.subj WHERE a.pred = '{ops.RDF_TYPE}' AND a.obj = '{PATIENT_CLASS}' AND b.obj_kind = 'iri'"


@query(
    "sparql_feature_category",
    f"{KG} SELECT b.pred AS feature, b.obj AS category, count(*) AS n {TYPED} AND regexp_matches(b.obj, '(?i)Low|Med|Medium|High') GROUP BY ALL ORDER BY n DESC, feature, category LIMIT 30",
)
def _(spark, sf):
    return patterns.feature_categories(kg_triples(spark, sf), PATIENT_CLASS)


@query(
    "sparql_high_examples",
    f"{KG} SELECT a.subj AS patient, b.pred AS feature, b.obj AS category {TYPED} AND regexp_matches(b.obj, '(?i)High') ORDER BY ALL LIMIT 50",
)
def _(spark, sf):
    return patterns.high_examples(kg_triples(spark, sf), PATIENT_CLASS)


PLAIN_COUNTS = "SELECT community AS cluster, pred, obj, count(*) AS n FROM kg JOIN clusters ON key = subj GROUP BY ALL"


@query(
    "topk_per_cluster",
    f"""{KG_CLUSTERS}, counts AS ({PLAIN_COUNTS})
 SELECT *, row_number() OVER (PARTITION BY cluster ORDER BY n DESC, pred, obj) AS place FROM counts QUALIFY place <= 15""",
)
def _(spark, sf):
    joined = patterns.cluster_triples_join(patient_clusters(spark, sf), kg_triples(spark, sf))
    counts = joined.groupBy("cluster", "pred", "obj").agg(F.count(F.lit(1)).alias("n"))
    return explain.topk_per_cluster(counts).withColumn("place", F.col("place").cast("long"))


@query(
    "order_limit",
    "SELECT p_type, p_brand, count(*) AS n FROM part GROUP BY ALL ORDER BY n DESC, p_type, p_brand LIMIT 30",
)
def _(spark, sf):
    counts = table(spark, sf, "part").groupBy("p_type", "p_brand").agg(F.count(F.lit(1)).alias("n"))
    return explain.order_limit(counts, "n", ["p_type", "p_brand"], 30)


@query(
    "distinct_triples",
    f"""SELECT DISTINCT '{NS}order_' || l_orderkey AS head, '{NS}suppliedBy' AS relation, '{NS}supplier_' || l_suppkey AS tail FROM lineitem""",
)
def _(spark, sf):
    edges = table(spark, sf, "lineitem").select(
        F.concat(F.lit(f"{NS}order_"), F.col("l_orderkey").cast("string")).alias("head"),
        F.lit(f"{NS}suppliedBy").alias("relation"),
        F.concat(F.lit(f"{NS}supplier_"), F.col("l_suppkey").cast("string")).alias("tail"),
    )
    return ops.distinct_triples(edges)


@query("distinct_subjects", f"{KG} SELECT DISTINCT subj FROM kg")
def _(spark, sf):
    return ops.distinct_subjects(kg_triples(spark, sf))


# Scalar functions


@query(
    "local_name",
    f"""{KG}, names AS (SELECT subj AS iri FROM kg UNION SELECT pred FROM kg UNION SELECT url FROM pages) SELECT iri, {LOCAL.format('iri')} AS name FROM names""",
)
def _(spark, sf):
    kg = kg_triples(spark, sf)
    names = kg.select(F.col("subj").alias("iri")).union(kg.select("pred")).union(table(spark, sf, "pages").select("url"))
    return names.distinct().select("iri", scalars.local_name(F.col("iri")).alias("name"))


@query("stable_hash", "SELECT doc_id, substr(sha1(text), 1, 10) AS hash FROM documents")
def _(spark, sf):
    return table(spark, sf, "documents").select("doc_id", scalars.stable_hash(F.col("text")).alias("hash"))


@query(
    "text_predicates",
    """SELECT doc_id, contains(text, 'the') AS has, starts_with(text, 'É') AS starts, ends_with(text, '.') AS ends,
 regexp_matches(text, '(?i)que') AS matches, starts_with(lower(text), 'é') AS lower_starts, starts_with(source, 'http') AS is_iri FROM documents""",
)
def _(spark, sf):
    text = F.col("text")
    return table(spark, sf, "documents").select(
        "doc_id",
        F.contains(text, F.lit("the")).alias("has"),
        F.startswith(text, F.lit("É")).alias("starts"),
        F.endswith(text, F.lit(".")).alias("ends"),
        text.rlike("(?i)que").alias("matches"),
        F.startswith(F.lower(text), F.lit("é")).alias("lower_starts"),
        F.startswith(F.col("source"), F.lit("http")).alias("is_iri"),
    )


# The forms around each number exercise what Python's float() takes and refuses.
FORMS = ["{}", " {} ", "{}f", "{}d", "1_{}", "{}e2", "{}_", "+{}", "nan{}", "{}."]


@query(
    "safe_float",
    "SELECT c_custkey, form, {} AS value FROM (SELECT c_custkey, unnest(list_transform([{}], lambda f: replace(f, '{{}}', CAST(c_acctbal AS VARCHAR)))) AS form FROM customer)".format(
        FLOAT.format("form"), ", ".join(f"'{form}'" for form in FORMS)
    ),
)
def _(spark, sf):
    balance = F.col("c_acctbal").cast("string")
    forms = F.array(*[F.replace(F.lit(form), F.lit("{}"), balance) for form in FORMS])
    rows = table(spark, sf, "customer").select("c_custkey", F.explode(forms).alias("form"))
    return rows.withColumn("value", scalars.safe_float(F.col("form")))


@query(
    "similarity_weight",
    "SELECT event_id, round(1.0::DOUBLE / (1.0::DOUBLE + abs(value)), 6) AS weight FROM events",
)
def _(spark, sf):
    weight = scalars.similarity_weight(F.abs("value"))
    return table(spark, sf, "events").select("event_id", scalars.rounded(weight).alias("weight"))


@query(
    "sigmoid_clip",
    "SELECT c_custkey, round(greatest(1e-7::DOUBLE, least(1 - 1e-7::DOUBLE, 1.0::DOUBLE / (1 + exp(-(c_acctbal - 4500) / 100)))), 9) AS p FROM customer",
)
def _(spark, sf):
    logit = (F.col("c_acctbal") - 4500) / 100
    return table(spark, sf, "customer").select("c_custkey", scalars.rounded(scalars.sigmoid_clip(logit), 9).alias("p"))


@query("threshold_label", "SELECT event_id, CAST(value / 100 >= 0.5::DOUBLE AS INTEGER) AS label FROM events")
def _(spark, sf):
    return table(spark, sf, "events").select("event_id", scalars.threshold_label(F.col("value") / 100).alias("label"))


@query("binary_label", "SELECT c_custkey, CAST(c_mktsegment = 'BUILDING' AS INTEGER) AS y FROM customer")
def _(spark, sf):
    return table(spark, sf, "customer").select("c_custkey", scalars.binary_label(F.col("c_mktsegment"), "BUILDING").alias("y"))


@query(
    "vector_ops",
    f"""{with_tables('vectors')}, pairs AS (SELECT a.key, a.vec AS u, b.vec AS v FROM vectors a JOIN vectors b ON b.key = a.key + 1)
 SELECT key, round(sqrt(list_dot_product(u, u)), 6) AS norm, round(list_dot_product(u, v), 6) AS dot, round(list_distance(u, v), 6) AS distance,
  round(list_sum(list_transform(range(1, len(u) + 1), lambda i: (u[i] * v[i]) * (u[i] - v[i]))), 6) AS mixed, len(list_concat(u, v)) AS width FROM pairs""",
)
def _(spark, sf):
    left = vectors(spark, sf).select("key", F.col("vec").alias("u"))
    right = vectors(spark, sf).select((F.col("key") - 1).alias("key"), F.col("vec").alias("v"))
    u, v = F.col("u"), F.col("v")
    mixed = arrays.total(arrays.multiply(arrays.multiply(u, v), arrays.subtract(u, v)))
    return left.join(right, "key").select(
        "key",
        scalars.rounded(arrays.norm(u)).alias("norm"),
        scalars.rounded(arrays.dot(u, v)).alias("dot"),
        scalars.rounded(arrays.distance(u, v)).alias("distance"),
        scalars.rounded(mixed).alias("mixed"),
        F.size(F.concat(u, v)).cast("long").alias("width"),
    )


@query("outlier_proxy", "SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, round(1 - l_discount, 6) AS proxy FROM lineitem")
def _(spark, sf):
    proxy = scalars.rounded(scalars.outlier_proxy(F.col("l_discount")))
    return table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", proxy.alias("proxy"))
