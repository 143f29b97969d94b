"""Queries on feature tables, joins, metrics and splits."""

from __future__ import annotations

from pyspark.sql import functions as F

from knotwork.functions.arrays import halves, real_imaginary
from knotwork.functions.scalars import rounded
from knotwork.operators import features as ops
from knotwork.operators import metrics, sampling, sparse
from knotwork.plans.bindings import (
    LABEL,
    NS,
    customer_features,
    kg_triples,
    order_rules,
    patient_clusters,
    scored,
    supplier_clusters,
    table,
    vectors,
    with_tables,
)
from knotwork.plans.registry import query
from knotwork.plans.triple_queries import FLOAT, KG, NUMBER
from knotwork.sources.tables import read_cluster_table, write_table


@query(
    "numeric_predicates",
    f"{KG} SELECT DISTINCT pred FROM kg WHERE obj_kind = 'literal' AND contains(subj, 'Patient_') AND pred <> '{LABEL}' AND {NUMBER.format('obj')}",
)
def _(spark, sf):
    return ops.numeric_predicates(kg_triples(spark, sf), label_predicate=LABEL)


def _least(name: str, alias: str) -> str:
    return f"min(CASE WHEN pred = '{NS}{name}' THEN {FLOAT.format('obj')} END) AS {alias}"


@query(
    "feature_matrix",
    f"""{KG}, wide AS (SELECT subj AS key, min(CASE WHEN pred = '{LABEL}' THEN obj END) AS lab, {_least('acctbal', 'acctbal')}, {_least('nationkey', 'nationkey')}
  FROM kg WHERE contains(subj, 'Patient_') GROUP BY subj)
 SELECT key, CAST(lab = 'BUILDING' AS INTEGER) AS y, acctbal, nationkey FROM wide WHERE lab IS NOT NULL AND acctbal IS NOT NULL AND nationkey IS NOT NULL""",
)
def _(spark, sf):
    wide = ops.feature_matrix(kg_triples(spark, sf), LABEL, "BUILDING")
    return wide.select("key", "y", *[F.col(f"`{NS}{name}`").alias(name) for name in ("acctbal", "nationkey")])


@query(
    "left_join_dropna",
    f"{with_tables('features', 'vectors')} SELECT f.key, f.y, balance, round(list_sum(vec), 6) AS total FROM features f LEFT JOIN vectors v USING (key) WHERE vec IS NOT NULL",
)
def _(spark, sf):
    kept = ops.left_join_dropna(customer_features(spark, sf), vectors(spark, sf).select("key", "vec"))
    total = F.aggregate("vec", F.lit(0.0), lambda acc, x: acc + x)
    return kept.select("key", "y", "balance", rounded(total).alias("total"))


@query(
    "left_join_fill_clusters",
    f"{with_tables('features', 'supplier_clusters')} SELECT key, coalesce(community, -1) AS community, coalesce(density_cluster, -1) AS density_cluster FROM features LEFT JOIN supplier_clusters USING (key)",
)
def _(spark, sf):
    joined = ops.left_join_fill_clusters(customer_features(spark, sf), supplier_clusters(spark, sf))
    return joined.select("key", "community", "density_cluster")


@query(
    "left_join_fill_rules",
    f"{with_tables('features', 'rules')} SELECT key, coalesce(orders, 0) AS orders, coalesce(urgent, 0) AS urgent FROM features LEFT JOIN rules USING (key)",
)
def _(spark, sf):
    rules = ops.numeric_rule_columns(order_rules(spark, sf))
    return ops.left_join_fill_rules(customer_features(spark, sf), rules).select("key", "orders", "urgent")


@query(
    "inner_join_align",
    f"{with_tables('features', 'vectors')} SELECT f.key, f.y, balance, v.label FROM features f JOIN vectors v USING (key)",
)
def _(spark, sf):
    embeddings = vectors(spark, sf).select("key", "vec", "label")
    return ops.inner_join_align(customer_features(spark, sf), embeddings).select("key", "y", "balance", "label")


ONE_HOT = "SELECT key, k.value AS community, CAST(CAST({0} = k.value AS INTEGER) AS DOUBLE) AS flag FROM {1}, (SELECT DISTINCT {0} AS value FROM {1} {2}) k"


def _flags(rows, prefix):
    names = [name for name in rows.columns if name.startswith(f"{prefix}_")]
    pairs = [F.struct(F.lit(int(n[len(prefix) + 1 :])).alias("community"), F.col(n).alias("flag")) for n in names]
    return rows.select("key", F.inline(F.array(*pairs)))


@query("onehot_all", f"{with_tables('clusters')} {ONE_HOT.format('density_cluster', 'clusters', '')}")
def _(spark, sf):
    return _flags(ops.onehot_all(patient_clusters(spark, sf), "density_cluster", "d"), "d")


@query("onehot_train", f"{with_tables('clusters')} {ONE_HOT.format('density_cluster', 'clusters', 'WHERE community < 3 AND density_cluster <> -1')}")
def _(spark, sf):
    return _flags(ops.onehot_train(patient_clusters(spark, sf), "density_cluster", "d", F.col("community") < 3), "d")


ASSEMBLED = f"""{with_tables('features', 'vectors', 'supplier_clusters', 'rules')},
 base AS (SELECT f.key, balance, nation, vec, coalesce(community, -1) AS community, coalesce(density_cluster, -1) AS density, coalesce(orders, 0) AS orders, coalesce(urgent, 0) AS urgent
  FROM features f JOIN vectors v USING (key) LEFT JOIN supplier_clusters USING (key) LEFT JOIN rules USING (key)),
 kc AS (SELECT list(DISTINCT community ORDER BY community) AS values FROM base), kd AS (SELECT list(DISTINCT density ORDER BY density) AS values FROM base),
 built AS (SELECT key, list_concat([balance, nation], vec, list_transform(kc.values, lambda v: CAST(CAST(v = community AS INTEGER) AS DOUBLE)),
   list_transform(kd.values, lambda v: CAST(CAST(v = density AS INTEGER) AS DOUBLE)), [orders, urgent]) AS f FROM base, kc, kd)
 SELECT key, CAST(generate_subscripts(f, 1) - 1 AS INTEGER) AS position, round(unnest(f), 6) AS value FROM built"""


@query(
    "assemble_features",
    ASSEMBLED,
)
def _(spark, sf):
    rows = ops.assemble_features(
        customer_features(spark, sf),
        vectors(spark, sf).select("key", "vec"),
        supplier_clusters(spark, sf),
        ops.numeric_rule_columns(order_rules(spark, sf)),
    )
    return ops.long_form(rows).withColumn("value", rounded(F.col("value")))


@query("assemble_sparse", f"SELECT * FROM ({ASSEMBLED}) WHERE value <> 0")
def _(spark, sf):
    rows = sparse.assemble_sparse(
        customer_features(spark, sf),
        vectors(spark, sf).select("key", "vec"),
        supplier_clusters(spark, sf),
        ops.numeric_rule_columns(order_rules(spark, sf)),
    )
    return sparse.entries(rows).withColumn("value", rounded(F.col("value"))).filter("value <> 0")


@query("numeric_rule_columns", f"{with_tables('rules')} SELECT * FROM rules")
def _(spark, sf):
    return ops.numeric_rule_columns(order_rules(spark, sf))


@query(
    "complex_to_real",
    f"""{with_tables('vectors')}, flat AS (SELECT key, list_concat(vec[1:32], vec[33:64]) AS f FROM vectors)
 SELECT key, CAST(generate_subscripts(f, 1) - 1 AS INTEGER) AS position, round(unnest(f), 6) AS value FROM flat""",
)
def _(spark, sf):
    real, imaginary = halves(F.col("vec"))
    flat = vectors(spark, sf).select("key", real_imaginary(real, imaginary).alias("features"))
    return ops.long_form(flat).withColumn("value", rounded(F.col("value")))


@query(
    "cluster_summary",
    f"{with_tables('clusters')} SELECT count(*) AS patients, count(DISTINCT community) AS communities, count(DISTINCT CASE WHEN density_cluster <> -1 THEN density_cluster END) AS density_clusters, round(avg(CAST(density_cluster = -1 AS INTEGER)), 6) AS noise_ratio FROM clusters",
)
def _(spark, sf):
    summary = metrics.cluster_summary(patient_clusters(spark, sf))
    return summary.withColumn("noise_ratio", rounded(F.col("noise_ratio")))


SCORED = with_tables("scored")
COUNTS = """SELECT {0} count(*) AS n, count_if(y = 1 AND score >= 0.5) AS tp, count_if(score >= 0.5) AS pp, count_if(y = 1) AS p, count_if((y = 1) = (score >= 0.5)) AS hit FROM scored {1}"""
PLAIN = """coalesce(hit / nullif(n, 0), 0) AS accuracy, coalesce(tp / nullif(pp, 0), 0) AS precision, coalesce(tp / nullif(p, 0), 0) AS recall,
 coalesce(2 * coalesce(tp / nullif(pp, 0), 0) * coalesce(tp / nullif(p, 0), 0) / nullif(coalesce(tp / nullif(pp, 0), 0) + coalesce(tp / nullif(p, 0), 0), 0), 0) AS f1"""
GROUPED = f"""{SCORED}, counts AS ({COUNTS.format('lang, toxic,', 'GROUP BY lang, toxic')}),
 pairs AS (SELECT a.lang, a.toxic, sum(CASE WHEN a.score > b.score THEN 1 WHEN a.score = b.score THEN 0.5 ELSE 0 END) / count(*) AS roc_auc
  FROM scored a JOIN scored b ON a.lang = b.lang AND a.toxic = b.toxic AND a.y = 1 AND b.y = 0 GROUP BY ALL),
 seeds AS (SELECT c.lang AS setting, c.toxic AS seed, {PLAIN}, CAST(roc_auc AS DOUBLE) AS roc_auc FROM counts c LEFT JOIN pairs USING (lang, toxic)),
 summary AS (SELECT setting, count(*) AS n_seeds, {', '.join(f'avg({m}) AS {m}_mean, coalesce(stddev_samp({m}), 0) AS {m}_std' for m in metrics.METRICS)} FROM seeds GROUP BY setting)"""


def _seed_rows(spark, sf):
    rows = scored(spark, sf).withColumnsRenamed({"lang": "setting", "toxic": "seed"})
    return metrics.evaluate(rows, ["setting", "seed"], score="score")


def _rounded_all(df, keys=()):
    return df.select(*[rounded(F.col(c)).alias(c) if t == "double" and c not in keys else F.col(c) for c, t in df.dtypes])


@query(
    "metrics_mean_std",
    f"{GROUPED} SELECT setting, n_seeds, {', '.join(f'round({m}_mean, 6) AS {m}_mean, round({m}_std, 6) AS {m}_std' for m in metrics.METRICS)} FROM summary",
)
def _(spark, sf):
    return _rounded_all(metrics.metrics_mean_std(_seed_rows(spark, sf), ["setting"]))


@query(
    "delta_vs_baseline",
    f"{GROUPED} SELECT setting, round(f1_mean - (SELECT f1_mean FROM summary WHERE setting = 'en'), 6) AS delta_f1_mean, round(roc_auc_mean - (SELECT roc_auc_mean FROM summary WHERE setting = 'en'), 6) AS delta_roc_auc_mean FROM summary",
)
def _(spark, sf):
    summary = metrics.metrics_mean_std(_seed_rows(spark, sf), ["setting"])
    return _rounded_all(metrics.delta_vs_baseline(summary, "en").select("setting", "delta_f1_mean", "delta_roc_auc_mean"))


@query(
    "best_candidate",
    f"{GROUPED} SELECT setting AS candidate, round(avg(roc_auc), 6) AS mean_score FROM seeds GROUP BY setting ORDER BY avg(roc_auc) DESC, setting LIMIT 1",
)
def _(spark, sf):
    folds = _seed_rows(spark, sf).withColumnsRenamed({"setting": "candidate", "roc_auc": "auc"})
    return _rounded_all(metrics.best_candidate(folds))


@query(
    "confusion_matrix",
    f"""{SCORED} SELECT g.a AS actual, h.p AS predicted, count(key) AS n FROM (VALUES (0), (1)) g(a) CROSS JOIN (VALUES (0), (1)) h(p)
 LEFT JOIN scored ON y = g.a AND CAST(score >= 0.5 AS INTEGER) = h.p GROUP BY ALL""",
)
def _(spark, sf):
    rows = scored(spark, sf).withColumn("prediction", (F.col("score") >= 0.5).cast("int"))
    return metrics.confusion_matrix(rows)


@query("binary_metrics", f"{SCORED}, counts AS ({COUNTS.format('', '')}), m AS (SELECT {PLAIN} FROM counts) SELECT round(accuracy, 6) AS accuracy, round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1 FROM m")
def _(spark, sf):
    rows = scored(spark, sf).withColumn("prediction", (F.col("score") >= 0.5).cast("int"))
    return _rounded_all(metrics.binary_metrics(rows))


@query(
    "roc_auc",
    f"{SCORED} SELECT round(CAST(sum(CASE WHEN a.score > b.score THEN 1 WHEN a.score = b.score THEN 0.5 ELSE 0 END) AS DOUBLE) / count(*), 6) AS roc_auc FROM scored a JOIN scored b ON a.y = 1 AND b.y = 0",
)
def _(spark, sf):
    return _rounded_all(metrics.roc_auc(scored(spark, sf)))


@query(
    "union_settings",
    f"""{SCORED} SELECT 'long' AS setting, key, y FROM scored WHERE score >= 0.5 UNION ALL SELECT 'all', key, y FROM scored""",
)
def _(spark, sf):
    rows = scored(spark, sf).select("key", "y", "score")
    frames = {"long": rows.filter(F.col("score") >= 0.5), "all": rows}
    return ops.union_settings(frames).select("setting", "key", "y")


RANKED = "SELECT key, y, row_number() OVER (PARTITION BY y ORDER BY sha1('42|' || key)) AS rn FROM features"
QUOTAS = """sizes AS (SELECT y, count(*) AS n FROM features GROUP BY y),
 shares AS (SELECT y, floor(0.2 * n) AS whole, round(0.2 * n - floor(0.2 * n), 9) AS rest, ceil(0.2 * sum(n) OVER ()) - sum(floor(0.2 * n)) OVER () AS missing FROM sizes),
 quotas AS (SELECT y, whole + CAST(row_number() OVER (ORDER BY rest DESC, y DESC) <= missing AS INTEGER) AS quota FROM shares)"""


@query(
    "stratified_split",
    f"{with_tables('features')}, {QUOTAS}, ranked AS ({RANKED}) SELECT key, r.y, rn <= quota AS is_test FROM ranked r JOIN quotas q ON q.y = r.y",
)
def _(spark, sf):
    return sampling.stratified_split(customer_features(spark, sf)).select("key", "y", "is_test")


@query("stratified_folds", f"{with_tables('features')}, ranked AS ({RANKED}) SELECT key, y, CAST((rn - 1) % 5 AS INTEGER) AS fold FROM ranked")
def _(spark, sf):
    return sampling.stratified_folds(customer_features(spark, sf)).select("key", "y", "fold")


@query(
    "read_cluster_table",
    "SELECT doc_id AS key, coalesce(quality, -1) AS community, coalesce(CASE WHEN toxic = 0 THEN NULL ELSE toxic END, -1) AS density_cluster FROM documents LEFT JOIN labels USING (doc_id)",
)
def _(spark, sf):
    labels = table(spark, sf, "documents").select("doc_id").join(table(spark, sf, "labels"), "doc_id", "left")
    text = labels.select(
        F.col("doc_id").alias("entity"),
        F.col("quality").alias("leiden"),
        F.when(F.col("toxic") == 0, "none").otherwise(F.col("toxic").cast("string")).alias("hdbscan_label"),
    )
    rows = read_cluster_table(spark, write_table(text, "clusters"))
    return rows.withColumn("key", F.col("key").cast("long"))
