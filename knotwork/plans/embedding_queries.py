"""Queries on knowledge-graph embedding and link prediction."""

from __future__ import annotations

from functools import partial

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from knotwork.functions.scalars import rounded
from knotwork.operators import kge, linkpred
from knotwork.operators.triples import entity_triples, labelled
from knotwork.plans.bindings import kg_triples, vectors, with_tables
from knotwork.plans.registry import query
from knotwork.session import cut, in_parallel

IRI = "subj_kind = 'iri' AND obj_kind = 'iri' AND NOT contains(lower(pred), 'comment') AND NOT contains(lower(pred), 'label')"
KG = with_tables("kg") + f", g AS (SELECT DISTINCT subj AS head, pred AS relation, obj AS tail FROM kg WHERE {IRI})"
CODED = f"""{KG}, ent AS (SELECT label, row_number() OVER (ORDER BY label) - 1 AS id FROM (SELECT head AS label FROM g UNION SELECT tail FROM g)),
 rel AS (SELECT label, row_number() OVER (ORDER BY label) - 1 AS id FROM (SELECT DISTINCT relation AS label FROM g)),
 coded AS (SELECT a.id AS head, r.id AS relation, b.id AS tail FROM g JOIN ent a ON a.label = head JOIN ent b ON b.label = tail JOIN rel r ON r.label = relation)"""


def graph_triples(spark, sf) -> DataFrame:
    return labelled(entity_triples(kg_triples(spark, sf)))


def linked(spark, sf) -> DataFrame:
    """Triples between vectors: each leads to two others, by its label."""
    ids = vectors(spark, sf).select(F.col("key").alias("head"), F.col("label").cast("long").alias("relation"))
    steps = [F.col("head") + F.col("relation") + 1, F.col("head") + F.col("relation") * 2 + 3]
    out = ids.select("head", "relation", F.explode(F.array(*steps)).alias("tail"))
    return out.join(vectors(spark, sf).select(F.col("key").alias("tail")), "tail").select("head", "relation", "tail").distinct()


def fixed_vectors(spark, sf, model: str) -> tuple[DataFrame, DataFrame]:
    """Vectors by id; a relation takes the vector of the same id, its first half as phases."""
    entities = vectors(spark, sf).select(F.col("key").alias("id"), "vec")
    relations = entities.join(linked(spark, sf).select(F.col("relation").alias("id")).distinct(), "id")
    if model == "rotate":
        relations = relations.withColumn("vec", F.slice("vec", 1, 32))
    return entities, relations


LINKED = f"""{with_tables('vectors')}, ids AS (SELECT key AS head, CAST(label AS BIGINT) AS relation FROM vectors),
 linked AS (SELECT DISTINCT head, relation, tail FROM (SELECT head, relation, unnest([head + relation + 1, head + relation * 2 + 3]) AS tail FROM ids) WHERE tail IN (SELECT key FROM vectors)),
 wide AS (SELECT l.*, h.vec AS h, r.vec AS r, t.vec AS t FROM linked l JOIN vectors h ON h.key = head JOIN vectors r ON r.key = relation JOIN vectors t ON t.key = tail)"""
SUM = "list_sum(list_transform(range(1, {n}), lambda i: {e}))"
FORMULAS = {
    "transe": "-sqrt(" + SUM.format(n=65, e="(h[i] + r[i] - t[i]) * (h[i] + r[i] - t[i])") + ")",
    "distmult": SUM.format(n=65, e="h[i] * r[i] * t[i]"),
    "complex": SUM.format(n=33, e="(h[i] * r[i] - h[i+32] * r[i+32]) * t[i] + (h[i] * r[i+32] + h[i+32] * r[i]) * t[i+32]"),
    "rotate": "-sqrt(" + SUM.format(n=33, e="pow(h[i] * cos(r[i]) - h[i+32] * sin(r[i]) - t[i], 2) + pow(h[i] * sin(r[i]) + h[i+32] * cos(r[i]) - t[i+32], 2)") + ")",
}

for _model, _formula in FORMULAS.items():

    @query(f"score_{_model}", f"{LINKED} SELECT head, relation, tail, round({_formula}, 6) AS score FROM wide")
    def _(spark, sf, model=_model):
        scored = kge.score_triples(linked(spark, sf), *fixed_vectors(spark, sf, model), model)
        return scored.withColumn("score", rounded(F.col("score")))


@query("encode_triples", f"{CODED} SELECT * FROM coded")
def _(spark, sf):
    return kge.encode_triples(graph_triples(spark, sf))[2]


@query("inverse_triples", f"{KG} SELECT * FROM g UNION ALL SELECT tail, relation || '_inverse', head FROM g")
def _(spark, sf):
    return kge.inverse_triples(graph_triples(spark, sf).distinct())


@query(
    "split_triples",
    f"""{KG}, h AS (SELECT *, sha1('42|' || head || '|' || relation || '|' || tail) AS hash FROM g),
 least AS (SELECT DISTINCT min(hash) AS hash FROM (SELECT 'e' || head AS name, hash FROM h UNION ALL SELECT 'e' || tail, hash FROM h UNION ALL SELECT 'r' || relation, hash FROM h) GROUP BY name),
 s AS (SELECT *, CAST(CAST('0x' || substr(hash, 1, 13) AS BIGINT) AS DOUBLE) / 4503599627370496.0::DOUBLE AS share FROM h)
 SELECT head, relation, tail, CASE WHEN hash IN (SELECT hash FROM least) OR share < 0.8::DOUBLE THEN 'train' WHEN share < 0.9::DOUBLE THEN 'valid' ELSE 'test' END AS part FROM s""",
)
def _(spark, sf):
    return kge.split_triples(graph_triples(spark, sf).distinct())


@query(
    "negative_samples",
    f"""{LINKED}, n AS (SELECT count(*) AS n FROM vectors), d AS (SELECT l.*, unnest([0, 1]) AS draw FROM linked l),
 s AS (SELECT *, CAST('0x' || substr(sha1('42|0|' || draw || '|' || head || '|' || relation || '|' || tail), 1, 15) AS BIGINT) % n.n AS fresh FROM d, n),
 c AS (SELECT CASE WHEN draw = 0 THEN head ELSE fresh END AS head, relation, CASE WHEN draw = 0 THEN fresh ELSE tail END AS tail, draw FROM s)
 SELECT head, relation, tail, draw FROM c WHERE (head, relation, tail) NOT IN (SELECT head, relation, tail FROM linked)""",
)
def _(spark, sf):
    size = vectors(spark, sf).count()
    return kge.negative_samples(linked(spark, sf), size, count=2, filtered=True)


# Every score of an open triple against every entity, without the known ones.
RANKS = f"""{LINKED}, n AS (SELECT count(*) AS n FROM vectors), own AS (SELECT *, round({FORMULAS['transe']}, 9) AS own FROM wide),
 cand AS (SELECT o.head, o.relation, o.tail, 'tail' AS side, own, round(-list_distance(list_transform(range(1, 65), lambda i: h[i] + r[i]), v.vec), 9) AS s
   FROM own o JOIN vectors v ON v.key <> o.tail ANTI JOIN linked k ON k.head = o.head AND k.relation = o.relation AND k.tail = v.key
  UNION ALL SELECT o.head, o.relation, o.tail, 'head', own, round(-list_distance(list_transform(range(1, 65), lambda i: t[i] - r[i]), v.vec), 9)
   FROM own o JOIN vectors v ON v.key <> o.head ANTI JOIN linked k ON k.head = v.key AND k.relation = o.relation AND k.tail = o.tail),
 ranks AS (SELECT head, relation, tail, side, CAST(1 + count_if(s > own) AS DOUBLE) AS optimistic, 1 + count_if(s > own) + count_if(s = own) / 2 AS realistic,
   CAST(1 + count_if(s >= own) AS DOUBLE) AS pessimistic, count(*) + 1 AS candidates FROM cand GROUP BY ALL)"""


def _ranks(spark, sf):
    graph = linked(spark, sf)
    return linkpred.rank_candidates(graph, graph, *fixed_vectors(spark, sf, "transe"), "transe")


@query("rank_candidates", f"{RANKS} SELECT * FROM ranks")
def _(spark, sf):
    return _ranks(spark, sf)


POWER = "list_sum(list_transform(range(1, candidates + 1), lambda j: pow(j, {0}))) / candidates"
METRICS_SQL = f"""{RANKS}, both_sides AS (SELECT unnest([side, 'both']) AS side, optimistic, realistic, pessimistic, candidates FROM ranks),
 rows AS (SELECT side, unnest(['optimistic', 'realistic', 'pessimistic']) AS rank_type, unnest([optimistic, realistic, pessimistic]) AS rank FROM both_sides),
 counted AS (SELECT side, candidates, count(*) AS w, sum(count(*)) OVER (PARTITION BY side) AS total FROM both_sides GROUP BY side, candidates),
 per AS (SELECT side, w, CAST(total AS DOUBLE) AS total, (candidates + 1) / 2 AS er, (candidates * candidates - 1) / 12 AS vr, {POWER.format('-1')} AS ei, {POWER.format('-2')} AS ei2,
   ln({POWER.format('1 / total')}) AS l1, ln({POWER.format('2 / total')}) AS l2, least(10, candidates) / candidates AS eh FROM counted),
 e AS (SELECT side, sum(w * er) / max(total) AS er, sum(w * vr) / pow(max(total), 2) AS vr, sum(w * ei) / max(total) AS ei, sum(w * (ei2 - ei * ei)) / pow(max(total), 2) AS vi,
   exp(sum(w * l1)) AS eg, exp(2 * sum(w * l1)) * (exp(sum(w * l2) - 2 * sum(w * l1)) - 1) AS vg, sum(w * eh) / max(total) AS eh, sum(w * eh * (1 - eh)) / pow(max(total), 2) AS vh FROM per GROUP BY side),
 b AS (SELECT side, rank_type, CAST(count(*) AS DOUBLE) AS n, avg(rank) AS mr, exp(avg(ln(rank))) AS g, avg(1 / rank) AS i, var_pop(rank) AS v, stddev_pop(rank) AS sd, median(rank) AS md, mad(rank) AS ad,
   avg(CAST(rank <= 1 AS INTEGER)) AS h1, avg(CAST(rank <= 3 AS INTEGER)) AS h3, avg(CAST(rank <= 5 AS INTEGER)) AS h5, avg(CAST(rank <= 10 AS INTEGER)) AS h10 FROM rows GROUP BY ALL)
 SELECT side, rank_type, metric, round(value, 6) AS value FROM (SELECT side, rank_type, unnest([{{names}}]) AS metric, unnest([{{values}}]) AS value FROM b JOIN e USING (side))"""
METRIC_FORMULAS = {
    "count": "n", "arithmetic_mean_rank": "mr", "geometric_mean_rank": "g", "harmonic_mean_rank": "1 / i", "median_rank": "md",
    "inverse_arithmetic_mean_rank": "1 / mr", "inverse_geometric_mean_rank": "1 / g", "inverse_harmonic_mean_rank": "i", "inverse_median_rank": "1 / md",
    "hits_at_1": "h1", "hits_at_3": "h3", "hits_at_5": "h5", "hits_at_10": "h10", "standard_deviation": "sd", "variance": "v",
    "median_absolute_deviation": "ad * 1.482602218505602::DOUBLE", "adjusted_arithmetic_mean_rank": "mr / er",
    "adjusted_arithmetic_mean_rank_index": "1 - (mr - 1) / (er - 1)", "adjusted_geometric_mean_rank_index": "1 - (g - 1) / (eg - 1)",
    "adjusted_inverse_harmonic_mean_rank": "(i - ei) / (1 - ei)", "adjusted_hits_at_k": "(h10 - eh) / (1 - eh)",
    "z_arithmetic_mean_rank": "(er - mr) / sqrt(vr)", "z_geometric_mean_rank": "(eg - g) / sqrt(vg)",
    "z_inverse_harmonic_mean_rank": "(i - ei) / sqrt(vi)", "z_hits_at_k": "(h10 - eh) / sqrt(vh)",
}
METRICS_SQL = METRICS_SQL.format(
    names=", ".join(f"'{name}'" for name in METRIC_FORMULAS), values=", ".join(METRIC_FORMULAS.values())
)


@query("rank_metrics", METRICS_SQL)
def _(spark, sf):
    return linkpred.rank_metrics(cut(_ranks(spark, sf))).withColumn("value", rounded(F.col("value")))


HEADLINES = ["inverse_harmonic_mean_rank", "adjusted_inverse_harmonic_mean_rank", "hits_at_10"]


@query(
    "kge_metric_extract",
    "SELECT {} FROM ({}) WHERE side = 'both' AND rank_type = 'realistic'".format(
        ", ".join(f"max(CASE WHEN metric = '{name}' THEN value END) AS {name}" for name in HEADLINES), METRICS_SQL
    ),
)
def _(spark, sf):
    out = linkpred.kge_metric_extract(linkpred.rank_metrics(cut(_ranks(spark, sf))))
    return out.select(*[rounded(F.col(name)).alias(name) for name in HEADLINES])


@query("train_kge")
def _(spark, sf):
    coded = cut(kge.encode_triples(graph_triples(spark, sf))[2])
    models = ("transe", "rotate", "complex")
    trained = in_parallel(spark, [partial(kge.train_kge, coded, model) for model in models])
    rows = [(model, round_, float(loss)) for model, (_, _, losses) in zip(models, trained) for round_, loss in enumerate(losses)]
    return spark.createDataFrame(rows, "model string, round int, loss double")


@query("patient_vectors")
def _(spark, sf):
    names, _, coded = kge.encode_triples(graph_triples(spark, sf))
    entities, _, _ = kge.train_kge(coded, "transe")
    return kge.patient_vectors(names, entities)
