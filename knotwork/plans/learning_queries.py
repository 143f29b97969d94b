"""Queries on classifiers, stacking and ablations, on the vectors with label < 5 as the positive class.

But for ``clf_forest``, ensembles have fewer rounds, trees, folds and seeds than the library's defaults; rows
are all there.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from knotwork.functions.scalars import rounded
from knotwork.operators import gated, learn, metrics, sampling, stacking
from knotwork.operators.vectors import standardize
from knotwork.plans.bindings import customer_features, scored, supplier_clusters, vectors, with_tables
from knotwork.plans.embedding_queries import graph_triples
from knotwork.plans.feature_queries import GROUPED, QUOTAS
from knotwork.plans.registry import query
from knotwork.session import cut


def labelled_rows(spark, sf) -> DataFrame:
    return vectors(spark, sf).select("key", "y", F.col("vec").alias("features"))


def split(spark, sf) -> tuple[DataFrame, DataFrame]:
    rows = cut(sampling.stratified_split(labelled_rows(spark, sf)))
    return rows.filter(~F.col("is_test")).drop("is_test"), rows.filter("is_test").drop("is_test")


def _scored_test(spark, sf, fit: learn.Fit) -> DataFrame:
    train, test = split(spark, sf)
    return fit(train)(test).select("key", "y", "probability")


SPLIT_SQL = f"""{with_tables('vectors')}, {QUOTAS.replace('features', 'vectors')},
 ranked AS (SELECT key, y, vec, row_number() OVER (PARTITION BY y ORDER BY sha1('42|' || key)) AS rn FROM vectors),
 parts AS (SELECT key, r.y, vec, rn <= quota AS is_test FROM ranked r JOIN quotas q ON q.y = r.y)"""


@query(
    "clf_knn",
    f"""{SPLIT_SQL}, near AS (SELECT a.key, a.y, b.y AS vote, row_number() OVER (PARTITION BY a.key ORDER BY list_distance(a.vec, b.vec), b.key) AS place
  FROM parts a JOIN parts b ON a.is_test AND NOT b.is_test QUALIFY place <= 7)
 SELECT key, y, round(avg(vote), 6) AS probability FROM near GROUP BY key, y""",
)
def _(spark, sf):
    rows = _scored_test(spark, sf, learn.nearest_vote(7, scaled=False))
    return rows.withColumn("probability", rounded(F.col("probability")))


@query("clf_logistic")
def _(spark, sf):
    return _scored_test(spark, sf, learn.logistic())


@query("clf_kernel_svm")
def _(spark, sf):
    return _scored_test(spark, sf, learn.kernel_svm())


@query("clf_forest")
def _(spark, sf):
    return _scored_test(spark, sf, learn.forest())


@query("clf_mlp")
def _(spark, sf):
    return _scored_test(spark, sf, learn.mlp())


@query("clf_boosted")
def _(spark, sf):
    return _scored_test(spark, sf, learn.boosted("A", rounds=5))


@query("scaled_pipeline")
def _(spark, sf):
    return _scored_test(spark, sf, learn.logistic(10.0))


@query("clf_gated_mlp")
def _(spark, sf):
    train, test = split(spark, sf)
    model = gated.fit_gated(cut(standardize(train, "features")))
    rows = model.score(standardize(test, "features", train)).withColumn("gate_mean", F.aggregate("gate", F.lit(0.0), lambda a, x: a + x) / F.size("gate"))
    return rows.select("key", "y", "probability", "gate_mean")


def small_models(seed: int = 42) -> dict[str, learn.Fit]:
    return {"logistic": learn.logistic(), "forest": learn.forest(trees=5, depth=3, seed=seed)}


@query("oof_stacking")
def _(spark, sf):
    out = stacking.oof_stacking(*split(spark, sf), small_models(), tune_meta=True)
    return out.select("key", "y", "probability", "prediction")


@query("oof_stacking_refit")
def _(spark, sf):
    return stacking.oof_stacking_refit(*split(spark, sf), small_models())


FOLD_SCORES = """folds AS (SELECT *, unnest([0, 1, 2]) AS fold FROM scored), models AS (SELECT *, unnest(['plain', 'square']) AS model FROM folds),
 s AS (SELECT key, y, model, CASE model WHEN 'plain' THEN score ELSE score * score END / (fold + 1) AS p FROM models)"""


@query(
    "stacking_meta_features",
    f"""{with_tables('scored')}, {FOLD_SCORES}, m AS (SELECT key, y, model, avg(p) AS p FROM s GROUP BY ALL)
 SELECT key, y, round(max(CASE WHEN model = 'plain' THEN p END), 6) AS plain, round(max(CASE WHEN model = 'square' THEN p END), 6) AS square FROM m GROUP BY key, y""",
)
def _(spark, sf):
    chance = F.when(F.col("model") == "plain", F.col("score")).otherwise(F.col("score") * F.col("score"))
    rows = scored(spark, sf).withColumn("fold", F.explode(F.array(*map(F.lit, range(3)))))
    rows = rows.withColumn("model", F.explode(F.array(F.lit("plain"), F.lit("square"))))
    scores = rows.select("key", "y", "model", (chance / (F.col("fold") + 1)).alias("probability"))
    wide = stacking.meta_features(stacking.mean_over_folds(scores), ["plain", "square"])
    return wide.select("key", "y", *[rounded(F.col("features")[i]).alias(n) for i, n in enumerate(["plain", "square"])])


@query("grid_search")
def _(spark, sf):
    train, _test = split(spark, sf)
    folded = cut(sampling.stratified_folds(train))
    return stacking.grid_search(folded, {f"c={c}": learn.logistic(c) for c in (0.1, 1.0, 10.0)})


@query("meta_tune")
def _(spark, sf):
    train, _test = split(spark, sf)
    folded = cut(sampling.stratified_folds(train, folds=3))
    scores = stacking.fold_scores(folded, small_models(), folds=3)
    inner = cut(stacking.meta_features(scores, list(small_models())).join(folded.select("key", "fold"), "key"))
    c, area = stacking.meta_tune(inner, folds=3)
    return spark.createDataFrame([(c, area)], "c double, auc double")


@query("pca_tune")
def _(spark, sf):
    train, _test = split(spark, sf)
    folded = cut(sampling.stratified_folds(train, folds=3))
    rows = folded.select("key", "y", "fold", F.slice("features", 1, 2).alias("raw"), F.col("features").alias("vec"))
    return spark.createDataFrame([(stacking.pca_tune(rows, folds=3),)], "components int")


def _seed_features(spark, sf, flags=(True, True, False), seed=42):
    tab = customer_features(spark, sf)
    embeddings = vectors(spark, sf).select("key", "vec")
    return stacking.build_seed_features(
        tab, embeddings, supplier_clusters(spark, sf), None, seed, *flags, sizes=[8], folds=3
    )


@query("build_seed_features")
def _(spark, sf):
    made = _seed_features(spark, sf)
    return made.rows.select("key", "y", "is_test", F.size("features").alias("width"))


@query("ablation_runner")
def _(spark, sf):
    rows = stacking.ablation_runner(
        lambda flags, seed: _seed_features(spark, sf, flags, seed),
        lambda seed: {"logistic": learn.logistic()},
        {"A": (False, False, False), "B": (True, False, False)},
        [42, 43],
        folds=3,
    )
    return stacking.ablation_summary(rows)


@query(
    "ablation_summary",
    f"""{GROUPED}, base AS (SELECT * FROM summary WHERE setting = 'en')
 SELECT s.setting, s.n_seeds, round(s.f1_mean, 6) AS f1_mean, round(s.f1_std, 6) AS f1_std, round(s.f1_mean - b.f1_mean, 6) AS delta_f1_mean FROM summary s, base b""",
)
def _(spark, sf):
    rows = scored(spark, sf).withColumnsRenamed({"lang": "setting", "toxic": "seed"})
    summary = stacking.ablation_summary(metrics.evaluate(rows, ["setting", "seed"], score="score"), "en")
    doubles = [rounded(F.col(c)).alias(c) for c in ("f1_mean", "f1_std", "delta_f1_mean")]
    return summary.select("setting", "n_seeds", *doubles)


@query("permutation_importance")
def _(spark, sf):
    train, test = split(spark, sf)
    score = learn.logistic()(train)
    return stacking.permutation_importance(score, test)


@query("model_comparison")
def _(spark, sf):
    return stacking.compare_embeddings(graph_triples(spark, sf))


@query("heldout_ranks")
def _(spark, sf):
    return stacking.heldout_ranks(graph_triples(spark, sf))
