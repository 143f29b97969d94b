"""Out-of-fold stacking, grid search, ablations and feature influence.

Rows are (key, y, features), split once and written; every (model, fold) fit is its own set of
Spark jobs, several at a time.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Sequence
from dataclasses import dataclass
from functools import partial, reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from knotwork.operators import density, features as feature_ops, kge, learn, linkpred, metrics, neighbors, vectors
from knotwork.operators.graph import communities, modularity
from knotwork.operators.ordering import hash_rank
from knotwork.operators.sampling import FOLDS, SEEDS, TEST_SHARE, stratified_folds, stratified_split
from knotwork.operators.triples import PATIENT_PREFIX
from knotwork.session import cut, in_parallel

# Candidates of the tuned parts, and the ablation settings
# (use_embeddings, use_clusters, use_rules).
META_C = [0.1, 1.0, 10.0]
PCA_SIZES = [8, 16, 32]
SETTINGS = {
    "A": (False, False, False),
    "B": (True, False, False),
    "C": (True, True, False),
    "Full": (True, True, True),
}


def _union(frames: Sequence[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)


def fold_scores(rows: DataFrame, models: dict[str, learn.Fit], extra: DataFrame | None = None, folds: int = FOLDS) -> DataFrame:
    """model, fold, is_extra, key, y, probability: each fold scored by a model that did not see it,
    and ``extra`` rows scored by every fold's model."""

    def task(name: str, fit: learn.Fit, fold: int) -> DataFrame:
        score = fit(rows.filter(F.col("fold") != fold).select("key", "y", "features"))
        parts = [score(rows.filter(F.col("fold") == fold).select("key", "y", "features")).withColumn("is_extra", F.lit(False))]
        if extra is not None:
            parts.append(score(extra.select("key", "y", "features")).withColumn("is_extra", F.lit(True)))
        out = _union([part.select("key", "y", "is_extra", "probability") for part in parts])
        return cut(out.select(F.lit(name).alias("model"), F.lit(fold).alias("fold"), "*"))

    tasks = [lambda n=n, m=m, f=f: task(n, m, f) for n, m in models.items() for f in range(folds)]
    return _union(in_parallel(rows.sparkSession, tasks))


def mean_over_folds(scores: DataFrame) -> DataFrame:
    """key, y, model, probability: the mean of the fold models."""
    return scores.groupBy("key", "y", "model").agg(F.avg("probability").alias("probability"))


def meta_features(scores: DataFrame, names: Sequence[str]) -> DataFrame:
    """key, y, features: one position for each base model, in the given order."""
    columns = [F.max(F.when(F.col("model") == name, F.col("probability"))) for name in names]
    return scores.groupBy("key", "y").agg(F.array(*columns).alias("features"))


def grid_search(rows: DataFrame, candidates: dict[str, learn.Fit], folds: int = FOLDS) -> DataFrame:
    """candidate, place, auc: mean cross-validated AUC of each candidate, in the given order."""
    scores = fold_scores(rows, candidates, folds=folds)
    areas = metrics.roc_auc(scores, ["model", "fold"], score="probability")
    order = F.array_position(F.array(*[F.lit(name) for name in candidates]), F.col("candidate"))
    means = areas.groupBy(F.col("model").alias("candidate")).agg(F.avg("roc_auc").alias("auc"))
    return means.withColumn("place", order.cast("int")).select("candidate", "place", "auc")


def best_of(rows: DataFrame, candidates: dict[str, learn.Fit], folds: int = FOLDS) -> tuple[str, float]:
    """Greatest mean AUC; the first candidate wins a tie."""
    if len(candidates) == 1:
        return next(iter(candidates)), float("nan")
    row = grid_search(rows, candidates, folds).orderBy(F.desc("auc"), "place").first()
    return row["candidate"], row["auc"]


def tune_base_models(rows: DataFrame, grids: dict[str, dict[str, learn.Fit]], folds: int = FOLDS) -> dict[str, learn.Fit]:
    """The best candidate of each grid."""
    return {name: grid[best_of(rows, grid, folds)[0]] for name, grid in grids.items()}


def meta_tune(meta_rows: DataFrame, values: Sequence[float] = tuple(META_C), folds: int = FOLDS) -> tuple[float, float]:
    """Penalty of the meta model by cross-validated AUC."""
    name, area = best_of(meta_rows, {str(c): learn.logistic(c) for c in values}, folds)
    return float(name), area


def _meta_score(train_meta: DataFrame, test_meta: DataFrame, c: float) -> DataFrame:
    return learn.logistic(c)(cut(train_meta.select("key", "y", "features")))(test_meta)


def oof_stacking(
    train: DataFrame, test: DataFrame, models: dict[str, learn.Fit], folds: int = FOLDS, seed: int = 42, tune_meta: bool = False
) -> DataFrame:
    """Test rows with the meta model's ``probability`` and ``prediction``.

    Base probabilities of training rows come from models that did not see them; those of test rows
    are means over the fold models.
    """
    folded = cut(stratified_folds(train, seed, folds))
    scores = fold_scores(folded, models, test, folds)
    names = list(models)
    inner = cut(meta_features(scores.filter(~F.col("is_extra")), names).join(folded.select("key", "fold"), "key"))
    outer = meta_features(mean_over_folds(scores.filter("is_extra")), names)
    c = meta_tune(inner, folds=folds)[0] if tune_meta else 1.0
    scored = _meta_score(inner, cut(outer), c)
    return scored.withColumn("prediction", (F.col("probability") >= 0.5).cast("int"))


def oof_stacking_refit(train: DataFrame, test: DataFrame, models: dict[str, learn.Fit], folds: int = FOLDS, seed: int = 42) -> DataFrame:
    """model, key, y, probability, prediction: test rows scored by base models refitted on all
    training rows, and by the meta model (``stack``) on top of them."""
    folded = cut(stratified_folds(train, seed, folds))
    names = list(models)
    inner = meta_features(fold_scores(folded, models, folds=folds), names)

    def refit(name: str) -> DataFrame:
        scored = models[name](folded.select("key", "y", "features"))(test.select("key", "y", "features"))
        return cut(scored.select(F.lit(name).alias("model"), "key", "y", "probability"))

    outer = _union(in_parallel(train.sparkSession, [lambda n=n: refit(n) for n in names]))
    stacked = _meta_score(inner, cut(meta_features(outer, names)), 1.0)
    rows = outer.unionByName(stacked.select(F.lit("stack").alias("model"), "key", "y", "probability"))
    return rows.withColumn("prediction", (F.col("probability") >= 0.5).cast("int"))


def pca_tune(rows: DataFrame, sizes: Sequence[int] = tuple(PCA_SIZES), folds: int = FOLDS) -> int:
    """Number of main axes with the best AUC of a logistic model on raw ‖ projected columns.

    Rows are training rows (key, y, raw, vec, fold). The axes are nested, so one projection at the
    largest size serves all candidates.
    """
    dim = vectors.dimension(rows)
    wanted = sorted({min(size, dim) for size in sizes if min(size, dim) >= 2})
    if not wanted:
        return min(16, dim)
    flat, _ = vectors.pca(rows, wanted[-1])
    flat = cut(flat)

    raw = flat.select(F.size("raw")).first()[0]

    def prefix(size: int) -> learn.Fit:
        shorter = F.slice("features", 1, raw + size)

        def fit(train: DataFrame) -> learn.Score:
            inner = learn.logistic(1.0, 5000)(train.withColumn("features", shorter))
            return lambda given: inner(given.withColumn("features", shorter))

        return fit

    full = flat.select("key", "y", "fold", F.concat("raw", "vec").alias("features"))
    name, _ = best_of(full, {str(size): prefix(size) for size in wanted}, folds)
    return int(name)


@dataclass
class SeedFeatures:
    """Rows (key, y, is_test, features) of one seed, and what was learnt on the way."""

    rows: DataFrame
    details: dict


def build_seed_features(
    table: DataFrame,
    embeddings: DataFrame,
    clusters: DataFrame,
    rules: DataFrame | None = None,
    seed: int = 42,
    use_embeddings: bool = True,
    use_clusters: bool = True,
    use_rules: bool = False,
    test_share: float = TEST_SHARE,
    sizes: Sequence[int] = tuple(PCA_SIZES),
    folds: int = FOLDS,
    min_cluster_size: int = 15,
) -> SeedFeatures:
    """Split, then everything that is fitted is fitted on training rows only: projection, density
    clusters, one-hot categories and centroids."""
    raw = [name for name in table.columns if name not in ("key", "y")]
    base = table.select("key", "y", F.array(*[F.col(f"`{n}`").cast("double") for n in raw]).alias("raw"))
    joined = feature_ops.inner_join_align(base, embeddings.select("key", "vec"))
    joined = feature_ops.left_join_fill_clusters(joined, clusters, ["community"])
    rows = cut(stratified_split(joined, seed, test_share))
    train = rows.filter(~F.col("is_test"))
    details: dict = {"seed": seed}
    parts: list[Column] = [F.col("raw")]
    space = rows
    if use_embeddings:
        size = pca_tune(stratified_folds(train, seed, folds), sizes, folds)
        space, shares = vectors.pca(rows, size, fit_on=train)
        space = cut(space)
        details |= {"pca_components": size, "pca_explained_var_sum": sum(shares)}
        parts.append(F.col("vec"))
    out = space
    if use_clusters:
        known, unseen = space.filter(~F.col("is_test")), space.filter("is_test")
        model = density.fit_density(known.select("key", "vec"), min_cluster_size=min_cluster_size)
        soft = model.members.unionByName(density.density_assign(model, known, unseen.select("key", "vec")))
        soft = cut(soft.withColumnRenamed("cluster", "density"))
        out = space.join(soft, "key")
        before = set(out.columns)
        out = feature_ops.onehot_train(out, "community", "community", ~F.col("is_test"))
        hot = [name for name in out.columns if name not in before]
        near = vectors.centroid_distances(out, ~F.col("is_test"), "community")
        dense = vectors.centroid_distances(out, ~F.col("is_test"), "density").drop("dist_global")
        dense = dense.withColumnsRenamed({"dist_assigned": "dense_assigned", "dist_nearest": "dense_nearest"})
        out = cut(out.join(near, "key").join(dense, "key"))
        parts.append(
            F.array(
                *hot,
                F.col("strength"),
                F.lit(1.0) - F.col("strength"),
                *["dist_assigned", "dist_nearest", "dist_global", "dense_assigned", "dense_nearest"],
            )
        )
        row = model.members.agg(
            F.countDistinct(F.when(F.col("cluster") != -1, F.col("cluster"))).alias("k"), F.avg((F.col("cluster") == -1).cast("double")).alias("noise")
        ).first()
        details |= {"density_clusters_train": row["k"], "noise_train": row["noise"]}
    if use_rules:
        if rules is None:
            raise ValueError("rules are asked for but not given")
        out = feature_ops.left_join_fill_rules(out, rules)
        parts.append(F.array(*[F.col(f"`{n}`").cast("double") for n in rules.columns if n != "key"]))
    final = cut(out.select("key", "y", "is_test", F.concat(*parts).alias("features")))
    counts = final.groupBy("is_test").agg(F.count(F.lit(1)).alias("n"), F.max(F.size("features")).alias("d")).collect()
    details |= {("n_test" if r["is_test"] else "n_train"): r["n"] for r in counts} | {"n_features": counts[0]["d"]}
    return SeedFeatures(final, details)


def ablation_runner(
    build: Callable[[tuple[bool, bool, bool], int], SeedFeatures],
    models: Callable[[int], dict[str, learn.Fit]],
    settings: dict[str, tuple[bool, bool, bool]] = SETTINGS,
    seeds: Sequence[int] = tuple(SEEDS),
    folds: int = FOLDS,
) -> DataFrame:
    """setting, seed, n_features and the five metrics for each setting and seed.

    The loop runs over settings, never over rows; each turn is a set of Spark jobs.
    """
    frames = []
    for name, flags in settings.items():
        for seed in seeds:
            made = build(flags, seed)
            train, test = made.rows.filter(~F.col("is_test")), made.rows.filter("is_test")
            scored = oof_stacking(train.drop("is_test"), test.drop("is_test"), models(seed), folds, seed)
            row = metrics.evaluate(cut(scored))
            head = [F.lit(name).alias("setting"), F.lit(seed).alias("seed"), F.lit(made.details["n_features"]).alias("n_features")]
            frames.append(cut(row.select(*head, *metrics.METRICS)))
    return _union(frames)


def ablation_summary(rows: DataFrame, baseline: str = "A") -> DataFrame:
    """Mean and deviation per setting, and the gain over the baseline."""
    return metrics.delta_vs_baseline(metrics.metrics_mean_std(rows, ["setting"]), baseline)


def permutation_importance(score: learn.Score, rows: DataFrame, seed: int = 42) -> DataFrame:
    """feature, auc_drop: loss of AUC when one feature is swapped between rows.

    Two seeded shuffles give each row a partner; for every feature the row is scored once with the
    partner's value in that place, so the work is rows x features and nothing is gathered.
    """
    one = hash_rank(rows.select("key", "y", "features"), [], F.col("key"), seed, "_turn")
    two = hash_rank(rows.select("key", "features"), [], F.col("key"), seed + 1, "_turn")
    partners = two.select("_turn", F.col("features").alias("_other"))
    paired = one.join(partners, "_turn").drop("_turn")
    spread = paired.select("key", "y", "features", F.posexplode("_other").alias("feature", "_value"))
    swapped = F.transform("features", lambda x, i: F.when(i == F.col("feature"), F.col("_value")).otherwise(x))
    scored = score(spread.select("key", "y", "feature", swapped.alias("features")))
    areas = metrics.roc_auc(scored, ["feature"], score="probability")
    base = metrics.roc_auc(score(rows), score="probability").first()[0]
    return areas.select("feature", (F.lit(base) - F.col("roc_auc")).alias("auc_drop"))


def compare_embeddings(
    triples: DataFrame,
    models: Sequence[str] = ("transe", "rotate", "complex"),
    k: int = neighbors.DEFAULT_K,
    min_cluster_size: int = density.MIN_CLUSTER_SIZE,
    prefix: str = PATIENT_PREFIX,
    **training,
) -> DataFrame:
    """The whole way from labelled triples (head, relation, tail) to one row for each embedding model:
    training, patient vectors, neighbour graph, communities, density clusters and their quality.

    The models run side by side, so ``train_time_sec`` is wall time on a shared cluster."""
    names, _, coded = kge.encode_triples(triples)
    names, coded = cut(names), cut(coded)

    def way(model: str) -> tuple[DataFrame, DataFrame, DataFrame]:
        start = time.perf_counter()
        entities, _, losses = kge.train_kge(coded, model, **training)
        seconds = time.perf_counter() - start
        points = cut(kge.patient_vectors(names, entities, prefix))
        edges = cut(neighbors.knn_graph(points, k))
        clusters = density.density_clusters(points, min_cluster_size=min_cluster_size)
        labelled = points.join(communities(edges), "key", "left").join(clusters.select("key", F.col("cluster").alias("density_cluster")), "key")
        extra = points.sparkSession.range(1).select(
            F.lit(vectors.dimension(points)).alias("dimension"),
            F.lit(len(losses)).alias("epochs"),
            F.lit(float(losses[-1])).alias("loss"),
            F.lit(round(seconds, 3)).alias("train_time_sec"),
        )
        return cut(labelled), edges, extra

    found = in_parallel(triples.sparkSession, [partial(way, model) for model in models])
    return model_comparison(dict(zip(models, found)))


def heldout_ranks(triples: DataFrame, models: Sequence[str] = ("transe", "rotate", "complex"), **training) -> DataFrame:
    """model, side, rank_type, metric, value: models are trained on the train part of the triples and rank
    the ends of the test part among all entities, other known triples left out."""
    _, _, coded = kge.encode_triples(triples)
    parts = cut(kge.split_triples(coded))
    train, test = (parts.filter(F.col("part") == p).select("head", "relation", "tail") for p in ("train", "test"))

    def way(model: str) -> DataFrame:
        entities, relations, _ = kge.train_kge(train, model, **training)
        ranks = linkpred.rank_candidates(test, parts.select("head", "relation", "tail"), entities, relations, model)
        return linkpred.rank_metrics(cut(ranks)).select(F.lit(model).alias("model"), "*")

    return _union(in_parallel(triples.sparkSession, [partial(way, model) for model in models]))


def model_comparison(frames: dict[str, tuple[DataFrame, DataFrame, DataFrame]]) -> DataFrame:
    """One row per embedding model from (points with cluster labels, edges, extra columns)."""
    rows = []
    for name, (points, edges, extra) in frames.items():
        summary = metrics.cluster_summary(points)
        quality = modularity(edges, points.select("key", F.col("community").alias("label")))
        shape = vectors.silhouette(points.withColumn("cluster", F.col("density_cluster")))
        joined = reduce(metrics.attach_row, [summary, quality, shape, extra])
        rows.append(joined.select(F.lit(name).alias("model"), "*"))
    return _union(rows)
