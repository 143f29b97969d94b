"""Base classifiers on rows (key, y, features), each as ``fit(train) -> score``.

``score(rows)`` adds ``probability``. Scaling is fitted with the classifier on the same training
rows, so no fold sees another fold's statistics.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from functools import partial

import numpy as np
from pyspark.ml import Pipeline
from pyspark.ml.classification import (
    GBTClassifier,
    LinearSVC,
    LogisticRegression,
    MultilayerPerceptronClassifier,
    RandomForestClassifier,
)
from pyspark.ml.feature import StandardScaler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.linalg import VectorUDT
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from knotwork.operators.blocks import list_column, matrix
from knotwork.operators.gated import GatedConfig, fit_gated
from knotwork.operators.neighbors import knn
from knotwork.operators.skew import salted_join
from knotwork.operators.trees import Forest, ForestModel, mean_shares, packed_rows
from knotwork.operators.vectors import dimension, standardize
from knotwork.session import cut, in_parallel

Score = Callable[[DataFrame], DataFrame]
Fit = Callable[[DataFrame], Score]

# Presets of the boosted trees (rounds, rate, depth, row share, column share).
BOOSTED_PRESETS = {
    "A": (500, 0.05, 5, 0.9, "0.9"),
    "B": (800, 0.03, 5, 0.9, "0.9"),
}
# Spark's deepest tree, and the widest vectors whose trees are grown on plain numbers.
DEEPEST, WIDEST = 30, 16_384
# Trees that are grown in one fit, and how far apart the seeds of the parts of a forest lie.
PART_TREES = 64
PART_SEEDS = 1_000_003


def _pipeline(estimator, scaled: bool = True) -> Fit:
    """Scaler (optional) and a Spark ML classifier on the features, an array or a vector. Vectors are not
    centered, so that sparse ones stay sparse; models with a free intercept do not depend on it."""

    def fit(train: DataFrame) -> Score:
        source = "_scaled" if scaled else "_vector"
        centered = not _is_vector(train)
        stages = [StandardScaler(inputCol="_vector", outputCol="_scaled", withMean=centered)] if scaled else []
        clf = estimator(train)
        names = {
            "featuresCol": source,
            "labelCol": "y",
            "predictionCol": "_prediction",
            "rawPredictionCol": "_raw",
            "probabilityCol": "_probability",
        }
        for name, value in names.items():
            if clf.hasParam(name):
                clf.set(clf.getParam(name), value)
        model = Pipeline(stages=[*stages, clf]).fit(_vectors(train))
        calibrate = None
        if not clf.hasParam("probabilityCol"):
            calibrate = _platt(model.transform(_vectors(train)))

        def score(rows: DataFrame) -> DataFrame:
            out = model.transform(_vectors(rows))
            chance = vector_to_array("_probability")[1] if calibrate is None else calibrate(out)
            return out.select(*rows.columns, chance.alias("probability"))

        return score

    return fit


def _is_vector(rows: DataFrame) -> bool:
    return isinstance(rows.schema["features"].dataType, VectorUDT)


def _vectors(rows: DataFrame) -> DataFrame:
    return rows.withColumn("_vector", F.col("features") if _is_vector(rows) else array_to_vector("features"))


def _platt(scored: DataFrame):
    """Logistic curve from a margin to a probability; two numbers are read back."""
    margin = scored.select("y", array_to_vector(F.array(vector_to_array("_raw")[1])).alias("_margin"))
    curve = LogisticRegression(featuresCol="_margin", labelCol="y", maxIter=100).fit(margin)
    slope, shift = float(curve.coefficients[0]), float(curve.intercept)
    return lambda rows: F.lit(1.0) / (F.lit(1.0) + F.exp(-(vector_to_array("_raw")[1] * slope + shift)))


def logistic(c: float = 1.0, max_iter: int = 3000) -> Fit:
    """L2 logistic regression; the penalty is per row in Spark, hence 1 / (c * rows)."""
    return _pipeline(
        lambda train: LogisticRegression(regParam=1.0 / (c * max(train.count(), 1)), maxIter=max_iter, standardization=False)
    )


def forest(trees: int = 500, depth: int | None = None, leaf: int = 1, seed: int = 42) -> Fit:
    """Random forest: rows drawn with replacement, the root of the features at each node, every gap between two values as
    a split, and no limit of depth unless given (``trees.grow``). Trees do not depend on scale, so there is no scaler.

    Trees know nothing of each other, so a large forest is grown in parts at the same time; its probability is the
    mean over all trees. Vectors of more than WIDEST positions, which a task should not hold as plain
    numbers, go to Spark's forest, whose trees know 32 bins of a feature and 30 levels.
    """
    sizes = [len(part) for part in np.array_split(np.arange(trees), math.ceil(trees / PART_TREES))]

    def wide_grower(size: int, number: int) -> Fit:
        return _pipeline(
            lambda train: RandomForestClassifier(
                numTrees=size, maxDepth=depth or DEEPEST, minInstancesPerNode=leaf, seed=seed + number * PART_SEEDS
            ),
            scaled=False,
        )

    def grow(size: int, number: int, table: DataFrame) -> ForestModel:
        clf = Forest(size, depth, leaf, seed + number * PART_SEEDS)
        clf.setParams(featuresCol="_vector", labelCol="y", probabilityCol="_probability")
        return Pipeline(stages=[clf]).fit(table).stages[-1]

    def fit_wide(train: DataFrame) -> Score:
        growers = [wide_grower(size, number) for number, size in enumerate(sizes)]
        scorers = in_parallel(train.sparkSession, [partial(grow, train) for grow in growers])

        def score(rows: DataFrame) -> DataFrame:
            out, names = rows, []
            for number, scorer in enumerate(scorers):
                names.append(f"_part_{number}")
                out = scorer(out).withColumnRenamed("probability", names[-1])
            chance = sum(F.col(name) * size for name, size in zip(names, sizes)) / trees
            return out.select(*rows.columns, chance.alias("probability"))

        return score

    def fit(train: DataFrame) -> Score:
        if _is_vector(train) and (first := train.filter("features is not null").first()) and first["features"].size > WIDEST:
            return fit_wide(train)
        table = cut(packed_rows(_vectors(train), "_vector", "y"))
        models = in_parallel(train.sparkSession, [partial(grow, size, number, table) for number, size in enumerate(sizes)])

        def score(rows: DataFrame) -> DataFrame:
            return mean_shares(_vectors(rows), models, "_vector", "probability").select(*rows.columns, "probability")

        return score

    return fit


def mlp(hidden: tuple[int, ...] = (128, 64), max_iter: int = 600, seed: int = 42) -> Fit:
    return _pipeline(
        lambda train: MultilayerPerceptronClassifier(
            layers=[dimension(train, "features"), *hidden, 2], maxIter=max_iter, seed=seed
        )
    )


def boosted(preset: str = "A", rounds: int | None = None, seed: int = 42) -> Fit:
    """Boosted trees under one of two presets."""
    default, rate, depth, rows, columns = BOOSTED_PRESETS[preset]
    options = {"stepSize": rate, "maxDepth": depth, "subsamplingRate": rows, "featureSubsetStrategy": columns}
    return _pipeline(lambda train: GBTClassifier(maxIter=rounds or default, seed=seed, **options), scaled=False)


def kernel_svm(c: float = 2.0, gamma: float | None = None, waves: int = 256, seed: int = 42, max_iter: int = 100) -> Fit:
    """RBF machine through random Fourier waves and a linear SVM with calibrated margins.

    The dot product of the waves tends to exp(-gamma |x - y|^2); gamma is 1 / features for scaled
    rows unless given.
    """

    def fit(train: DataFrame) -> Score:
        dim = dimension(train, "features")
        rng = np.random.default_rng(seed)
        spread = math.sqrt(2 * (gamma or 1.0 / dim))
        ways, shifts = rng.normal(size=(dim, waves)) * spread, rng.uniform(0, 2 * math.pi, waves)
        height = math.sqrt(2.0 / waves)

        def lift(rows: DataFrame) -> DataFrame:
            scaled = standardize(rows, "features", fit_on=train)

            def work(batches):
                for batch in batches:
                    place = batch.schema.get_field_index("features")
                    values = height * np.cos(matrix(batch.column(place)).reshape(-1, dim) @ ways + shifts)
                    yield batch.set_column(place, "features", list_column(values))

            return scaled.mapInArrow(work, scaled.schema)

        inner = _pipeline(
            lambda lifted: LinearSVC(regParam=1.0 / (c * max(train.count(), 1)), maxIter=max_iter, standardization=False),
            scaled=False,
        )
        scorer = inner(lift(train))
        return lambda rows: scorer(lift(rows))

    return fit


def nearest_vote(k: int = 7, scaled: bool = True) -> Fit:
    """Share of positives among the k nearest training rows; keys must be unique."""

    def fit(train: DataFrame) -> Score:
        def points(rows: DataFrame) -> DataFrame:
            ready = standardize(rows, "features", fit_on=train) if scaled else rows
            return ready.select("key", F.col("features").alias("vec"))

        def score(rows: DataFrame) -> DataFrame:
            near = cut(knn(points(train), k, points(rows), include_self=True))
            labels = train.select(F.col("key").alias("dst"), F.col("y").alias("_y"))
            votes = salted_join(near, labels, ["dst"]).groupBy(F.col("src").alias("key")).agg(F.avg("_y").alias("probability"))
            return rows.join(votes, "key")

        return score

    return fit


def gated(config: GatedConfig = GatedConfig()) -> Fit:
    """The gated network on scaled rows."""

    def fit(train: DataFrame) -> Score:
        model = fit_gated(standardize(train, "features"), config)
        return lambda rows: model.score(standardize(rows, "features", fit_on=train)).drop("gate")

    return fit


def default_models(seed: int = 42) -> dict[str, Fit]:
    """The base models of the stack."""
    return {
        "logistic": logistic(),
        "neighbors": nearest_vote(),
        "kernel_svm": kernel_svm(seed=seed),
        "forest": forest(seed=seed),
        "mlp": mlp(seed=seed),
        "boosted_a": boosted("A", seed=seed),
        "boosted_b": boosted("B", seed=seed),
    }


def default_grids(seed: int = 42) -> dict[str, dict[str, Fit]]:
    """Parameter grids per base model."""
    depths, leaves = [None, 5, 10], [1, 2, 4]
    return {
        "logistic": {f"c={c}": logistic(c) for c in (0.1, 1.0, 10.0)},
        "neighbors": {f"k={k}": nearest_vote(k) for k in (5, 7, 11)},
        "kernel_svm": {f"c={c}": kernel_svm(c, seed=seed) for c in (0.5, 2.0, 8.0)},
        "forest": {f"depth={d},leaf={m}": forest(depth=d, leaf=m, seed=seed) for d in depths for m in leaves},
        "mlp": {f"hidden={h}": mlp(h, seed=seed) for h in ((64, 32), (128, 64))},
        "boosted_a": {"A": boosted("A", seed=seed)},
        "boosted_b": {"B": boosted("B", seed=seed)},
    }
