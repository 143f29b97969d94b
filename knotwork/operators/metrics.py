"""Classification metrics and their summaries. The positive class is 1."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from knotwork.operators.ordering import group_join, running_total
from knotwork.operators.skew import attach_row

# Metric columns of a result row.
METRICS = ["accuracy", "precision", "recall", "f1", "roc_auc"]


def _share(part: Column, whole: Column) -> Column:
    return F.coalesce(F.try_divide(part.cast("double"), whole.cast("double")), F.lit(0.0))


def binary_metrics(rows: DataFrame, by: Sequence[str] = (), label: str = "y", predicted: str = "prediction") -> DataFrame:
    """accuracy, precision, recall and f1; 0 where a denominator is 0."""
    truth, guess = F.col(label) == 1, F.col(predicted) == 1
    counts = rows.groupBy(*by).agg(
        F.count(F.lit(1)).alias("_n"),
        F.count_if(truth & guess).alias("_hit"),
        F.count_if(guess).alias("_guessed"),
        F.count_if(truth).alias("_true"),
        F.count_if(truth == guess).alias("_right"),
    )
    precision = _share(F.col("_hit"), F.col("_guessed"))
    recall = _share(F.col("_hit"), F.col("_true"))
    return counts.select(
        *by,
        _share(F.col("_right"), F.col("_n")).alias("accuracy"),
        precision.alias("precision"),
        recall.alias("recall"),
        _share(precision * recall * 2, precision + recall).alias("f1"),
    )


def roc_auc(rows: DataFrame, by: Sequence[str] = (), label: str = "y", score: str = "score") -> DataFrame:
    """Exact area under the ROC curve, ties counted half; null if a class is missing.

    Equal scores are merged first. The number of negatives below each score is a distributed
    prefix sum, so one huge group does not land in one task.
    """
    positive = (F.col(label) == 1).cast("long")
    merged = rows.groupBy(*by, F.col(score).alias("_score")).agg(
        F.sum(positive).alias("_pos"), F.sum(F.lit(1) - positive).alias("_neg")
    )
    ranked = running_total(merged, by, ["_score"], "_neg", "_below")
    # Doubles from here on: pair counts of large tables do not fit into a long.
    wins = F.sum(F.col("_pos").cast("double") * (F.col("_below") + F.col("_neg") / 2))
    pairs = F.sum("_pos").cast("double") * F.sum("_neg").cast("double")
    return ranked.groupBy(*by).agg(F.try_divide(wins, pairs).alias("roc_auc"))


def evaluate(rows: DataFrame, by: Sequence[str] = (), score: str = "probability", threshold: float = 0.5) -> DataFrame:
    """All five metrics of scored rows for each group."""
    marked = rows.withColumn("prediction", (F.col(score) >= threshold).cast("int"))
    plain = binary_metrics(marked, by)
    areas = roc_auc(rows, by, score=score)
    return group_join(plain, areas, by) if by else attach_row(plain, areas)


def confusion_matrix(rows: DataFrame, label: str = "y", predicted: str = "prediction") -> DataFrame:
    """Counts on the full 2 x 2 grid."""
    cells = [(actual, guess) for actual in (0, 1) for guess in (0, 1)]
    counts = rows.agg(
        *[F.count_if((F.col(label) == a) & (F.col(predicted) == g)).alias(f"n{a}{g}") for a, g in cells]
    )
    grid = [F.struct(F.lit(a).alias("actual"), F.lit(g).alias("predicted"), F.col(f"n{a}{g}").alias("n")) for a, g in cells]
    return counts.select(F.inline(F.array(*grid)))


def metrics_mean_std(rows: DataFrame, by: Sequence[str], metrics: Sequence[str] = tuple(METRICS)) -> DataFrame:
    """Mean and sample standard deviation over seeds; 0 for a single seed."""
    columns = [F.count(F.lit(1)).alias("n_seeds")]
    for name in metrics:
        columns.append(F.avg(name).alias(f"{name}_mean"))
        columns.append(F.coalesce(F.stddev_samp(name), F.lit(0.0)).alias(f"{name}_std"))
    return rows.groupBy(*by).agg(*columns)


def delta_vs_baseline(
    summary: DataFrame, baseline: str, metrics: Sequence[str] = ("f1_mean", "roc_auc_mean"), name: str = "setting"
) -> DataFrame:
    """Metric minus the baseline's metric; the baseline is a single row."""
    base = summary.filter(F.col(name) == baseline).select(*[F.col(m).alias(f"_{m}") for m in metrics])
    joined = attach_row(summary, base)
    deltas = {f"delta_{m}": F.col(m) - F.col(f"_{m}") for m in metrics}
    return joined.withColumns(deltas).drop(*[f"_{m}" for m in metrics])


def best_candidate(
    rows: DataFrame, candidate: str = "candidate", score: str = "auc", grid: Sequence | None = None
) -> DataFrame:
    """Candidate with the greatest mean score; the first of ``grid`` wins a tie, or the least one without a grid."""
    means = rows.groupBy(candidate).agg(F.avg(score).alias("mean_score"))
    place = F.array_position(F.array(*[F.lit(c) for c in grid]), F.col(candidate)) if grid else F.col(candidate)
    return means.orderBy(F.desc("mean_score"), place).limit(1)


def cluster_summary(clusters: DataFrame) -> DataFrame:
    """Patients, communities, density clusters without noise, and share of noise."""
    density = F.col("density_cluster")
    return clusters.agg(
        F.count(F.lit(1)).alias("patients"),
        F.countDistinct("community").alias("communities"),
        F.countDistinct(F.when(density != -1, density)).alias("density_clusters"),
        F.avg((density == -1).cast("double")).alias("noise_ratio"),
    )
