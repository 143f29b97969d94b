"""Seeded splits that any engine can repeat: rows are ordered by SHA-1 of seed and key."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from knotwork.operators.ordering import group_join, hash_rank

TEST_SHARE = 0.2
FOLDS = 5
SEEDS = [42, 43, 44, 45, 46]


def stratified_split(
    rows: DataFrame, seed: int = 42, share: float = TEST_SHARE, key: str = "key", label: str = "y"
) -> DataFrame:
    """Adds ``is_test``: ceil(share * n) rows over all, shared out by class size.

    Each class gives the whole part of its share; what is missing comes from the classes with the
    largest remainders, the greater class on a tie.
    """
    sizes = rows.groupBy(label).agg(F.count(F.lit(1)).alias("_size"))
    # Class tables: one row for each class.
    everything = Window.partitionBy()
    share_of = F.col("_size") * F.lit(share)
    quota = (
        sizes.withColumn("_whole", F.floor(share_of))
        .withColumn("_rest", F.round(share_of - F.col("_whole"), 9))
        .withColumn("_missing", F.ceil(F.round(F.sum("_size").over(everything) * F.lit(share), 9)) - F.sum("_whole").over(everything))
        .withColumn("_turn", F.row_number().over(Window.orderBy(F.desc("_rest"), F.desc(label))))
        .select(label, (F.col("_whole") + (F.col("_turn") <= F.col("_missing")).cast("int")).alias("_quota"))
    )
    ranked = hash_rank(rows, [label], F.col(key), seed, "_rank")
    marked = group_join(ranked, F.broadcast(quota), [label])
    return marked.withColumn("is_test", F.col("_rank") <= F.col("_quota")).drop("_rank", "_quota")


def stratified_folds(
    rows: DataFrame, seed: int = 42, folds: int = FOLDS, key: str = "key", label: str = "y"
) -> DataFrame:
    """Adds ``fold`` in [0, folds), even within each class."""
    ranked = hash_rank(rows, [label], F.col(key), seed, "_rank")
    return ranked.withColumn("fold", ((F.col("_rank") - 1) % folds).cast("int")).drop("_rank")
