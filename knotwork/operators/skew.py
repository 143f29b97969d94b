"""Joins and spread aggregates for a side of which one key may hold a large share."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# A key with more left rows than this is split; so at most (left rows / HOT_ROWS) keys are hot
# and the broadcast list of them stays small.
HOT_ROWS = 1_000_000
SALTS = 64


def hot_keys(rows: DataFrame, on: Sequence[str], hot_rows: int = HOT_ROWS) -> DataFrame:
    """Keys with more than ``hot_rows`` rows, counted with partial sums."""
    counts = rows.groupBy(*on).agg(F.count(F.lit(1)).alias("_rows"))
    return counts.filter(F.col("_rows") > hot_rows).select(*on, F.lit(True).alias("_hot"))


def spread(rows: DataFrame, on: Sequence[str], hot: DataFrame, salts: int = SALTS) -> DataFrame:
    """Adds ``_salt``: rows of a hot key get a hash of the whole row, so a retried task repeats it."""
    salt = F.when(F.col("_hot"), F.pmod(F.xxhash64(*rows.columns), F.lit(salts)).cast("int")).otherwise(0)
    return rows.join(F.broadcast(hot), list(on), "left").withColumn("_salt", salt).drop("_hot")


def copies(rows: DataFrame, on: Sequence[str], hot: DataFrame, salts: int = SALTS) -> DataFrame:
    """The other side: one copy per salt for hot keys, one row for the rest."""
    every = F.when(F.col("_hot"), F.sequence(F.lit(0), F.lit(salts - 1))).otherwise(F.array(F.lit(0)))
    return rows.join(F.broadcast(hot), list(on), "left").withColumn("_salt", F.explode(every)).drop("_hot")


def salted_join(
    left: DataFrame,
    right: DataFrame,
    on: Sequence[str],
    how: str = "inner",
    hot_rows: int = HOT_ROWS,
    salts: int = SALTS,
    count_on: DataFrame | None = None,
) -> DataFrame:
    """Equi-join of which one key may hold a large share of the left rows.

    Adaptive execution splits the partitions of such keys at run time, so no key is counted ahead
    and the left side is read once. The last three arguments are those of callers that spread the
    rows of an aggregate by ``spread`` and ``copies``; a join needs none of them.
    """
    return left.join(right, list(on), how)


def attach_row(df: DataFrame, row: DataFrame) -> DataFrame:
    """The columns of a one-row table next to every row; only that one row is broadcast."""
    single = F.broadcast(row.limit(1).withColumn("_one", F.lit(1)))
    return df.withColumn("_one", F.lit(1)).join(single, "_one").drop("_one")
