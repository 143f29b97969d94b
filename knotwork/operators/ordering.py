"""Exact ranks, prefix sums and quantiles for groups of any size.

A window over a group runs in one task, which fails when one group holds a third of the table.
Here the rows are range-partitioned on (group, order), each range is numbered on its own, and the
small table of range totals supplies the offsets.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from knotwork.functions.scalars import stable_hash
from knotwork.operators.skew import attach_row
from knotwork.session import cut

# Hex digits of the hash that name a slice: 65536 slices for each group.
SLICE_DIGITS = 4


def group_join(rows: DataFrame, table: DataFrame, on: Sequence[str], how: str = "inner") -> DataFrame:
    """Equi-join on group columns under which a null group meets itself, as in ``groupBy``."""
    renamed = table.withColumnsRenamed({name: f"_on_{name}" for name in on})
    same = [rows[name].eqNullSafe(renamed[f"_on_{name}"]) for name in on]
    return rows.join(renamed, same, how).drop(*[f"_on_{name}" for name in on])


def running_total(
    df: DataFrame, group: Sequence[str], order: Sequence[Column | str], value: str, out: str = "before"
) -> DataFrame:
    """Sum of ``value`` over the earlier rows of the same group.

    ``order`` must tell the rows of a group apart; pre-aggregate equal keys first.
    """
    keys = [F.col(name) for name in group]
    sort = [F.col(item) if isinstance(item, str) else item for item in order]
    ranged = cut(df.repartitionByRange(*keys, *sort).withColumn("_range", F.spark_partition_id()))
    totals = ranged.groupBy("_range", *group).agg(F.sum(value).alias("_sum"))
    earlier_ranges = Window.partitionBy(*group).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(
        "_range", *group, F.coalesce(F.sum("_sum").over(earlier_ranges), F.lit(0)).alias("_offset")
    )
    earlier_rows = Window.partitionBy("_range", *group).orderBy(*sort).rowsBetween(Window.unboundedPreceding, -1)
    local = ranged.withColumn("_local", F.coalesce(F.sum(value).over(earlier_rows), F.lit(0)))
    return (
        group_join(local, offsets, ["_range", *group])
        .withColumn(out, F.col("_offset") + F.col("_local"))
        .drop("_range", "_offset", "_local")
    )


def dense_ids(labels: DataFrame, column: str, out: str = "id") -> DataFrame:
    """Distinct labels numbered from 0 in label order."""
    named = labels.select(F.col(column).alias("label")).filter(F.col("label").isNotNull()).distinct()
    ranged = cut(named.repartitionByRange("label").withColumn("_range", F.spark_partition_id()))
    totals = ranged.groupBy("_range").agg(F.count(F.lit(1)).alias("_rows"))
    # One row for each range, so this single window stays as small as the number of partitions.
    earlier = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select("_range", F.coalesce(F.sum("_rows").over(earlier), F.lit(0)).alias("_offset"))
    place = F.row_number().over(Window.partitionBy("_range").orderBy("label")) - 1
    return (
        ranged.withColumn("_place", place)
        .join(F.broadcast(offsets), "_range")
        .select((F.col("_offset") + F.col("_place")).cast("long").alias(out), "label")
    )


def hash_rank(df: DataFrame, group: Sequence[str], key: Column, seed: int, out: str = "rank") -> DataFrame:
    """1-based place of each row in a seeded shuffle of its group.

    The order is SHA-1 of seed and key. Its first digits cut every group into even slices, so a
    class with most of the rows is spread over many tasks; slice counts give the offsets.
    """
    hashed = df.withColumn("_hash", F.sha1(F.concat(F.lit(f"{seed}|"), key.cast("string")).cast("binary")))
    sliced = hashed.withColumn("_slice", F.substring("_hash", 1, SLICE_DIGITS))
    counts = sliced.groupBy(*group, "_slice").agg(F.count(F.lit(1)).alias("_rows"))
    # At most 65536 rows for each group.
    earlier = Window.partitionBy(*group).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(*group, "_slice", F.coalesce(F.sum("_rows").over(earlier), F.lit(0)).alias("_offset"))
    inside = Window.partitionBy(*group, "_slice").orderBy("_hash")
    return (
        group_join(sliced.withColumn("_place", F.row_number().over(inside)), offsets, [*group, "_slice"])
        .withColumn(out, (F.col("_offset") + F.col("_place")).cast("long"))
        .drop("_hash", "_slice", "_place", "_offset")
    )


def hash_share(key: Column, seed: int) -> Column:
    """Seeded uniform number in [0, 1) from the first 13 hex digits of SHA-1."""
    digits = stable_hash(F.concat(F.lit(f"{seed}|"), key.cast("string")), 13)
    return F.conv(digits, 16, 10).cast("double") / F.lit(float(16**13))


def grouped_quantiles(
    df: DataFrame, group: Sequence[str], value: str, shares: dict[str, float]
) -> DataFrame:
    """Exact linear-interpolation quantiles, one column for each named share.

    Equal values are counted first; the running count then says which value sits at which place.
    """
    counted = df.filter(F.col(value).isNotNull()).groupBy(*group, value).agg(F.count(F.lit(1)).alias("_n"))
    placed = running_total(counted, group, [value], "_n", "_first")
    sizes = counted.groupBy(*group).agg(F.sum("_n").alias("_size"))
    joined = group_join(placed, sizes, group) if group else attach_row(placed, sizes)
    last = F.col("_first") + F.col("_n") - 1

    def at(place: Column) -> Column:
        return F.max(F.when((F.col("_first") <= place) & (place <= last), F.col(value)))

    columns = [F.max("_size").alias("_size")]
    for name, share in shares.items():
        spot = F.lit(share) * (F.col("_size") - 1)
        columns += [at(F.floor(spot)).alias(f"_{name}_low"), at(F.ceil(spot)).alias(f"_{name}_high")]
    picked = joined.groupBy(*group).agg(*columns)
    out = [F.col(name) for name in group]
    for name, share in shares.items():
        spot = F.lit(share) * (F.col("_size") - 1)
        low, high = F.col(f"_{name}_low"), F.col(f"_{name}_high")
        out.append((low + (high - low) * (spot - F.floor(spot))).alias(name))
    return picked.select(*out, F.col("_size").alias("n"))
