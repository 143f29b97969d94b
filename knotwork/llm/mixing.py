"""Mixing sources to target weights by Poisson replication.

The size of a source is the characters of its texts. Its target repetition rate is the wanted share
of all characters over its own share. Each document draws a count from a Poisson distribution with
that mean, by inverting the distribution at a seeded hash of its id, is exploded by its count, and
the copies are put into one global order by another seeded hash. Expressions only, no Python code.

A mean above ``MEAN_STEP`` is a sum of equal smaller means, each with its own hash, so no table of
probabilities underflows. Sizes are summed with partial sums, so a source with a third of the rows
is no hot group; the table of rates is joined by ``sized_join``.

Defined results: null source is a source of its own; null or empty texts count 0 characters and are
drawn at the rate of their source; a source of 0 characters is drawn at rate 1; repeated rows draw
the same count, since the count hangs on the id; equal order hashes go by id and copy; extra
columns are kept; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from knotwork.llm.common import sized_join, unit_hash
from knotwork.session import cut

SEED = 8
MEAN_STEP = 16.0
# Weights of a source where none are given: its characters to this power, between natural (1) and even (0).
TEMPERATURE = 0.5


def poisson_table(mean: Column) -> Column:
    """Probabilities of at most 0, 1, 2 ... events, up to where the rest is below double precision."""
    last = F.ceil(mean + 10 * F.sqrt(mean) + 20).cast("int")
    start = F.struct(F.exp(-mean).alias("p"), F.array(F.exp(-mean)).alias("table"))

    def step(state: Column, k: Column) -> Column:
        p = state["p"] * mean / k
        return F.struct(p.alias("p"), F.concat(state["table"], F.array(F.element_at(state["table"], -1) + p)).alias("table"))

    return F.aggregate(F.sequence(F.lit(1), last), start, step, lambda state: state["table"])


def source_rates(documents: DataFrame, weights: Mapping[str, float] | None = None, temperature: float = TEMPERATURE) -> DataFrame:
    """source, size, rate, steps, table: how often each source is to be repeated, and its distribution."""
    sizes = cut(documents.groupBy("source").agg(F.sum(F.coalesce(F.char_length("text"), F.lit(0))).cast("double").alias("size")))
    if weights is None:
        weighed = sizes.withColumn("weight", F.pow("size", F.lit(temperature)))
    else:
        given = F.create_map(*[F.lit(x) for pair in weights.items() for x in pair])
        weighed = sizes.withColumn("weight", F.coalesce(F.try_element_at(given, F.coalesce("source", F.lit(""))), F.lit(0.0)))
    all_weights, all_sizes = [float(x or 0.0) for x in weighed.agg(F.sum("weight"), F.sum("size")).first()]
    share = F.try_divide(F.col("weight"), F.lit(all_weights))
    rate = F.when(F.col("size") > 0, F.coalesce(share, F.lit(0.0)) * F.lit(all_sizes) / F.col("size")).otherwise(1.0)
    rated = weighed.withColumn("rate", rate)
    steps = F.greatest(F.lit(1), F.ceil(F.col("rate") / MEAN_STEP)).cast("int")
    return rated.withColumn("steps", steps).select(
        "source", "size", "rate", "steps", poisson_table(F.col("rate") / F.col("steps")).alias("table")
    )


def repetitions(seed: int, key: Column, steps: Column, table: Column) -> Column:
    """The count of a row: how many probabilities of its source's table lie at or below its hash, summed over the steps."""
    hashes = F.transform(F.sequence(F.lit(1), steps), lambda step: unit_hash(seed, key, step))
    return F.aggregate(hashes, F.lit(0), lambda n, u: n + F.size(F.filter(table, lambda p: p <= u)))


def replicate(
    documents: DataFrame,
    weights: Mapping[str, float] | None = None,
    seed: int = SEED,
    temperature: float = TEMPERATURE,
    copy: str = "copy",
    shuffle_key: str = "shuffle_key",
) -> DataFrame:
    """Every row as often as it is drawn, with its ``copy`` (from 0) and ``shuffle_key``, not yet ordered.

    Columns of ``documents`` with these two names are replaced; other names can be given for them.
    """
    rates = source_rates(documents, weights, temperature).select(
        F.col("source").alias("_mix_source"), F.col("steps").alias("_mix_steps"), F.col("table").alias("_mix_table")
    )
    rated = sized_join(documents.withColumn("_mix_source", F.col("source")), rates, ["_mix_source"])
    count = repetitions(seed, F.col("doc_id"), F.col("_mix_steps"), F.col("_mix_table"))
    drawn = rated.withColumn("_mix_n", count).drop("_mix_steps", "_mix_table", "_mix_source").filter("_mix_n > 0")
    copies = drawn.withColumn(copy, F.explode(F.sequence(F.lit(0), F.col("_mix_n") - 1))).drop("_mix_n")
    return copies.withColumn(shuffle_key, unit_hash(seed + 1, F.col("doc_id"), F.col(copy)))


def mix_sources(
    documents: DataFrame,
    weights: Mapping[str, float] | None = None,
    seed: int = SEED,
    temperature: float = TEMPERATURE,
    copy: str = "copy",
    shuffle_key: str = "shuffle_key",
) -> DataFrame:
    """``replicate`` in the global order of the shuffle key."""
    return replicate(documents, weights, seed, temperature, copy, shuffle_key).orderBy(shuffle_key, "doc_id", copy)
