"""Feature tables: numeric predicates, joins with vectors, clusters and rules, column assembly."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from knotwork.functions.scalars import binary_label, safe_float
from knotwork.operators.skew import attach_row
from knotwork.operators.triples import PATIENT_PREFIX, is_patient

NOISE = -1


def numeric_predicates(
    triples: DataFrame,
    prefix: str = PATIENT_PREFIX,
    match: str = "contains",
    label_predicate: str | None = None,
    exclude_label: bool = True,
) -> DataFrame:
    """Predicates with at least one numeric literal on a patient, in order.

    The label predicate is left out unless ``exclude_label`` is False: a numeric label among the
    features gives the answer away.
    """
    rows = triples.filter((F.col("obj_kind") == "literal") & is_patient("subj", prefix, match))
    if exclude_label and label_predicate:
        rows = rows.filter(F.col("pred") != label_predicate)
    return rows.filter(safe_float(F.col("obj")).isNotNull()).select("pred").distinct().orderBy("pred")


def feature_matrix(
    triples: DataFrame,
    label_predicate: str,
    positive: str,
    prefix: str = PATIENT_PREFIX,
    match: str = "contains",
    exclude_label: bool = True,
    names: Sequence[str] | None = None,
    minimum_rows: int = 0,
) -> DataFrame:
    """Complete cases: key, y and one column for each numeric predicate.

    The predicate list is schema-sized and fixed before the pivot, so the pivot is one
    aggregation with partial sums. Several values of one predicate count as their least.
    """
    if names is None:
        found = numeric_predicates(triples, prefix, match, label_predicate, exclude_label)
        names = [row["pred"] for row in found.collect()]
    if not names:
        raise ValueError("no numeric predicate on any patient")
    wanted = list(dict.fromkeys([*names, label_predicate]))
    rows = triples.filter(is_patient("subj", prefix, match) & F.col("pred").isin(wanted))

    def least(name: str) -> Column:
        value = F.when(F.col("obj_kind") == "literal", safe_float(F.col("obj")))
        return F.min(F.when(F.col("pred") == name, value)).alias(name)

    label = F.min(F.when(F.col("pred") == label_predicate, F.col("obj"))).alias("_label")
    wide = rows.groupBy(F.col("subj").alias("key")).agg(label, *[least(name) for name in names])
    present = [F.col("_label").isNotNull(), *[F.col(f"`{name}`").isNotNull() for name in names]]
    complete = wide.filter(reduce(Column.__and__, present))
    out = complete.select(
        "key", binary_label(F.col("_label"), positive).alias("y"), *[F.col(f"`{name}`") for name in names]
    )
    if minimum_rows and len(out.take(minimum_rows)) < minimum_rows:
        raise ValueError(f"fewer than {minimum_rows} complete patients")
    return out


def require_unique(df: DataFrame, key: str = "key") -> DataFrame:
    """Fail, instead of multiplying rows, if a side table repeats a key."""
    if df.groupBy(key).agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") > 1).take(1):
        raise ValueError(f"{key} is not unique")
    return df


def left_join_dropna(rows: DataFrame, embeddings: DataFrame, vector: str = "vec") -> DataFrame:
    """Rows that have a vector without missing parts; the side table must not repeat a key."""
    joined = rows.join(require_unique(embeddings), "key", "left")
    return joined.filter(F.col(vector).isNotNull() & ~F.exists(vector, lambda x: x.isNull() | F.isnan(x)))


def dropped_rows(before: DataFrame, after: DataFrame) -> DataFrame:
    """One row: how many rows went in, stayed and were dropped."""
    counts = attach_row(before.agg(F.count(F.lit(1)).alias("rows")), after.agg(F.count(F.lit(1)).alias("kept")))
    return counts.select("rows", "kept", (F.col("rows") - F.col("kept")).alias("dropped"))


def left_join_fill_clusters(
    rows: DataFrame, clusters: DataFrame, columns: Sequence[str] = ("community", "density_cluster")
) -> DataFrame:
    """Cluster labels next to each row; a row without one is noise."""
    joined = rows.join(require_unique(clusters.select("key", *columns)), "key", "left")
    return joined.withColumns({name: F.coalesce(F.col(name), F.lit(NOISE)).cast("int") for name in columns})


def left_join_fill_rules(rows: DataFrame, rules: DataFrame) -> DataFrame:
    """Rule features next to each row; missing ones are 0."""
    names = [name for name in rules.columns if name != "key"]
    return rows.join(require_unique(rules), "key", "left").fillna(0.0, subset=names)


def inner_join_align(features: DataFrame, embeddings: DataFrame) -> DataFrame:
    """Rows present on both sides; the label travels as a column."""
    return features.join(require_unique(embeddings), "key")


def known_values(rows: DataFrame, column: str, include_noise: bool) -> list[int]:
    """Distinct cluster labels, read back in order; as many as there are clusters."""
    values = rows.select(column).distinct()
    if not include_noise:
        values = values.filter(F.col(column) != NOISE)
    return sorted(row[0] for row in values.collect())


def one_hot(rows: DataFrame, column: str, values: Sequence[int], prefix: str) -> DataFrame:
    """One 0/1 column for each known value; other values are all zeros. At least one column."""
    if not values:
        return rows.withColumn(f"{prefix}_none", F.lit(0.0))
    columns = {f"{prefix}_{value}": F.coalesce((F.col(column) == value).cast("double"), F.lit(0.0)) for value in values}
    return rows.withColumns(columns)


def onehot_all(rows: DataFrame, column: str, prefix: str) -> DataFrame:
    """Categories from all rows, noise included."""
    return one_hot(rows, column, known_values(rows, column, include_noise=True), prefix)


def onehot_train(rows: DataFrame, column: str, prefix: str, train: Column) -> DataFrame:
    """Categories from training rows only; noise and unseen labels are all zeros."""
    return one_hot(rows, column, known_values(rows.filter(train), column, include_noise=False), prefix)


def numeric_rule_columns(rules: DataFrame) -> DataFrame:
    """Rule columns that hold at least one number, as doubles with 0 for the rest."""
    names = [name for name in rules.columns if name != "key"]
    parsed = {name: safe_float(F.col(f"`{name}`").cast("string")) for name in names}
    counts = rules.agg(*[F.count(parsed[name]).alias(name) for name in names]).first()
    kept = [name for name in names if counts[name]]
    if not kept:
        raise ValueError("no numeric rule column")
    return rules.select("key", *[F.coalesce(parsed[name], F.lit(0.0)).alias(name) for name in kept])


def assemble_features(
    features: DataFrame,
    embeddings: DataFrame | None = None,
    clusters: DataFrame | None = None,
    rules: DataFrame | None = None,
) -> DataFrame:
    """key, y, features: raw columns, then embedding, one-hot clusters and rules as given.

    All sides are keyed alike, so Spark can reuse one hash partitioning for the chain of joins.
    """
    raw = [name for name in features.columns if name not in ("key", "y")]
    out = features
    parts = [F.array(*[F.col(f"`{name}`").cast("double") for name in raw])]
    if embeddings is not None:
        out = left_join_dropna(out, embeddings.select("key", F.col("vec").alias("_vec")), "_vec")
        parts.append(F.col("_vec"))
    if clusters is not None:
        out = left_join_fill_clusters(out, clusters)
        before = set(out.columns)
        for name in ("community", "density_cluster"):
            out = onehot_all(out, name, name)
        parts.append(F.array(*[F.col(name) for name in out.columns if name not in before]))
    if rules is not None:
        names = [name for name in rules.columns if name != "key"]
        renamed = rules.select("key", *[F.col(f"`{name}`").alias(f"_rule_{name}") for name in names])
        out = left_join_fill_rules(out, renamed)
        parts.append(F.array(*[F.col(f"`_rule_{name}`").cast("double") for name in names]))
    return out.select("key", "y", F.concat(*parts).alias("features"))


def long_form(rows: DataFrame, vector: str = "features") -> DataFrame:
    """key, position, value."""
    return rows.select("key", F.posexplode(vector).alias("position", "value"))


def union_settings(frames: dict[str, DataFrame], name: str = "setting") -> DataFrame:
    """Frames on top of each other, each marked with its setting."""
    marked = [frame.withColumn(name, F.lit(setting)) for setting, frame in frames.items()]
    return reduce(DataFrame.unionByName, marked)
