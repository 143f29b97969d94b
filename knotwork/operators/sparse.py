"""Feature rows as sparse vectors, for categories that are too many for a column each.

Labels get their places from a joined table of ids, so no list of them is read back and no plan grows with
them; a row holds only what is not zero.
"""

from __future__ import annotations

from pyspark.ml.linalg import VectorUDT
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from knotwork.operators.features import NOISE, left_join_dropna, left_join_fill_clusters, left_join_fill_rules
from knotwork.operators.ordering import dense_ids
from knotwork.operators.vectors import dimension
from knotwork.session import cut


EMPTY = "CAST(array() AS array<struct<i: int, v: double>>)"


def label_places(labels: DataFrame, column: str) -> tuple[DataFrame, int]:
    """``column``, ``_{column}_place``: labels numbered in their order, and how many places they take (at least one)."""
    ids = cut(dense_ids(labels, column, f"_{column}_place").withColumnRenamed("label", column))
    return ids, max(ids.count(), 1)


def _dense_part(values: Column, offset: int) -> Column:
    """Places and values of an array that are not zero."""
    placed = F.transform(values, lambda x, i: F.struct((i + offset).cast("int").alias("i"), x.cast("double").alias("v")))
    return F.filter(placed, lambda e: e["v"] != 0)


def _hot_part(place: Column, offset: int) -> Column:
    one = F.array(F.struct((place + offset).cast("int").alias("i"), F.lit(1.0).alias("v")))
    return F.when(place.isNotNull(), one).otherwise(F.expr(EMPTY))


def sparse_vector(parts: Column, size: int) -> Column:
    """A vector from an array of places in order (i) and values (v), without a list of names behind it."""
    shape = F.struct(F.lit(0).alias("type"), F.lit(size).alias("size"), parts["i"].alias("indices"), parts["v"].alias("values"))
    # A vector has no constructor among column functions; its parts in JSON are read as one.
    return F.from_json(F.to_json(F.struct(shape.alias("v"))), T.StructType([T.StructField("v", VectorUDT())]))["v"]


def assemble_sparse(
    features: DataFrame,
    embeddings: DataFrame | None = None,
    clusters: DataFrame | None = None,
    rules: DataFrame | None = None,
    train: Column | None = None,
) -> DataFrame:
    """key, y, features as ``assemble_features`` lays them out, as sparse vectors.

    With ``train`` (a condition on the feature table) only labels of training rows have a place, and
    noise has none. Labels without a place are all zeros. ``learn.logistic``, ``learn.forest`` and
    ``learn.boosted`` take such rows as they are. Numbers of the feature and rule tables must not be null.
    """
    raw = [name for name in features.columns if name not in ("key", "y")]
    out = features if train is None else features.withColumn("_train", F.coalesce(train, F.lit(False)))
    parts, size = [_dense_part(F.array(*[F.col(f"`{name}`").cast("double") for name in raw]), 0)], len(raw)
    if embeddings is not None:
        out = left_join_dropna(out, embeddings.select("key", F.col("vec").alias("_vec")), "_vec")
        parts.append(_dense_part(F.col("_vec"), size))
        size += dimension(embeddings)
    if clusters is not None:
        names = ("community", "density_cluster")
        out = left_join_fill_clusters(out, clusters.select("key", *names))
        known = cut((out if train is None else out.filter("_train")).select(*names).distinct())
        for name in names:
            ids, places = label_places(known if train is None else known.filter(F.col(name) != NOISE), name)
            out = out.join(ids, name, "left")
            parts.append(_hot_part(F.col(f"_{name}_place"), size))
            size += places
    if rules is not None:
        names = [name for name in rules.columns if name != "key"]
        renamed = rules.select("key", *[F.col(f"`{name}`").alias(f"_rule_{name}") for name in names])
        out = left_join_fill_rules(out, renamed)
        parts.append(_dense_part(F.array(*[F.col(f"`_rule_{name}`").cast("double") for name in names]), size))
        size += len(names)
    return out.select("key", "y", F.concat(*parts).alias("_parts")).select("key", "y", sparse_vector(F.col("_parts"), size).alias("features"))


def entries(rows: DataFrame, vector: str = "features") -> DataFrame:
    """key, position, value of what is not zero, however many places a vector has."""
    shape = "v struct<type: int, size: int, indices: array<int>, values: array<double>>"
    # Vectors show their parts in JSON only; numbers come back as they were.
    read = F.from_json(F.to_json(F.struct(F.col(vector).alias("v"))), shape)["v"]
    places = F.coalesce(read["indices"], F.sequence(F.lit(0), F.size(read["values"]) - 1))
    pairs = F.arrays_zip(places.alias("position"), read["values"].alias("value"))
    return rows.select("key", F.inline(pairs).alias("position", "value")).filter("value <> 0")
