"""Cleaning, literal handling and selection on a triples table.

A triples table has ``subj, subj_kind, pred, obj, obj_kind``; kinds are ``iri``, ``bnode`` and
``literal``. Labelled triples have ``head, relation, tail``.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from knotwork.functions.scalars import (
    contains_any,
    ends_with_any,
    local_name,
    namespace_of,
    safe_float,
    stable_hash,
)
from knotwork.operators.ordering import grouped_quantiles

# Vocabulary of the data model.
RDF_TYPE = "http://www.w3.org/1999/02/22-rdf-syntax-ns#type"
ANNOTATION_PARTS = ["comment", "label"]
PATIENT_PREFIX = "Patient_"
DEFAULT_NAMESPACE = "http://example.org/breastcancer#"
LOOSE_LEVELS = ["low", "med", "medium", "high"]
CATEGORY_SUFFIXES = ["_High", "_Medium", "_Low"]
LEVELS = ["Low", "Med", "High"]
CATEGORIZE_ABOVE = 0.5
# Rows of a part without repeats; parts that Spark's shuffle writes without a buffer; rows of a part once there are more.
PART_ROWS, BUFFERLESS_PARTS, LARGE_PART_ROWS = 2**17, 200, 2**20
SCHEMA_TRIPLES = [
    ("Patient", "subClassOf", "Entity"),
    ("Measurement", "subClassOf", "Entity"),
    ("Attribute", "subClassOf", "Entity"),
    ("Category", "subClassOf", "Entity"),
    ("Low", "instanceOf", "Category"),
    ("Med", "instanceOf", "Category"),
    ("High", "instanceOf", "Category"),
]

LABELLED = "head string, relation string, tail string"


def is_kind(side: str, kind: str) -> Column:
    return F.col(f"{side}_kind") == F.lit(kind)


def drop_predicates_like(triples: DataFrame, parts: Sequence[str] = tuple(ANNOTATION_PARTS)) -> DataFrame:
    """Remove triples whose predicate holds one of the parts, ignoring case."""
    return triples.filter(~contains_any(F.col("pred"), list(parts), ignore_case=True))


def drop_rdf_type(triples: DataFrame, keep: bool = False) -> DataFrame:
    return triples if keep else triples.filter(F.col("pred") != RDF_TYPE)


def entity_triples(
    triples: DataFrame,
    keep_rdf_type: bool = True,
    drop_literals: bool = True,
    uri_only: bool = True,
    drop_parts: Sequence[str] = tuple(ANNOTATION_PARTS),
) -> DataFrame:
    """Triples fit for embedding: IRI ends, no annotation predicates; one narrow filter."""
    kept = drop_predicates_like(drop_rdf_type(triples, keep_rdf_type), drop_parts)
    if drop_literals:
        kept = kept.filter(~is_kind("obj", "literal"))
    if uri_only:
        kept = kept.filter(is_kind("subj", "iri") & is_kind("obj", "iri"))
    return kept


def labelled(triples: DataFrame, relation: Column | None = None) -> DataFrame:
    """Subject, predicate, object as head, relation, tail."""
    name = F.col("pred") if relation is None else relation
    return triples.select(F.col("subj").alias("head"), name.alias("relation"), F.col("obj").alias("tail"))


def literals_as_nodes(triples: DataFrame) -> DataFrame:
    """Keep every triple; literals and blank nodes become nodes with a marked name."""

    def node(side: str) -> Column:
        text = F.col(side)
        return (
            F.when(is_kind(side, "literal"), F.concat(F.lit("lit:"), text))
            .when(is_kind(side, "bnode"), F.concat(F.lit("_:"), text))
            .otherwise(text)
        )

    return triples.select(node("subj").alias("head"), F.col("pred").alias("relation"), node("obj").alias("tail"))


def _parts(rows: int) -> int:
    """Parts of PART_ROWS rows, at most BUFFERLESS_PARTS of them up to LARGE_PART_ROWS rows in each."""
    return max(1, min(BUFFERLESS_PARTS, math.ceil(rows / PART_ROWS)), math.ceil(rows / LARGE_PART_ROWS))


def distinct_triples(triples: DataFrame, rows: int | None = None) -> DataFrame:
    """A graph is a set. With ``rows``, about the number of rows before, no task holds the triples of a whole split.

    ``dropDuplicates`` alone first builds a table of all triples of a split. Here repeats go batch by batch, so that
    a triple that nearly every row brings is not dealt as often, and the rest is dealt into parts by the whole triple.
    """
    if rows is None:
        return triples.dropDuplicates()
    names = triples.columns

    def work(batches):
        for batch in batches:
            single = pa.Table.from_batches([batch]).group_by(names, use_threads=False).aggregate([])
            yield from single.select(names).to_batches()

    return triples.mapInArrow(work, triples.schema).repartition(_parts(rows), *names).dropDuplicates()


def _literal_token(relation: Column, text: Column) -> Column:
    return F.concat(F.lit("LIT::"), relation, F.lit("::"), stable_hash(text))


def literal_drop(triples: DataFrame) -> DataFrame:
    """Only triples with an IRI object, relations by local name."""
    return labelled(triples.filter(is_kind("obj", "iri")), local_name(F.col("pred")))


def literal_entity(triples: DataFrame) -> DataFrame:
    """Every literal becomes an entity named by relation and hash of its text."""
    relation = local_name(F.col("pred"))
    tail = F.when(is_kind("obj", "iri"), F.col("obj")).otherwise(_literal_token(relation, F.col("obj")))
    return triples.select(F.col("subj").alias("head"), relation.alias("relation"), tail.alias("tail"))


def choose_strategy(triples: DataFrame) -> str:
    """``categorize`` if literals outnumber other objects, else ``drop``; reads back one row."""
    share = triples.agg(F.avg(is_kind("obj", "literal").cast("double"))).first()[0]
    return "categorize" if (share or 0.0) > CATEGORIZE_ABOVE else "drop"


def numeric_literals(triples: DataFrame, exclude_predicates: Sequence[str] = ()) -> DataFrame:
    """Rows whose object reads as a number: subj, relation, value."""
    rows = triples.filter(~is_kind("obj", "iri"))
    if exclude_predicates:
        rows = rows.filter(~F.col("pred").isin(list(exclude_predicates)))
    return rows.select(
        "subj",
        "obj_kind",
        local_name(F.col("pred")).alias("relation"),
        safe_float(F.col("obj")).alias("value"),
    ).filter(F.col("value").isNotNull())


def is_patient(column: str, prefix: str = PATIENT_PREFIX, match: str = "contains") -> Column:
    """``contains``: anywhere in the IRI; ``local_prefix``: local name starts with it."""
    if match == "contains":
        return F.contains(F.col(column), F.lit(prefix))
    if match == "local_prefix":
        return F.startswith(local_name(F.col(column)), F.lit(prefix))
    raise ValueError(f"unknown match: {match}")


def literal_thresholds(
    triples: DataFrame, prefix: str = PATIENT_PREFIX, exclude_predicates: Sequence[str] = ()
) -> DataFrame:
    """Two cut points for each relation from its numeric literals on patients.

    Thirds from ten values on, 0.33 and 0.66 from three on, else least and greatest value.
    """
    values = numeric_literals(triples, exclude_predicates).filter(F.col("obj_kind") == "literal")
    if prefix:
        values = values.filter(is_patient("subj", prefix, "local_prefix"))
    cuts = grouped_quantiles(
        values,
        ["relation"],
        "value",
        {"third": 1 / 3, "two_thirds": 2 / 3, "low": 0.33, "high": 0.66, "least": 0.0, "greatest": 1.0},
    )

    def choose(many: str, some: str, few: str) -> Column:
        return F.when(F.col("n") >= 10, F.col(many)).when(F.col("n") >= 3, F.col(some)).otherwise(F.col(few))

    return cuts.select(
        "relation", "n", choose("third", "low", "least").alias("q1"), choose("two_thirds", "high", "greatest").alias("q2")
    )


def threshold_join(values: DataFrame, thresholds: DataFrame) -> DataFrame:
    """Cut points next to each value; there is one threshold row per predicate, so Spark broadcasts
    that side by its size and falls back to a shuffle if a graph has very many predicates."""
    return values.join(thresholds.select("relation", "q1", "q2"), "relation", "left")


def literal_bucket(values: DataFrame, thresholds: DataFrame) -> DataFrame:
    """Adds ``level``; a relation without thresholds is its own threshold, hence Low."""
    value = F.col("value")
    low, medium, high = (F.lit(level) for level in LEVELS)
    level = (
        F.when(value <= F.coalesce("q1", value), low).when(value <= F.coalesce("q2", value), medium).otherwise(high)
    )
    return threshold_join(values, thresholds).withColumn("level", level)


def measurement_expand(buckets: DataFrame) -> DataFrame:
    """Six triples for each bucketed literal, in one narrow stage."""
    relation, level = F.col("relation"), F.col("level")
    measurement = F.concat(F.lit("MEAS::"), local_name(F.col("subj")), F.lit("::"), relation)
    attribute = F.concat(F.lit("ATTR::"), relation)
    category = F.concat(F.lit("CAT::"), relation, F.lit("::"), level)
    # The measurement vocabulary.
    edges = [
        (F.col("subj"), "hasMeasurement", measurement),
        (measurement, "measurementType", attribute),
        (measurement, "hasCategory", category),
        (attribute, "instanceOf", F.lit("Attribute")),
        (category, "instanceOf", F.lit("Category")),
        (category, "categoryLevel", level),
    ]
    rows = [
        F.struct(head.alias("head"), F.lit(name).alias("relation"), tail.alias("tail")) for head, name, tail in edges
    ]
    return buckets.select(F.inline(F.array(*rows)))


def nonnumeric_token(triples: DataFrame) -> DataFrame:
    """Literals that are no number, as tokens."""
    relation = local_name(F.col("pred"))
    rows = triples.filter(~is_kind("obj", "iri") & safe_float(F.col("obj")).isNull())
    return rows.select(
        F.col("subj").alias("head"), relation.alias("relation"), _literal_token(relation, F.col("obj")).alias("tail")
    )


def schema_triples(spark) -> DataFrame:
    return spark.createDataFrame(SCHEMA_TRIPLES, LABELLED)


def categorize(
    triples: DataFrame,
    prefix: str = PATIENT_PREFIX,
    schema_relations: bool = False,
    exclude_predicates: Sequence[str] = (),
) -> DataFrame:
    """Numeric literals as measurement nodes with levels, texts as tokens, IRI triples as they are."""
    usable = triples.filter(~F.col("pred").isin(list(exclude_predicates))) if exclude_predicates else triples
    buckets = literal_bucket(numeric_literals(usable), literal_thresholds(usable, prefix))
    out = literal_drop(usable).unionByName(measurement_expand(buckets)).unionByName(nonnumeric_token(usable))
    return out.unionByName(schema_triples(triples.sparkSession)) if schema_relations else out


def convert_literals(triples: DataFrame, strategy: str = "auto", **options) -> DataFrame:
    """Labelled triples under ``auto``, ``drop``, ``entity`` or ``categorize``; duplicates are kept."""
    chosen = choose_strategy(triples) if strategy == "auto" else strategy
    if chosen == "drop":
        return literal_drop(triples)
    if chosen == "entity":
        return literal_entity(triples)
    if chosen == "categorize":
        return categorize(triples, **options)
    raise ValueError(f"unknown literal strategy: {strategy}")


def conversion_stats(triples: DataFrame, strategy: str = "auto", schema_relations: bool = False) -> DataFrame:
    """One row about a conversion, from a single scan."""
    literal = is_kind("obj", "literal")
    other = ~is_kind("obj", "iri")
    number = safe_float(F.col("obj")).isNotNull()
    counts = triples.agg(
        F.count(F.lit(1)).alias("total_triples"),
        F.count_if(other).alias("others"),
        F.count_if(literal).alias("literals"),
        F.count_if(literal & number).alias("numeric_literal_triples"),
        F.count_if(literal & ~number).alias("nonnumeric_literal_triples"),
        F.count_if(other & number).alias("measured"),
    )
    auto = F.when(F.col("literals") / F.greatest("total_triples", F.lit(1)) > CATEGORIZE_ABOVE, "categorize")
    chosen = auto.otherwise("drop") if strategy == "auto" else F.lit(strategy)
    extra = len(SCHEMA_TRIPLES) if schema_relations else 0
    named = counts.withColumn("literal_strategy", chosen)
    dropped = F.when(F.col("literal_strategy") == "drop", F.col("others")).otherwise(F.lit(0))
    grown = F.when(F.col("literal_strategy") == "categorize", F.col("measured") * 5 + extra).otherwise(F.lit(0))
    return named.select(
        "total_triples",
        (F.col("total_triples") - dropped + grown).alias("kept_triples"),
        dropped.cast("long").alias("dropped_literal_triples"),
        "literal_strategy",
        "numeric_literal_triples",
        "nonnumeric_literal_triples",
    )


def distinct_subjects(triples: DataFrame) -> DataFrame:
    return triples.select("subj").distinct()


def select_patients(
    triples: DataFrame, prefix: str = PATIENT_PREFIX, match: str = "contains", fallback_below: int = 0
) -> DataFrame:
    """Patient IRIs in order; all subjects if fewer than ``fallback_below`` match."""
    subjects = distinct_subjects(triples.filter(is_kind("subj", "iri")))
    patients = subjects.filter(is_patient("subj", prefix, match))
    if fallback_below and len(patients.take(fallback_below)) < fallback_below:
        patients = subjects
    return patients.orderBy("subj")


def base_namespace(triples: DataFrame, default: str = DEFAULT_NAMESPACE) -> DataFrame:
    """One row: the least namespace that the subjects use."""
    found = F.min(F.when(is_kind("subj", "iri"), namespace_of(F.col("subj"))))
    return triples.agg(F.coalesce(found, F.lit(default)).alias("namespace"))


def resolve_predicate(name: Column, namespace: Column) -> Column:
    """Full IRI of a predicate that may be given by local name."""
    full = F.startswith(name, F.lit("http://")) | F.startswith(name, F.lit("https://"))
    return F.when(full, name).otherwise(F.concat(namespace, name))


def category_filter(triples: DataFrame, mode: str = "suffix") -> DataFrame:
    """Triples that point to a category node.

    ``suffix``: an http IRI that ends in one of the level suffixes, in this case. ``loose``: any
    node that holds a level word in any case.
    """
    if mode == "suffix":
        return triples.filter(F.startswith(F.col("obj"), F.lit("http")) & ends_with_any(F.col("obj"), CATEGORY_SUFFIXES))
    if mode == "loose":
        return triples.filter(~is_kind("obj", "literal") & contains_any(F.col("obj"), LOOSE_LEVELS, ignore_case=True))
    raise ValueError(f"unknown mode: {mode}")
