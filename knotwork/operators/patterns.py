"""Basic graph patterns and the joins built on them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from knotwork.functions.scalars import contains_any
from knotwork.operators.skew import HOT_ROWS, salted_join
from knotwork.operators.triples import CATEGORY_SUFFIXES, PATIENT_PREFIX, RDF_TYPE, is_patient

# A term is ``?name``, a text of any kind, (text, kind), or (text, kind, tag) with the tag of a literal.
Term = str | tuple[str, str] | tuple[str, str, str]
Pattern = tuple[Term, Term, Term]


def _kind(column: str) -> Column:
    return F.lit("iri") if column == "pred" else F.col(f"{column}_kind")


# Fixed value: the datatype that a literal without one has.
PLAIN_TYPE = "http://www.w3.org/2001/XMLSchema#string"
TAG_COLUMNS = ("obj_datatype", "obj_lang")


def _tag(rows: DataFrame, column: str) -> Column:
    """What tells literals of one text apart: ``@`` and the language in lower case, or the datatype.

    Empty for plain strings, for other terms, and in tables that do not tell.
    """
    known = [c for c in TAG_COLUMNS if c in rows.columns]
    if column != "obj" or not known:
        return F.lit("")
    datatype, lang = (F.col(c) if c in known else F.lit(None).cast("string") for c in TAG_COLUMNS)
    told = F.coalesce(F.concat(F.lit("@"), F.lower(lang)), F.nullif(datatype, F.lit(PLAIN_TYPE)), F.lit(""))
    return F.when(F.col("obj_kind") == "literal", told).otherwise("")


def match_pattern(triples: DataFrame, pattern: Pattern) -> DataFrame:
    """Bindings of one pattern: constants filter the scan, ``?name`` terms become ``name`` and ``name_kind``.

    A table with datatypes or languages yields ``name_tag`` as well.
    """
    tagged = any(c in triples.columns for c in TAG_COLUMNS)
    rows = triples
    seen: dict[str, str] = {}
    for column, term in zip(("subj", "pred", "obj"), pattern):
        if isinstance(term, tuple):
            rows = rows.filter((F.col(column) == term[0]) & (_kind(column) == term[1]))
            if len(term) > 2:
                rows = rows.filter(_tag(rows, column) == term[2])
        elif not term.startswith("?"):
            rows = rows.filter(F.col(column) == term)
        elif term in seen:
            same = (F.col(column) == F.col(seen[term])) & (_kind(column) == _kind(seen[term]))
            rows = rows.filter(same & (_tag(rows, column) == _tag(rows, seen[term])))
        else:
            seen[term] = column
    columns = []
    for term, column in seen.items():
        columns += [F.col(column).alias(term[1:]), _kind(column).alias(f"{term[1:]}_kind")]
        if tagged:
            columns.append(_tag(rows, column).alias(f"{term[1:]}_tag"))
    return rows.select(*columns)


def bgp_match(triples: DataFrame, patterns: Sequence[Pattern], hot_rows: int = HOT_ROWS) -> DataFrame:
    """Conjunction of patterns as equi-joins on their shared variables: text, kind, datatype and language.

    A literal never meets an IRI or a blank node of the same text, nor a literal of another datatype or
    language. The next pattern is always one
    that shares a variable with those already joined; a pattern that shares none would be a product
    and is refused. Variables at an object place also yield ``name_kind``, and ``name_tag`` where the table tells tags.
    """
    waiting = [(pattern, match_pattern(triples, pattern)) for pattern in patterns]
    _, solved = waiting.pop(0)
    while waiting:
        for position, (_, rows) in enumerate(waiting):
            shared = [c for c in rows.columns if c in solved.columns]
            if shared:
                break
        else:
            raise ValueError("patterns must be connected by variables")
        waiting.pop(position)
        solved = salted_join(rows, solved, shared, hot_rows=hot_rows)
    objects = {p[2][1:] for p in patterns if isinstance(p[2], str) and p[2].startswith("?")}
    variables = {term[1:] for p in patterns for term in p if isinstance(term, str) and term.startswith("?")}
    notes = {f"{name}_{note}" for name in variables - objects for note in ("kind", "tag")} - variables
    return solved.select(*[c for c in solved.columns if c not in notes])


def lookup_spo(triples: DataFrame, keys: DataFrame, hot_rows: int = HOT_ROWS) -> DataFrame:
    """Triples of the given (subj) or (subj, pred) keys; keys are made unique first."""
    on = [c for c in ("subj", "pred") if c in keys.columns]
    return salted_join(triples, keys.select(*on).distinct(), on, hot_rows=hot_rows)


def semi_members(triples: DataFrame, members: DataFrame, key: str = "key", hot_rows: int = HOT_ROWS) -> DataFrame:
    """Triples whose subject is a member."""
    return salted_join(
        triples, members.select(F.col(key).alias("subj")), ["subj"], "left_semi", hot_rows=hot_rows
    )


def cluster_triples_join(
    clusters: DataFrame,
    triples: DataFrame,
    cluster: str = "community",
    prefix: str = PATIENT_PREFIX,
    hot_rows: int = HOT_ROWS,
) -> DataFrame:
    """Triples of clustered patients with their cluster."""
    members = clusters.filter(is_patient("key", prefix)).select(F.col("key").alias("subj"), F.col(cluster).alias("cluster"))
    return salted_join(triples, members, ["subj"], hot_rows=hot_rows)


def top_categories(triples: DataFrame, prefix: str = PATIENT_PREFIX, limit: int = 20) -> DataFrame:
    """Categories by number of patient triples, most frequent first."""
    hits = triples.filter(is_patient("subj", prefix) & contains_any(F.col("obj"), CATEGORY_SUFFIXES))
    counted = hits.groupBy(F.col("obj").alias("category")).agg(F.count(F.lit(1)).alias("n"))
    return counted.orderBy(F.desc("n"), "category").limit(limit)


def label_distribution(triples: DataFrame, predicate: str, prefix: str = PATIENT_PREFIX) -> DataFrame:
    """Label values of patients by frequency."""
    hits = triples.filter((F.col("pred") == predicate) & is_patient("subj", prefix))
    counted = hits.groupBy(F.col("obj").alias("label_value")).agg(F.count(F.lit(1)).alias("n"))
    return counted.orderBy(F.desc("n"), "label_value")


def _typed_edges(triples: DataFrame, type_iri: str, word_pattern: str, hot_rows: int) -> DataFrame:
    """(patient, feature, category) of typed subjects whose object IRI matches the words.

    The word filter sits on the scan of the second pattern, below the join.
    """
    edges = triples.filter((F.col("obj_kind") == "iri") & F.col("obj").rlike(f"(?i){word_pattern}"))
    typed = match_pattern(triples, ("?patient", RDF_TYPE, type_iri)).distinct()
    wanted = match_pattern(edges, ("?patient", "?feature", "?category")).drop("category_kind")
    return salted_join(wanted, typed, ["patient"], hot_rows=hot_rows)


def feature_categories(triples: DataFrame, type_iri: str, limit: int = 30, hot_rows: int = HOT_ROWS) -> DataFrame:
    """(feature, category) pairs of typed patients by frequency."""
    # Level words of the query.
    hits = _typed_edges(triples, type_iri, "Low|Med|Medium|High", hot_rows)
    counted = hits.groupBy("feature", "category").agg(F.count(F.lit(1)).alias("n"))
    return counted.orderBy(F.desc("n"), "feature", "category").limit(limit)


def high_examples(triples: DataFrame, type_iri: str, limit: int = 50, hot_rows: int = HOT_ROWS) -> DataFrame:
    """Patients with a high category, in key order."""
    hits = _typed_edges(triples, type_iri, "High", hot_rows)
    return hits.select("patient", "feature", "category").orderBy("patient", "feature", "category").limit(limit)
