"""String, number and label expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Shape of a decimal number as Python's float() reads it, and its special words.
NUMBER_PATTERN = r"^[+-]?([0-9]+(_[0-9]+)*([.]([0-9]+(_[0-9]+)*)?)?|[.][0-9]+(_[0-9]+)*)([eE][+-]?[0-9]+(_[0-9]+)*)?$"
NAN_PATTERN = r"(?i)^[+-]?nan$"
INFINITY_PATTERN = r"(?i)^[+-]?inf(inity)?$"

# Clipping bounds of a probability.
PROBABILITY_FLOOR = 1e-7
PROBABILITY_CEILING = 1 - 1e-7


def local_name(iri: Column) -> Column:
    """Text after the last ``#``, or after the last ``/`` when there is no ``#``."""
    return F.when(F.contains(iri, F.lit("#")), F.substring_index(iri, "#", -1)).otherwise(
        F.substring_index(iri, "/", -1)
    )


def namespace_of(iri: Column) -> Column:
    """IRI up to and including its first ``#``, else up to its last ``/``; null if it has neither."""
    return F.coalesce(
        F.nullif(F.regexp_extract(iri, r"^[^#]*#", 0), F.lit("")),
        F.nullif(F.regexp_extract(iri, r"^.*/", 0), F.lit("")),
    )


def stable_hash(text: Column, digits: int = 10) -> Column:
    """First hex digits of SHA-1 over the UTF-8 bytes."""
    return F.substring(F.sha1(text.cast("binary")), 1, digits)


def hash_number(text: Column, modulus: Column | int) -> Column:
    """Uniform integer in ``[0, modulus)`` from 60 bits of SHA-1; the same on every engine."""
    bits = F.conv(stable_hash(text, 15), 16, 10).cast("long")
    return F.pmod(bits, modulus if isinstance(modulus, Column) else F.lit(modulus).cast("long"))


# Fixed value: what Python's number reader skips round a number.
BLANKS = " \t\n\x0b\x0c\r\x1c\x1d\x1e\x1f\x85\xa0\u2028\u2029\u3000"


def safe_float(text: Column, finite_only: bool = True) -> Column:
    """Number in the text by Python's rules, else null.

    Spark's own cast takes ``1.0f`` and refuses ``1_000``; Python does the reverse, so the
    text is matched first. NaN and infinities are dropped unless asked for.
    """
    trimmed = F.btrim(text, F.lit(BLANKS))
    value = F.when(trimmed.rlike(NUMBER_PATTERN), F.replace(trimmed, F.lit("_"), F.lit("")).try_cast("double"))
    if finite_only:
        return F.when(F.abs(value) < F.lit(float("inf")), value)
    negative = trimmed.startswith("-")
    return (
        F.when(trimmed.rlike(NAN_PATTERN), F.lit(float("nan")))
        .when(trimmed.rlike(INFINITY_PATTERN) & negative, F.lit(float("-inf")))
        .when(trimmed.rlike(INFINITY_PATTERN), F.lit(float("inf")))
        .otherwise(value)
    )


def contains_any(text: Column, parts: list[str], ignore_case: bool = False) -> Column:
    """True if the text holds at least one of the parts."""
    subject = F.lower(text) if ignore_case else text
    test = F.lit(False)
    for part in parts:
        test = test | F.contains(subject, F.lit(part.lower() if ignore_case else part))
    return test


def ends_with_any(text: Column, suffixes: list[str]) -> Column:
    test = F.lit(False)
    for suffix in suffixes:
        test = test | F.endswith(text, F.lit(suffix))
    return test


def similarity_weight(distance: Column) -> Column:
    """Edge weight of a neighbour at this distance."""
    return F.lit(1.0) / (F.lit(1.0) + distance)


def sigmoid_clip(logit: Column) -> Column:
    """Logistic probability kept strictly between 0 and 1."""
    raw = F.lit(1.0) / (F.lit(1.0) + F.exp(-logit))
    return F.greatest(F.lit(PROBABILITY_FLOOR), F.least(F.lit(PROBABILITY_CEILING), raw))


def threshold_label(probability: Column, threshold: float = 0.5) -> Column:
    return (probability >= F.lit(threshold)).cast("int")


def binary_label(text: Column, positive: str) -> Column:
    return (text == F.lit(positive)).cast("int")


def outlier_proxy(strength: Column) -> Column:
    """How weakly a row belongs to its cluster."""
    return F.lit(1.0) - strength


def rounded(value: Column, digits: int = 6) -> Column:
    """Rounded double without a negative zero."""
    return F.round(value.cast("double"), digits) + F.lit(0.0)
