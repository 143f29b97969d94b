"""Expressions on ARRAY<DOUBLE> vectors, for row-wise use; products of tables are in operators.blocks."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda acc, x: acc + x)


def multiply(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: x * y)


def subtract(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: x - y)


def add(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: x + y)


def dot(a: Column, b: Column) -> Column:
    return total(multiply(a, b))


def squared_distance(a: Column, b: Column) -> Column:
    return total(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)))


def distance(a: Column, b: Column) -> Column:
    return F.sqrt(squared_distance(a, b))


def norm(a: Column) -> Column:
    return F.sqrt(total(F.transform(a, lambda x: x * x)))


def real_imaginary(real: Column, imaginary: Column) -> Column:
    """A complex vector as one real vector: real parts, then imaginary parts."""
    return F.concat(real, imaginary)


def halves(vector: Column) -> tuple[Column, Column]:
    """Real and imaginary part of a vector stored by ``real_imaginary``."""
    half = (F.size(vector) / 2).cast("int")
    return F.slice(vector, F.lit(1), half), F.slice(vector, half + 1, half)
