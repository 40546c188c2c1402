"""Vector functions on array columns. Elements are widened to double before they are multiplied."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def doubles(vector: Column) -> Column:
    return vector.cast("array<double>")


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(doubles(a), doubles(b), lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(vector: Column) -> Column:
    return F.sqrt(F.aggregate(doubles(vector), F.lit(0.0), lambda s, x: s + x * x))


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity; null for a zero vector."""
    return F.try_divide(dot(a, b), norm(a) * norm(b))


def normalize(vector: Column) -> Column:
    """The vector over its norm; a zero vector raises an error."""
    n = norm(vector)
    checked = F.when(n > 0, n).otherwise(F.raise_error(F.lit("cannot normalise a zero vector")).cast("double"))
    return F.transform(doubles(vector), lambda x: x / checked)


def truncate(vector: Column, dims: int) -> Column:
    """The first dims elements, normalised again."""
    return normalize(F.slice(vector, 1, dims))


def has_dimension(vector: Column, dims: int) -> Column:
    return F.size(vector) == dims
