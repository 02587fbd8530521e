"""Vector arithmetic on ``array<float>`` columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def doubles(vector: Column) -> Column:
    return vector.cast("array<double>")


def dot(left: Column, right: Column) -> Column:
    """Inner product in double precision; cosine for unit vectors."""
    products = F.zip_with(doubles(left), doubles(right), lambda a, b: a * b)
    return F.aggregate(products, F.lit(0.0), lambda total, p: total + p)


def norm(vector: Column) -> Column:
    return F.sqrt(dot(vector, vector))


def unit(vector: Column) -> Column:
    """The vector at length one; a zero vector stays as it is.

    The length is bound once through an outer one-element array: written inside
    the inner lambda it would be computed again for every element.
    """
    values = doubles(vector)
    length = F.coalesce(F.nullif(norm(vector), F.lit(0.0)), F.lit(1.0))
    return F.transform(F.array(length), lambda n: F.transform(values, lambda x: x / n))[0]


def squared_distance(left: Column, right: Column) -> Column:
    gaps = F.zip_with(doubles(left), doubles(right), lambda a, b: (a - b) * (a - b))
    return F.aggregate(gaps, F.lit(0.0), lambda total, g: total + g)


def round4(value: Column) -> Column:
    """Four decimals, half to even."""
    return F.bround(value, 4)
