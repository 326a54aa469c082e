"""Vector functions as Column expressions over array<float|double>; sums are in double."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from citeloom.functions.text import let
from citeloom.settings import UNIT_NORM_ATOL, UNIT_NORM_RTOL


def dot(left: Column, right: Column) -> Column:
    products = F.zip_with(left, right, lambda a, b: a.cast("double") * b.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda acc, x: acc + x)


def norm(vector: Column) -> Column:
    return F.sqrt(
        F.aggregate(vector, F.lit(0.0), lambda acc, x: acc + x.cast("double") * x.cast("double"))
    )


def unit(vector: Column) -> Column:
    """Scale to length one; a zero vector has no direction and is an error."""
    return let(
        norm(vector),
        lambda n: F.when(n == 0.0, F.raise_error(F.lit("zero vector cannot be normalised"))).otherwise(
            F.transform(vector, lambda x: (x.cast("double") / n).cast("float"))
        ),
    )


def is_unit(vector: Column) -> Column:
    return F.abs(norm(vector) - 1.0) <= UNIT_NORM_ATOL + UNIT_NORM_RTOL


def similarity_of_distance(distance: Column) -> Column:
    return F.lit(1.0) - distance
