"""Vector arithmetic over array columns, always in double precision."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: A zero norm is replaced by this, so the distance of a zero vector is 1.
TINY_NORM = 1e-12


def as_double(v: Column) -> Column:
    return v.cast("array<double>")


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(
        F.zip_with(as_double(a), as_double(b), lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x
    )


def norm(v: Column) -> Column:
    length = F.sqrt(dot(v, v))
    return F.when(length == 0, F.lit(TINY_NORM)).otherwise(length)


def cosine_distance(a: Column, b: Column) -> Column:
    """1 − cosine; NULL when the two lengths differ."""
    return F.when(F.size(a) == F.size(b), 1 - dot(a, b) / (norm(a) * norm(b)))
