"""Vector expressions on array columns; sums are taken in double."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    """Inner product; the cosine of two unit vectors."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def unit(a: Column) -> Column:
    """The vector scaled to length 1; a zero vector raises, as it has no direction."""
    length = norm(a)
    checked = F.when(length > 0, length).otherwise(F.raise_error(F.lit("zero vector")).cast("double"))
    return F.transform(a, lambda x: x.cast("double") / checked)
