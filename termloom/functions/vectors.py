"""Vector functions over array columns, in double precision."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    """0 where either is empty or of zero length."""
    length = norm(a) * norm(b)
    return F.when(length > 0, dot(a, b) / length).otherwise(0.0)


def on_circle(place: Column, n: Column) -> tuple[Column, Column]:
    """Coordinates of the ``place``-th (from 0) of ``n`` points spread evenly on the unit circle."""
    angle = 2 * F.pi() * place / n
    return F.cos(angle), F.sin(angle)
