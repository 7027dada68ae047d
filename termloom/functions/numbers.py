"""Number functions over columns."""

from __future__ import annotations

import math
from fractions import Fraction

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def _ln(x: pd.Series) -> pd.Series:
    return x.map(lambda v: math.log(v) if v > 0 else None)


def ln(x: Column) -> Column:
    """The C library's natural logarithm, null where there is none. Spark's differs from it in the
    last digit for some arguments, which ranks scores that are otherwise alike in another order."""
    return F.pandas_udf(_ln, "double")(x.cast("double"))


def _exact_fma(a: float, b: float, c: float) -> float:
    return float(Fraction(a) * Fraction(b) + Fraction(c))


def _fma(a: pd.Series, b: pd.Series, c: pd.Series) -> pd.Series:
    one = getattr(math, "fma", _exact_fma)
    return pd.Series([one(x, y, z) if x == x and y == y and z == z else None for x, y, z in zip(a, b, c, strict=True)], dtype=float)


def fma(a: Column, b: Column, c: Column) -> Column:
    """a * b + c of doubles, rounded once."""
    return F.pandas_udf(_fma, "double")(a.cast("double"), b.cast("double"), c.cast("double"))
