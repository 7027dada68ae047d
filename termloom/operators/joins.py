"""Joins by a key of which a few values may hold most of the rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Keys that may be broadcast: a key counts as hot above this share of all rows.
HOT_KEYS = 10_000
#: A key with so few rows is never hot.
LEAST_HOT = 256


def join_spread(rows: DataFrame, keyed: DataFrame, key: str, total: int, how: str = "inner", weight: str = "n", most: int | None = None) -> DataFrame:
    """``rows`` joined (inner or left) with ``keyed``, which has one row for each key and in
    ``weight`` how many of the ``total`` rows have it; ``weight`` itself is dropped.

    Keys of more than ``total / HOT_KEYS`` rows, of which there are fewer than ``HOT_KEYS``,
    are broadcast and their rows stay where they are; all other keys are joined by a
    shuffle, where a key is now a small share of a task's rows. A null key meets none.
    ``most`` is the largest weight, asked of ``keyed`` (best a written table) where it is not
    given; where it is not hot, one plain join does.
    """
    bar = max(LEAST_HOT, total // HOT_KEYS)
    if most is None:
        most = keyed.agg(F.max(weight)).first()[0]
    if (most or 0) <= bar:
        return rows.join(keyed.drop(weight), key, how)
    hot = F.col(weight) > bar
    here = F.broadcast(keyed.filter(hot).drop(weight))
    rest = rows.join(F.broadcast(keyed.filter(hot).select(key)), key, "left_anti").join(keyed.filter(~hot).drop(weight), key, how)
    return rows.join(here, key).unionByName(rest)
