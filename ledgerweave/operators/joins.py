"""Joins that survive hot keys."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def hot_safe_join(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """Join on keys and a hash of them.

    Adaptive execution splits a skewed side only if the join has a shuffle of its own on both sides. A side that was
    aggregated by the keys has none; the second key (a hash of the others) adds it. Small sides still become
    a broadcast at run time, after their size is known.
    """
    taken, twin = {c.lower() for c in (*left.columns, *right.columns)}, "_twin"
    while twin in taken:
        twin += "_"
    both = (side.withColumn(twin, F.xxhash64(*keys)) for side in (left, right))
    return next(both).join(next(both), [*keys, twin], how).drop(twin)
