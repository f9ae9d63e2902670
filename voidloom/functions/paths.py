"""Column builders over paths: arrays of grid ids in order."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def drop_repeats(path: Column) -> Column:
    """Consecutive equal ids once."""
    return F.filter(path, lambda x, i: (i == 0) | (x != F.get(path, i - 1)))


def trim_below(path: Column, height: Column, level: float) -> Column:
    """Drop leading nodes while the next node's height is at most ``level * (1 + 1e-5)``."""
    far = F.filter(F.sequence(F.lit(1), F.size(path) - 1), lambda i: F.get(height, i) > level * (1 + 1e-5))
    begin = F.coalesce(F.get(far, F.lit(0)), F.size(path)) - 1
    return F.when(F.size(path) < 2, path).otherwise(F.slice(path, begin + 1, F.size(path)))


def trim_above(path: Column, height: Column, level: float) -> Column:
    """Drop trailing nodes while the previous node's height is at least ``level * (1 - 1e-6)``."""
    low = F.filter(F.sequence(F.lit(0), F.size(path) - 2), lambda i: F.get(height, i) < level * (1 - 1e-6))
    end = F.coalesce(F.element_at(low, -1), F.lit(-1)) + 2
    return F.when(F.size(path) < 2, path).otherwise(F.slice(path, 1, F.greatest(end, F.lit(1))))


def close_loop(top: Column, path: Column, bottom: Column) -> Column:
    """A path with a connection at each end, as one loop: ``top`` reversed, the path, ``bottom``."""
    return F.concat(F.reverse(top), path, F.reverse(bottom))


def steps(path: Column) -> Column:
    """Consecutive pairs of a path as ``ARRAY<STRUCT<u, v>>``, smaller id first; standing still is no step."""
    pairs = F.transform(
        F.when(F.size(path) > 1, F.sequence(F.lit(0), F.size(path) - 2)).otherwise(F.array().cast("array<int>")),
        lambda i: F.struct(F.least(F.get(path, i), F.get(path, i + 1)).alias("u"), F.greatest(F.get(path, i), F.get(path, i + 1)).alias("v")),
    )
    return F.filter(pairs, lambda s: s["u"] != s["v"])


def padded(path: Column, length: int | Column, fill: int = -1) -> Column:
    """A path of ``length`` ids, filled up at its end."""
    return F.slice(F.concat(path, F.array_repeat(F.lit(fill), length)), 1, length)
