"""Column builders for periodic boxes, slabs and spheres: no Python runs on the executors."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

AXES = ("x", "y", "z")


def wrap(x: Column, length: float | Column, lower: float | Column = 0.0) -> Column:
    """``x`` brought into [lower, lower + length); ``pmod`` keeps negative offsets positive."""
    low = lower if isinstance(lower, Column) else F.lit(float(lower))
    return low + F.pmod(x - low, length if isinstance(length, Column) else F.lit(float(length)))


def axis_gap(a: Column, b: Column, length: float | None) -> Column:
    """Distance along one axis of wrapped coordinates; through the boundary where ``length`` is given."""
    gap = F.abs(a - b)
    return gap if length is None else F.least(gap, F.lit(float(length)) - gap)


def distance(a: Sequence[Column], b: Sequence[Column], box: Sequence[float | None] = (None, None, None)) -> Column:
    """Euclidean or minimum-image distance of wrapped points; ``None`` marks an open axis."""
    return F.sqrt(sum((axis_gap(p, q, n) ** 2 for p, q, n in zip(a, b, box, strict=True)), F.lit(0.0)))


def in_slab(z: Column, lower: Column | float, upper: Column | float) -> Column:
    """Outside the open middle: ``z >= upper or z <= lower``."""
    return (z >= upper) | (z <= lower)


def touching_value(d: Column, w_a: Column, w_b: Column) -> Column:
    """Squared radius growth at which two weighted balls at distance ``d`` first meet."""
    t = (d * d + w_a - w_b) / F.nullif(2 * d, F.lit(0.0))
    return F.when((d > 0) & (t >= 0) & (t <= d), t * t - w_a).otherwise(F.greatest(-w_a, -w_b))


def grid_index(x: Column, spacing: float, lower: float = 0.0) -> Column:
    """Nearest node of a regular grid."""
    return F.rint((x - lower) / spacing).cast("int")


def offsets(spark: SparkSession, reach: Sequence[int] = (1, 1, 1), names: Sequence[str] = ("dx", "dy", "dz")) -> DataFrame:
    """All integer steps in a box of ``-reach .. reach``: 27 rows for the usual stencil."""
    df = spark.range(1)
    for name, r in zip(names, reach, strict=True):
        df = df.select("*", F.explode(F.sequence(F.lit(-r), F.lit(r))).alias(name))
    return df.drop("id")
