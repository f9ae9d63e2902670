"""Vectors and square matrices as columns: products, Gram-Schmidt, points on a sphere, rotations from directions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def scaled(a: Column, by: Column) -> Column:
    return F.transform(a, lambda x: x * by)


def minus(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: x - y)


def unit(a: Column) -> Column:
    """The direction of a vector; that of a null vector is NULL."""
    length = F.sqrt(dot(a, a))
    return F.when(length > 0, F.transform(a, lambda x: x / length))


def cross(a: Column, b: Column) -> Column:
    p, q = ([F.get(v, F.lit(i)) for i in range(3)] for v in (a, b))
    return F.array(*[p[(i + 1) % 3] * q[(i + 2) % 3] - p[(i + 2) % 3] * q[(i + 1) % 3] for i in range(3)])


def gram_schmidt(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """``q_<c>`` (orthonormal) and ``r_<c>`` for each of the vectors ``columns``, which are the columns of a matrix A: A = Q R,
    R upper triangular with ``r_<c>`` as its column. Vectors that depend on earlier ones give NULL from there on."""
    left = {c: f"__left_{c}" for c in columns}
    df = df.withColumns({left[c]: F.col(c).cast("array<double>") for c in columns})
    for k, c in enumerate(columns):
        df = df.withColumn(f"__len_{c}", F.sqrt(dot(F.col(left[c]), F.col(left[c])))).withColumn(f"q_{c}", unit(F.col(left[c])))
        later = columns[k + 1 :]
        if later:
            df = df.withColumns({f"__{c}_{d}": dot(F.col(f"q_{c}"), F.col(left[d])) for d in later})
            df = df.withColumns({left[d]: minus(F.col(left[d]), scaled(F.col(f"q_{c}"), F.col(f"__{c}_{d}"))) for d in later})
    for k, d in enumerate(columns):
        above = [F.col(f"__{c}_{d}") for c in columns[:k]]
        df = df.withColumn(f"r_{d}", F.array(*above, F.col(f"__len_{d}"), *[F.lit(0.0)] * (len(columns) - k - 1)))
    return df.drop(*[x for x in df.columns if x.startswith(("__left_", "__len_")) or any(x == f"__{c}_{d}" for c in columns for d in columns)])


def sphere_points(df: DataFrame, seed: int = 0, out: str = "point") -> DataFrame:
    """A point on the unit sphere for each row: three normal numbers brought to length one."""
    return df.withColumn(out, F.array(*[F.randn(seed + i) for i in range(3)])).withColumn(out, unit(F.col(out)))


def rotations(df: DataFrame, direction: str, out: str = "rotation") -> DataFrame:
    """``out``: a rotation (array of three columns) whose last, or for a left-handed frame whose middle column turned about, is the direction.

    The direction and the second and third axis are made orthonormal in this order and taken in reverse; where that mirrors, the
    last two change places.
    """
    axes = {"__a": F.col(direction), "__b": F.array(*map(F.lit, (0.0, 1.0, 0.0))), "__c": F.array(*map(F.lit, (0.0, 0.0, 1.0)))}
    made = gram_schmidt(df.withColumns(axes), list(axes))
    q = [F.col(f"q_{c}") for c in axes]
    mirrored = dot(q[2], cross(q[1], q[0])) < 0
    turned = F.when(mirrored, F.array(q[2], q[0], q[1])).otherwise(F.array(q[2], q[1], q[0]))
    return made.withColumn(out, turned).drop(*axes, *[f"{p}_{c}" for p in "qr" for c in axes])


def axis_rotations(df: DataFrame, out: str = "rotation") -> DataFrame:
    """Each row three times, with the rotations (arrays of rows) that take the axes round: (x, y, z), (y, z, x), (z, x, y)."""
    turns = [F.array(*[F.array(*[F.lit(float(c == r)) for c in range(3)]) for r in order]) for order in ((0, 1, 2), (1, 2, 0), (2, 0, 1))]
    return df.withColumn("turn", F.explode(F.sequence(F.lit(0), F.lit(2)))).withColumn(out, F.get(F.array(*turns), F.col("turn")))
