"""Mobile atoms on the void grid: projection, straight segments, repulsion and line integrals along ways."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.geometry import AXES, distance, wrap
from .grid import Grid
from .points import nearest_within, pairs_within


def cubic_box(spark: SparkSession, path: str, column: int = 1) -> float:
    """Largest value of a column of a whitespace table of box sizes; lines that start with # are skipped."""
    lines = spark.read.text(path).where("trim(value) <> '' and not startswith(trim(value), '#')")
    return lines.agg(F.max(F.split(F.trim("value"), r"\s+")[column].cast("double"))).first()[0]


def project(paths: DataFrame, void: DataFrame, grid: Grid, reach: float) -> DataFrame:
    """path_id, pos, gid and error: the nearest void node within ``reach`` of each point (path_id, pos, x, y, z)."""
    at = paths.withColumns({a: wrap(F.col(a), n) for a, n, p in zip(AXES, grid.box, grid.periodic, strict=True) if p})
    at = at.withColumn("pt", F.struct("path_id", "pos"))
    found = nearest_within(at.select("pt", *AXES), void.select("gid", *AXES), reach, "pt", "gid", tuple(n if p else None for n, p in zip(grid.box, grid.periodic, strict=True)))
    return found.select("pt.path_id", "pt.pos", "gid", F.col("d").alias("error"))


def projection_report(projected: DataFrame) -> DataFrame:
    """Largest error and number of points of each path."""
    return projected.groupBy("path_id").agg(F.max("error").alias("error"), F.count("*").alias("n"))


def straight_segments(ends: DataFrame, box: Sequence[float], points: int = 20) -> DataFrame:
    """segment, step, x, y, z: points on the straight line from (ax, ay, az) to the nearest image of (bx, by, bz), wrapped."""
    share = F.col("step") / (points - 1)
    df = ends.withColumn("step", F.explode(F.sequence(F.lit(0), F.lit(points - 1))))
    to = [F.pmod(F.col(f"b{a}") - F.col(f"a{a}") + n / 2, F.lit(float(n))) - n / 2 for a, n in zip(AXES, box, strict=True)]
    return df.select("segment", "step", *[wrap(F.col(f"a{a}") + share * t, n).alias(a) for a, t, n in zip(AXES, to, box, strict=True)])


def repulsion(points: DataFrame, centres: DataFrame, cutoff: float, box: Sequence[float | None]) -> DataFrame:
    """pid, rx, ry, rz: sum over centres within the cutoff of the gap over the fourth power of the distance."""
    near = pairs_within(points.select("pid", *AXES), centres.select("bid", *AXES), cutoff, box).where("d > 0")
    gap = {a: (F.col(f"a_{a}") - F.col(f"b_{a}")) for a in AXES}
    gap = {a: g if n is None else F.pmod(g + n / 2, F.lit(float(n))) - n / 2 for (a, g), n in zip(gap.items(), box, strict=True)}
    return near.groupBy(F.col("a_pid").alias("pid")).agg(*[F.sum(g / F.col("d") ** 4).alias(f"r{a}") for a, g in gap.items()])


def line_integrals(ways: DataFrame, field: DataFrame, direction: Sequence[float]) -> DataFrame:
    """path_id, along and push: integrals of a fixed direction and of a vector field (gid, rx, ry, rz) along each way.

    ``ways``: path_id, pos, gid, x, y, z; the field is taken at the start of each step. Reversed ways have the opposite sign
    of ``along``.
    """
    w = Window.partitionBy("path_id").orderBy("pos")
    met = ways.join(field, "gid", "left")
    steps = met.withColumns({f"d{a}": F.lead(a).over(w) - F.col(a) for a in AXES}).where("dx is not null")
    along = sum((F.col(f"d{a}") * float(v) for a, v in zip(AXES, direction, strict=True)), F.lit(0.0))
    push = sum((F.col(f"d{a}") * F.coalesce(f"r{a}", F.lit(0.0)) for a in AXES), F.lit(0.0))
    return steps.groupBy("path_id").agg(F.sum(along).alias("along"), F.sum(push).alias("push"))


def arc_length(ways: DataFrame) -> DataFrame:
    """path_id and the summed distance of consecutive points."""
    w = Window.partitionBy("path_id").orderBy("pos")
    ahead = [F.lead(a).over(w) for a in AXES]
    step = ways.withColumn("d", distance([F.col(a) for a in AXES], ahead))
    return step.groupBy("path_id").agg(F.coalesce(F.sum("d"), F.lit(0.0)).alias("length"))


def visited(projected: DataFrame, keys: Sequence[str] = ("path_id",)) -> DataFrame:
    """keys, gid: the nodes that projected points pass over all their time."""
    return projected.select(*keys, "gid").distinct()
