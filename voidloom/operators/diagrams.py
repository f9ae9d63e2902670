"""Persistence diagrams as tables (birth, death): accumulated persistence, display values, births and pairings."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .scan import running_total

#: Death id of an essential class.
ESSENTIAL = 9223372036854775807


def mean_age() -> Column:
    return (F.col("birth") + F.col("death")) / 2


def apf(diagram: DataFrame, keys: Sequence[str] = (), ties: Sequence[str] = ("birth", "death"), dedup: bool = False) -> DataFrame:
    """Accumulated persistence: rows by mean age with the running sum of lifetimes, in any group size.

    ``ties`` complete the order among equal mean ages; with ``dedup`` only the last row of each mean age stays.
    """
    rows = diagram.withColumn("mean_age", mean_age())
    curve = running_total(rows, keys, ["mean_age", *ties], F.abs(F.col("death") - F.col("birth")), "lifetime")
    if not dedup:
        return curve.select(*keys, "mean_age", *ties, "lifetime")
    return curve.groupBy(*keys, "mean_age").agg(F.max("lifetime").alias("lifetime"))


def apf_end(diagram: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Number of points, last mean age and total lifetime of each curve."""
    life = F.abs(F.col("death") - F.col("birth"))
    return diagram.groupBy(*keys).agg(F.count("*").alias("n"), F.max(mean_age()).alias("mean_age"), F.sum(life).alias("lifetime"))


def apf_padded(curves: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Every curve drawn on to ``ceil(1.1 * largest mean age)`` with its last value."""
    last = curves.groupBy(*keys).agg(F.max(F.struct("mean_age", "lifetime")).alias("end"))
    top = curves.agg(F.ceil(1.1 * F.max("mean_age")).cast("double").alias("mean_age"))
    ends = last.crossJoin(F.broadcast(top)).select(*keys, "mean_age", F.col("end.lifetime").alias("lifetime"))  # one row
    return curves.select(*keys, "mean_age", "lifetime").unionByName(ends)


def display(diagram: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """``shown`` death (essential classes at 1.1 times the largest finite death) and ``tag`` fin or inf."""
    inf = F.lit(float("inf"))
    top = diagram.groupBy(*keys).agg((1.1 * F.max(F.when(F.col("death") != inf, F.col("death")))).alias("__top"))
    joined = diagram.join(F.broadcast(top), list(keys)) if keys else diagram.crossJoin(F.broadcast(top))  # a row a group
    essential = F.col("death") == inf
    return joined.withColumns({"shown": F.when(essential, F.col("__top")).otherwise(F.col("death")), "tag": F.when(essential, "inf").otherwise("fin")}).drop("__top")


def new_births(union: DataFrame, first: DataFrame, second: DataFrame, key: str = "birth_id") -> DataFrame:
    """Births of the union that neither part has."""
    return union.join(first, key, "left_anti").join(second, key, "left_anti")


def duplicate_pairs(columns: DataFrame, births: DataFrame, column_id: str = "simplex", low: str = "low") -> DataFrame:
    """Cokernel pairs: a simplex that occurs twice pairs with the low of its second column if that is a birth.

    ``columns``: column_id, ord, low. Result: birth_id, death_id; births without a partner are essential.
    """
    w = Window.partitionBy(column_id).orderBy("ord")
    second = columns.withColumn("__n", F.row_number().over(w)).where("__n = 2").select(F.col(column_id).alias("death_id"), F.col(low).alias("birth_id"))
    first = second.groupBy("birth_id").agg(F.min("death_id").alias("death_id"))
    return births.select(F.col("birth_id")).distinct().join(first, "birth_id", "left").select("birth_id", F.coalesce("death_id", F.lit(ESSENTIAL)).alias("death_id"))


def to_values(pairs: DataFrame, simplices: DataFrame) -> DataFrame:
    """Ids to filtration values: birth, death, birth_id, death_id and the number of vertices of the birth simplex."""
    s = simplices.select(F.col("sid").alias("birth_id"), F.col("value").alias("birth"), F.size("verts").alias("n_vertices"))
    t = simplices.select(F.col("sid").alias("death_id"), F.col("value").alias("death"))
    joined = pairs.join(s, "birth_id").join(t, "death_id", "left")
    return joined.select("birth", F.coalesce("death", F.lit(float("inf"))).alias("death"), "birth_id", "death_id", "n_vertices")


def cycle_composition(cycles: DataFrame, points: DataFrame) -> DataFrame:
    """How many vertices of each species a cycle has; cycles: cycle_id, verts."""
    v = cycles.select("cycle_id", F.explode(F.array_distinct("verts")).alias("pid"))
    return v.join(points.select("pid", "species"), "pid").groupBy("cycle_id", "species").agg(F.count("*").alias("n"))


def summary(diagrams: DataFrame) -> DataFrame:
    """Counts and total finite persistence by sample, kind and dimension, with totals of samples and kinds."""
    life = F.when(F.col("death") != float("inf"), F.col("death") - F.col("birth"))
    return diagrams.rollup("sample", "kind", "dim").agg(F.count("*").alias("n"), F.sum(life).alias("persistence"))
