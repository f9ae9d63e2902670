"""Cobordisms of two slabs: the columns of phi, their reduction, and the diagram of what only the union has.

The image decompositions of A and of B in the whole (a kernel over one sample) give rows (matrix, col, row). What follows is
relational: a simplex keeps its columns where the low of its reduced column lies in the slab or the column is empty, a simplex
that keeps both stands there twice, and the second of its reduced columns closes the class that it is low of.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import checkpoint
from . import z2
from .diagrams import ESSENTIAL, duplicate_pairs, new_births, to_values
from .topology import boundaries, kernel_image_cokernel, reduce_columns

#: Bits of a simplex id within a sample.
SID_BITS = 40
DECOMPOSITION = "sample int, matrix string, col long, row long"


def image_decomposition(simplices: DataFrame) -> DataFrame:
    """sample, matrix (``v``: columns that were added up, ``r``: reduced), col, row of the boundary matrix whose rows stand with the
    subcomplex (``in_sub``) first; ids are the simplices'."""

    def solve(data: pd.DataFrame) -> pd.DataFrame:
        data = data.sort_values(["value", "dim", "sid"])
        verts = [tuple(sorted(v)) for v in data["verts"]]
        sid, sub = data["sid"].tolist(), data["in_sub"].tolist()
        rank = {j: i for i, j in enumerate(sorted(range(len(verts)), key=lambda j: (not sub[j], j)))}
        r, v, _ = reduce_columns(boundaries(verts), [rank[j] for j in range(len(verts))], with_v=True)
        rows = [(name, sid[col], sid[row]) for name, matrix in (("r", r), ("v", v)) for col, held in enumerate(matrix) for row in held]
        low = [("low", sid[col], sid[max(held, key=rank.__getitem__)]) for col, held in enumerate(r) if held]
        return pd.DataFrame(rows + low, columns=["matrix", "col", "row"]).assign(sample=data["sample"].iloc[0])[["sample", "matrix", "col", "row"]]

    return simplices.select("sample", "sid", "dim", "verts", "value", "in_sub").groupBy("sample").applyInPandas(solve, DECOMPOSITION)


def phi_columns(simplices: DataFrame, a: DataFrame, b: DataFrame) -> DataFrame:
    """sample, simplex, ord, row: the columns of phi, of simplices (sample, sid, verts, in_a, in_b) and the decompositions of A and B.

    A's column counts where its reduced column is empty or has its low in A, or else the simplex has no columns; B's counts where its
    reduced column has its low in B, and a low outside B takes both away. Of two columns A's stands first where the simplex's
    first vertex is in A.
    """
    inside = simplices.select("sample", "sid", "in_a", "in_b")
    first = simplices.where("dim = 0").select("sample", F.col("verts")[0].alias("vertex"), F.col("in_a").alias("a_first"))

    def low(of: DataFrame, name: str) -> DataFrame:
        found = of.where("matrix = 'low'").select("sample", F.col("col").alias("simplex"), F.col("row").alias("sid"))
        return found.join(inside, ["sample", "sid"]).select("sample", "simplex", F.col(f"in_{name}").alias(f"low_{name}"))

    kept = simplices.select("sample", F.col("sid").alias("simplex"), "in_a", "in_b", F.array_min("verts").alias("vertex"))
    kept = kept.join(first, ["sample", "vertex"]).join(low(a, "a"), ["sample", "simplex"], "left").join(low(b, "b"), ["sample", "simplex"], "left")
    kept = kept.where(F.coalesce("low_a", F.lit(True)) & F.coalesce("low_b", F.lit(True)) & ~(F.col("in_a") & F.col("in_b") & F.col("low_b").isNotNull()))
    both = F.col("low_b").isNotNull()
    sides = F.when(both & F.col("a_first"), F.array(F.lit("a"), F.lit("b"))).when(both, F.array(F.lit("b"), F.lit("a"))).otherwise(F.array(F.lit("a")))
    asked = kept.select("sample", "simplex", F.posexplode(sides).alias("ord", "side"))
    held = a.withColumn("side", F.lit("a")).unionByName(b.withColumn("side", F.lit("b"))).where("matrix = 'v'")
    return asked.join(held.select("sample", "side", F.col("col").alias("simplex"), "row"), ["sample", "side", "simplex"]).select("sample", "simplex", "ord", "row")


def reduced_lows(phi: DataFrame, chunk: int = 1 << 13) -> DataFrame:
    """sample, simplex, ord, low of phi's columns after reduction; low is null where nothing is left. Columns stand by simplex and
    order, rows by id."""
    numbered = phi.select("sample", (F.col("simplex") * 2 + F.col("ord")).alias("col"), "row")
    found = z2.lows(z2.reduce(numbered, ["sample"], chunk), ["sample"])
    every = numbered.select("sample", "col").distinct().join(found, ["sample", "col"], "left")
    return every.select("sample", F.floor(F.col("col") / 2).alias("simplex"), (F.col("col") % 2).cast("int").alias("ord"), "low")


def cobordism(simplices: DataFrame, max_dim: int = 1, chunk: int = 1 << 13) -> DataFrame:
    """sample and a diagram (ids of its simplices) of classes of two slabs joined by what lies between: births of the union's
    kernel that neither slab has, up to ``max_dim``, with the simplices whose second column of phi has them as its low.

    ``simplices`` carry in_a and in_b; all samples run side by side.
    """

    def named(sid: str) -> Column:  # one number for a sample's simplex; samples are not negative
        return F.when(F.col(sid) == ESSENTIAL, F.lit(ESSENTIAL)).otherwise(F.shiftleft(F.col("sample").cast("long"), SID_BITS) + F.col(sid))

    # classes up to max_dim are born and closed by simplices of one dimension more at most
    both = checkpoint(simplices.where(F.col("dim") <= max_dim + 1).withColumn("in_ab", F.col("in_a") | F.col("in_b")))

    def within(flag: str) -> DataFrame:
        return both.withColumn("in_sub", F.col(flag)).select("sample", "sid", "dim", "verts", "value", "in_sub")

    def births(flag: str) -> DataFrame:
        found = kernel_image_cokernel(within(flag)).where((F.col("kind") == "kernel") & (F.col("dim") <= max_dim))
        return checkpoint(found.select(named("birth_simplex").alias("birth_id")))

    new = new_births(births("in_ab"), births("in_a"), births("in_b"))
    phi = checkpoint(phi_columns(both, checkpoint(image_decomposition(within("in_a"))), checkpoint(image_decomposition(within("in_b")))))
    columns = reduced_lows(phi, chunk).select(named("simplex").alias("simplex"), "ord", named("low").alias("low"))
    found = to_values(duplicate_pairs(columns, new), both.withColumn("sid", named("sid")))
    plain = {c: F.when(F.col(c) == ESSENTIAL, F.lit(ESSENTIAL)).otherwise(F.col(c).bitwiseAND((1 << SID_BITS) - 1)) for c in ("birth_id", "death_id")}
    return found.withColumn("sample", F.shiftright("birth_id", SID_BITS).cast("int")).withColumns(plain)
