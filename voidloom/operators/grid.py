"""Regular grids, voids and Reeb graphs as tables of integer coordinates; ids are ``(iy * nx + ix) * nz + iz``."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.geometry import axis_gap, offsets


@dataclass(frozen=True)
class Grid:
    """``shape`` nodes over ``box``, without the far end; ``relax`` repeats so many planes on top of z."""

    shape: tuple[int, int, int]
    box: tuple[float, float, float]
    periodic: tuple[bool, bool, bool] = (True, True, False)
    relax: int = 0

    @property
    def spacing(self) -> tuple[float, ...]:
        return tuple(b / n for b, n in zip(self.box, self.shape, strict=True))

    @property
    def nz(self) -> int:
        return self.shape[2] + self.relax

    def gid(self, ix: Column, iy: Column, iz: Column) -> Column:
        return ((iy * self.shape[0] + ix) * self.nz + iz).cast("long")


def nodes(spark: SparkSession, grid: Grid) -> DataFrame:
    """gid, ix, iy, iz, x, y, z of every node, split over tasks by ``range``."""
    nx, ny, _ = grid.shape
    df = spark.range(nx * ny * grid.nz).select(F.col("id").alias("gid"))
    ix, iy, iz = (F.col("gid") / grid.nz).cast("long") % nx, (F.col("gid") / (grid.nz * nx)).cast("long"), F.col("gid") % grid.nz
    df = df.select("gid", ix.cast("int").alias("ix"), iy.cast("int").alias("iy"), iz.cast("int").alias("iz"))
    return df.withColumns({a: F.col(f"i{a}") * s for a, s in zip("xyz", grid.spacing, strict=True)})


def covered(grid: Grid, balls: DataFrame, any_ball: bool = False) -> DataFrame:
    """Nodes inside balls, as gid and ix, iy, iz.

    ``balls``: bid, x, y, z (wrapped), radius. Each ball visits only the nodes in reach of the largest radius, so the
    work is linear in balls. A node is covered if it lies within the radius of its *nearest* ball (ties: smaller bid), or
    with ``any_ball`` strictly within any.
    """
    spark = balls.sparkSession
    top = balls.agg(F.max("radius")).first()[0] or 0.0
    reach = [int(top / s) + 1 for s in grid.spacing]
    steps = F.broadcast(offsets(spark, reach))  # (2 reach + 1)^3 rows, from the radius and the spacing alone
    at = balls.join(steps, F.lit(True), "cross")
    for a, s, n, p, t in zip("xyz", grid.spacing, (grid.shape[0], grid.shape[1], grid.shape[2]), grid.periodic, (0, 0, grid.relax), strict=True):
        i = F.rint(F.col(a) / s).cast("int") + F.col(f"d{a}").cast("int")
        at = at.withColumn(f"i{a}", F.pmod(i, F.lit(n)) if p or t else i).where((F.col(f"i{a}") >= 0) & (F.col(f"i{a}") < n))
    gap = [axis_gap(F.col(a), F.col(f"i{a}") * s, b if p or t else None) for a, s, b, p, t in zip("xyz", grid.spacing, grid.box, grid.periodic, (0, 0, grid.relax), strict=True)]
    at = at.withColumn("d", F.sqrt(sum((g * g for g in gap), F.lit(0.0)))).where(F.col("d") <= top)
    keys = ["ix", "iy", "iz"]
    if any_ball:
        hit = at.where(F.col("d") < F.col("radius")).select(*keys).distinct()
    else:
        best = at.groupBy(*keys).agg(F.min(F.struct("d", "bid", "radius")).alias("b"))
        hit = best.where("b.d <= b.radius").select(*keys)
    if grid.relax:  # the planes on top repeat the first ones
        n = grid.shape[2]
        again = hit.where(F.col("iz") < grid.relax).select("ix", "iy", (F.col("iz") + n).alias("iz"))
        hit = hit.unionByName(again)
    return hit.select(grid.gid(F.col("ix"), F.col("iy"), F.col("iz")).alias("gid"), *keys)


def void(grid: Grid, balls: DataFrame, any_ball: bool = False, open_ends: bool = False) -> DataFrame:
    """Nodes outside the balls; with ``open_ends`` the first and last plane are void in any case."""
    hit = covered(grid, balls, any_ball)
    hit = hit.where((F.col("iz") > 0) & (F.col("iz") < grid.nz - 1)) if open_ends else hit
    return nodes(balls.sparkSession, grid).join(hit.select("gid"), "gid", "left_anti")


def neighbours(grid: Grid, kept: DataFrame, reach: str | float = "corner") -> DataFrame:
    """gid and nid of neighbouring kept nodes (corner: 26, edge: 18, face: 6), through periodic boundaries of x and y.

    A number for ``reach`` joins all nodes nearer than 1.001 times so many cell diagonals; in a cube 1.0 gives the 26.
    """
    if isinstance(reach, str):
        most = {"face": 1, "edge": 2, "corner": 3}[reach]
        steps = offsets(kept.sparkSession).where((F.abs("dx") + F.abs("dy") + F.abs("dz")).between(1, most))
    else:
        far = 1.001 * reach * sum(s * s for s in grid.spacing) ** 0.5
        square = sum((F.col(f"d{a}") * F.col(f"d{a}") * (s * s) for a, s in zip("xyz", grid.spacing, strict=True)), F.lit(0.0))
        steps = offsets(kept.sparkSession, [int(far / s) for s in grid.spacing]).where((square > 0) & (square < far * far))
    at = kept.select("gid", "ix", "iy", "iz").crossJoin(F.broadcast(steps))  # 26 rows, more for a wider reach
    for a, n, p in zip("xyz", (grid.shape[0], grid.shape[1], grid.nz), grid.periodic, strict=True):
        i = F.col(f"i{a}") + F.col(f"d{a}")
        at = at.withColumn(f"j{a}", F.pmod(i, F.lit(n)) if p else i).where((F.col(f"j{a}") >= 0) & (F.col(f"j{a}") < n))
    at = at.select("gid", grid.gid(F.col("jx"), F.col("jy"), F.col("jz")).alias("nid"))
    return at.join(kept.select(F.col("gid").alias("nid")), "nid", "left_semi").where("gid <> nid").select("gid", "nid").distinct()


def largest_variation(edges: DataFrame, values: DataFrame) -> DataFrame:
    """Largest difference of ``f`` (gid, f) between a node and a neighbour."""
    f = values.select(F.col("gid"), F.col("f"))
    g = values.select(F.col("gid").alias("nid"), F.col("f").alias("g"))
    return edges.join(f, "gid").join(g, "nid").groupBy("gid").agg(F.max(F.abs(F.col("f") - F.col("g"))).alias("variation"))


def level_sets(kept: DataFrame, stride: int, cover: int = 1) -> DataFrame:
    """level, plane and members: levels 0, s, 2s, ... and every index after the last multiple, each with its slab.

    Levels count the planes that hold any kept node, so empty planes are skipped.
    """
    planes = kept.select("iz").distinct()  # at most nz rows
    planes = planes.select("iz", (F.row_number().over(Window.orderBy("iz")) - 1).alias("plane"))
    n = planes.agg(F.max("plane")).first()[0]
    if n is None:
        return kept.select("gid", "ix", "iy", "iz", F.lit(0).alias("level")).where("false")
    last = (n // stride) * stride
    chosen = sorted({*range(0, n + 1, stride), *range(last, n + 1)})
    centre = planes.where(F.col("plane").isin(chosen)).select(F.col("iz").alias("cz"), F.dense_rank().over(Window.orderBy("iz")).alias("level"))
    centre = centre.select((F.col("level") - 1).alias("level"), F.explode(F.sequence(F.col("cz") - cover, F.col("cz") + cover)).alias("iz"))
    return kept.join(F.broadcast(centre), "iz").select("gid", "ix", "iy", "iz", "level")  # at most nz * (2 cover + 1) rows


def labelled(grid: Grid, levels: DataFrame, rounds: int = 200, reach: str | float = "corner") -> DataFrame:
    """``node``: smallest gid of the connected component (neighbours within ``reach``) of each (level, gid)."""
    from .graph import components

    pairs = neighbours(grid, levels.select("gid", "ix", "iy", "iz").distinct(), reach)
    a = levels.select("level", "gid")
    b = levels.select(F.col("level").alias("l2"), F.col("gid").alias("nid"))
    edges = a.join(pairs, "gid").join(b, ["nid"]).where("level = l2").select("level", F.col("gid").alias("a"), F.col("nid").alias("b"))
    found = components(edges, keys=["level"], rounds=rounds)
    return levels.join(found.select("level", F.col("node").alias("gid"), "component"), ["level", "gid"], "left").select("level", "gid", "ix", "iy", "iz", F.coalesce("component", "gid").alias("node"))


def norm_of(stride: int, cover: int = 1) -> int:
    """Size by which node measures and capacities are divided: floor(1.001 * cover / stride) + 1."""
    return int(1.001 * cover / stride) + 1


def reeb_nodes(members: DataFrame, norm: int, grid: Grid) -> DataFrame:
    """level, node, measure ``max(rint(size / norm), 1)`` and mean position."""
    centre = [(F.avg(f"i{a}") * s).alias(f"p{a}") for a, s in zip("xyz", grid.spacing, strict=True)]
    return members.groupBy("level", "node").agg(F.greatest(F.rint(F.count("*") / norm), F.lit(1.0)).cast("long").alias("measure"), *centre)


def reeb_edges(members: DataFrame, norm: int) -> DataFrame:
    """Components of neighbouring levels that share nodes: level, src, dst, capacity ``max(shared // norm, 1)``."""
    a = members.select("gid", "level", F.col("node").alias("src"))
    b = members.select("gid", (F.col("level") - 1).alias("level"), F.col("node").alias("dst"))
    shared = a.join(b, ["gid", "level"]).groupBy("level", "src", "dst").agg(F.count("*").alias("n"))
    return shared.select("level", "src", "dst", F.greatest(F.floor(F.col("n") / norm), F.lit(1)).cast("long").alias("capacity"))


def triangles(grid: Grid, kept: DataFrame) -> DataFrame:
    """Triangles a < b < c of neighbouring kept nodes that lie in one coordinate square (two ways to halve it)."""
    e = neighbours(grid, kept, "edge").where("gid < nid")
    ab, bc, ac = (e.select(F.col("gid").alias(p), F.col("nid").alias(q)) for p, q in (("a", "b"), ("b", "c"), ("a", "c")))
    found = ab.join(bc, "b").join(ac, ["a", "c"])
    # one of the three sides is a square's diagonal and the other two its edges
    sides = neighbours(grid, kept, "face").where("gid < nid").withColumn("one", F.lit(1))
    for p, q in (("a", "b"), ("b", "c"), ("a", "c")):
        found = found.join(sides.select(F.col("gid").alias(p), F.col("nid").alias(q), F.col("one").alias(f"{p}{q}")), [p, q], "left")
    total = sum((F.coalesce(c, F.lit(0)) for c in ("ab", "bc", "ac")), F.lit(0))
    return found.where(total == 2).select("a", "b", "c")


def plane_edges(edges: DataFrame, grid: Grid, iz: int) -> DataFrame:
    """Edges (gid, nid) within one plane of z; ids tell the plane, so no coordinates are joined."""
    return edges.where((F.col("gid") % grid.nz == iz) & (F.col("nid") % grid.nz == iz))


def node_numbers(members: DataFrame) -> DataFrame:
    """level, node, number: consecutive numbers from 0 over all levels, within a level by the components' smallest node."""
    from .scan import numbered

    return numbered(members.select("level", "node").distinct(), ["level", "node"], "number")


def surroundings(members: DataFrame, balls: DataFrame, grid: Grid, reach: float) -> DataFrame:
    """level, node, bid: the balls that are nearest (within ``reach``) to a grid node of a component."""
    from .points import nearest_within

    at = members.select("gid").distinct()
    for k, a in enumerate("xyz"):
        place = {"x": (F.col("gid") / grid.nz).cast("long") % grid.shape[0], "y": (F.col("gid") / (grid.nz * grid.shape[0])).cast("long"), "z": F.col("gid") % grid.nz}[a]
        at = at.withColumn(a, place * grid.spacing[k])
    box = tuple(n if p else None for n, p in zip(grid.box, grid.periodic, strict=True))
    near = nearest_within(at, balls.select("bid", "x", "y", "z"), reach, "gid", "bid", box)
    return members.select("level", "node", "gid").join(near, "gid").select("level", "node", "bid").distinct()
