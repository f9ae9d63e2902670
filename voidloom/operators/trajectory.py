"""Trajectories in long form (atom, frame, x, y, z): unwrapping, means, displacement statistics."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.geometry import AXES, axis_gap, distance, wrap
from ..session import checkpoint
from .points import pairs_within


def every_nth(frames: DataFrame, step: int, start: int = 0, stop: int | None = None, frame: str = "frame") -> DataFrame:
    """Frames ``start, start + step, ...`` below ``stop``; a plain filter that sources can push down."""
    kept = frames.where((F.col(frame) >= start) & ((F.col(frame) - start) % step == 0))
    return kept if stop is None else kept.where(F.col(frame) < stop)


def unwrap(frames: DataFrame, box: Sequence[float], axes: Sequence[str] = AXES, atom: str = "atom", frame: str = "frame") -> DataFrame:
    """Positions without jumps through the boundary: crossings add up ``floor((step + L/2) / L)`` of the raw steps."""
    w = Window.partitionBy(atom).orderBy(frame)
    total = w.rowsBetween(Window.unboundedPreceding, 0)
    crossed = {f"__{a}": F.coalesce(F.floor((F.col(a) - F.lag(a).over(w) + n / 2) / n), F.lit(0)) for a, n in zip(axes, box, strict=True)}
    return frames.withColumns(crossed).withColumns({a: F.col(a) - n * F.sum(f"__{a}").over(total) for a, n in zip(axes, box, strict=True)}).drop(*crossed)


def mean_positions(unwrapped: DataFrame, box: Sequence[float], axes: Sequence[str] = AXES, atom: str = "atom") -> DataFrame:
    """Mean of each atom over all frames, wrapped."""
    means = unwrapped.groupBy(atom).agg(*[F.avg(a).alias(a) for a in axes])
    return means.withColumns({a: wrap(F.col(a), n) for a, n in zip(axes, box, strict=True)})


def frechet_means(frames: DataFrame, box: Sequence[float], axes: Sequence[str] = AXES, atom: str = "atom", frame: str = "frame", every: int = 10, tolerance: float = 1e-9, rounds: int = 100) -> DataFrame:
    """Circular mean of each atom by fixed-point recentring from every ``every``-th frame; the lowest cost wins.

    The cost is the mean squared minimum-image distance. One task holds one atom's positions, in seed blocks.
    """
    lengths = np.array(box, float)

    def mean(data: pd.DataFrame) -> pd.DataFrame:
        pos = data.sort_values(frame)[list(axes)].to_numpy() % lengths
        best: tuple[float, np.ndarray] = (np.inf, pos[0])
        for seed in pos[::every]:
            centre, cost = seed.copy(), np.inf
            for _ in range(rounds):
                step = (pos - centre + lengths / 2) % lengths - lengths / 2
                now = float((step**2).sum(axis=1).mean())
                if abs(cost - now) <= tolerance:
                    break
                cost, centre = now, (centre + step.mean(axis=0)) % lengths
            if cost < best[0]:
                best = cost, centre
        return pd.DataFrame([[data[atom].iloc[0], *best[1], best[0]]], columns=[atom, *axes, "cost"])

    kind = frames.schema[atom].dataType.simpleString()
    return frames.select(atom, frame, *axes).groupBy(atom).applyInPandas(mean, ", ".join([f"{atom} {kind}", *[f"{a} double" for a in axes], "cost double"]))


def always_inside(frames: DataFrame, box: Sequence[float], axes: Sequence[str] = AXES, atom: str = "atom") -> DataFrame:
    """Atoms that are inside the box in every frame and on every axis."""
    inside = F.lit(True)
    for a, n in zip(axes, box, strict=True):
        inside = inside & (F.col(a) >= 0) & (F.col(a) <= n)
    good = frames.groupBy(atom).agg(F.bool_and(inside).alias("ok")).where("ok").select(atom)
    return frames.join(good, atom, "left_semi")


def range_travelled(frames: DataFrame, box: Sequence[float], stride: int, axes: Sequence[str] = AXES, atom: str = "atom", frame: str = "frame", depth: int = 6, bits: int = 2) -> DataFrame:
    """Largest minimum-image distance between two of an atom's positions (every ``stride``-th frame) over the box diagonal.

    Branch and bound over cells: each cell keeps one of its points, whose distances bound the atom's result from below; a pair
    of cells goes on to cells of a quarter (2^-``bits``) only while its points could be farther apart than that. Positions have to be wrapped.
    """
    kept = every_nth(frames, stride, frame=frame).select(atom, *axes).distinct()
    diagonal = float(np.sqrt((np.array(box, float) ** 2).sum()))

    def cells(level: int, side: str) -> DataFrame:
        """A row a cell: its indices on this level and the next coarser one, and one of its points."""
        at = kept.withColumns({f"c_{x}": F.floor(F.col(x) * 2**level / n).cast("int") for x, n in zip(axes, box, strict=True)})
        one = at.groupBy(atom, *[f"c_{x}" for x in axes]).agg(F.min(F.struct(*axes)).alias("p"))
        up = [F.shiftright(f"c_{x}", bits).alias(f"{side}u_{x}") for x in axes]
        return one.select(atom, *[F.col(f"c_{x}").alias(f"{side}c_{x}") for x in axes], *up, F.col("p").alias(f"{side}p"))

    def farthest(i: Column, j: Column, level: int, n: float) -> Column:
        """Largest gap along an axis of points in two cells; of a whole circle at most its half."""
        apart = F.abs(i - j)
        steps = F.least(apart, F.lit(2**level) - apart)
        return F.least((steps + 1) * (n / 2**level), F.lit(n / 2))

    pairs = kept.select(atom).distinct().select(atom, *[F.lit(0).alias(f"{s}u_{x}") for s in "ab" for x in axes])
    for level in range(bits, depth + 1, bits):
        a, b = cells(level, "a"), cells(level, "b")
        met = pairs.join(a, [atom, *[f"au_{x}" for x in axes]]).join(b, [atom, *[f"bu_{x}" for x in axes]])
        same = F.array(*[f"au_{x}" for x in axes]) == F.array(*[f"bu_{x}" for x in axes])  # each pair once
        met = met.where(~same | (F.struct(*[F.col(f"ac_{x}").alias(x) for x in axes]) <= F.struct(*[F.col(f"bc_{x}").alias(x) for x in axes])))
        low = distance([F.col(f"ap.{x}") for x in axes], [F.col(f"bp.{x}") for x in axes], box)
        high = F.sqrt(sum((farthest(F.col(f"ac_{x}"), F.col(f"bc_{x}"), level, n) ** 2 for x, n in zip(axes, box, strict=True)), F.lit(0.0)))
        found = checkpoint(met.select(atom, *[f"{s}c_{x}" for s in "ab" for x in axes], low.alias("low"), high.alias("high")))
        best = found.groupBy(atom).agg(F.max("low").alias("best"))
        left = found.join(best, atom).where(F.col("high") > F.col("best"))  # only these can hold a farther pair
        ends = best if level == bits else ends.unionByName(best).groupBy(atom).agg(F.max("best").alias("best"))
        pairs = left.select(atom, *[F.col(f"{s}c_{x}").alias(f"{s}u_{x}") for s in "ab" for x in axes])
        if level + bits > depth or pairs.isEmpty():
            break
    pairs = checkpoint(pairs)
    if not pairs.isEmpty():  # what the finest cells leave open is compared point by point
        at = kept.withColumns({f"u_{x}": F.floor(F.col(x) * 2**level / n).cast("int") for x, n in zip(axes, box, strict=True)})
        sides = [at.select(atom, *[F.col(f"u_{x}").alias(f"{s}u_{x}") for x in axes], *[F.col(x).alias(f"{s}_{x}") for x in axes]) for s in "ab"]
        met = pairs.join(sides[0], [atom, *[f"au_{x}" for x in axes]]).join(sides[1], [atom, *[f"bu_{x}" for x in axes]])
        d = distance([F.col(f"a_{x}") for x in axes], [F.col(f"b_{x}") for x in axes], box)
        ends = ends.unionByName(met.groupBy(atom).agg(F.max(d).alias("best"))).groupBy(atom).agg(F.max("best").alias("best"))
    return ends.select(atom, (F.col("best") / diagonal).alias("travelled"))


def spread(frames: DataFrame, means: DataFrame, box: Sequence[float], axes: Sequence[str] = AXES, atom: str = "atom") -> DataFrame:
    """Mean squared distance from the mean position of each atom; atoms seen beyond half a box from it are left out."""
    m = means.select(atom, *[F.col(a).alias(f"m_{a}") for a in axes])
    gaps = [axis_gap(F.col(a), F.col(f"m_{a}"), n) for a, n in zip(axes, box, strict=True)]
    raw = [F.abs(F.col(a) - F.col(f"m_{a}")) <= n / 2 for a, n in zip(axes, box, strict=True)]
    square = sum((g**2 for g in gaps), F.lit(0.0))
    near = F.lit(True)
    for r in raw:
        near = near & r
    return frames.join(m, atom).groupBy(atom).agg(F.avg(F.when(near, square)).alias("spread"))


def forbidden_balls(frames: DataFrame, half: float, sizes: dict[str, float], sign: float = -1.0, mobile: float = 0.0, axes: Sequence[str] = AXES, atom: str = "atom") -> DataFrame:
    """atom, species, axes, radius: balls around the mean positions of each species' atoms (atom, species, axes, one row a frame).

    A species' radius is its size plus ``sign`` times the variance of its atoms' distances from their means, plus the ``mobile`` atoms'
    radius. Atoms that are ever ``half`` (of the box) or more from their mean have no part in the variance but have a ball.
    """
    kept = frames.where(F.col("species").isin(list(sizes)))
    means = kept.groupBy(atom, "species").agg(*[F.avg(a).alias(f"m_{a}") for a in axes])
    gaps = kept.join(means.drop("species"), atom)
    gaps = gaps.select(atom, "species", distance([F.col(a) for a in axes], [F.col(f"m_{a}") for a in axes], (None,) * len(axes)).alias("d"))
    # sums of an atom's distances, so that leaving an atom out needs no second pass over frames
    own = gaps.groupBy(atom, "species").agg(F.max("d").alias("most"), F.count("*").alias("n"), F.avg("d").alias("mean"), F.var_pop("d").alias("var"))
    near = own.where(F.col("most") < half)
    total = near.groupBy("species").agg((F.sum(F.col("n") * F.col("mean")) / F.sum("n")).alias("all"))  # a row a species
    apart = near.join(F.broadcast(total), "species").withColumn("v", F.col("n") * (F.col("var") + F.pow(F.col("mean") - F.col("all"), 2)))
    spread_ = apart.groupBy("species").agg((F.sum("v") / F.sum("n")).alias("spread"))
    size = F.coalesce(*[F.when(F.col("species") == s, F.lit(float(d))) for s, d in sizes.items()])
    met = means.join(F.broadcast(spread_), "species", "left")
    return met.select(atom, "species", *[F.col(f"m_{a}").alias(a) for a in axes], (size + sign * F.col("spread") + mobile).alias("radius"))


def ion_shift(ions: DataFrame, backbone: DataFrame, mean_backbone: DataFrame, box: Sequence[float], axes: Sequence[str] = AXES, reach: float = 8.0) -> DataFrame:
    """Ions moved back by the backbone's displacement around them: weights ``exp(-d^2)`` of the distance to each atom.

    ions and backbone: atom, frame, axes (wrapped); mean_backbone: atom, axes. Weights are taken relative to the nearest atom's,
    which leads at any distance; an atom whose square is greater by 40 adds less than a double holds. So the nearest is found first, by
    a reach that grows, then ions meet what is within ``reach`` of them by cells, or twice that as long as their nearest atom is too
    far for it. What stands at the same place of a frame goes as one; sums are all that is kept of pairs.
    """
    farthest = float(np.sqrt((np.array(box, float) ** 2).sum())) / 2 * (1 + 1e-9)
    place = ["frame", *axes]
    own = ions.select(F.col("atom").alias("ion"), *place).distinct()
    moves = mean_backbone.select("atom", *[F.col(a).alias(f"m_{a}") for a in axes])
    # displacement of the backbone atom, through the boundary
    moved = [F.sum(F.pmod(F.col(a) - F.col(f"m_{a}") + n / 2, F.lit(float(n))) - n / 2).alias(f"u_{a}") for a, n in zip(axes, box, strict=True)]
    b = checkpoint(backbone.select("atom", *place).join(moves, "atom").groupBy(*place).agg(F.count("*").alias("n"), *moved))
    left = checkpoint(own.select(*place).distinct().join(b.select("frame").distinct(), "frame", "left_semi"))
    sums = [F.sum(F.col("weight") * F.col(f"b_{c}")).alias(c) for c in ("n", *[f"u_{a}" for a in axes])]

    at = [F.col(f"a_{c}").alias(c) for c in place]

    def met(of: DataFrame, within: float) -> DataFrame:
        return pairs_within(of, b, within, box, ["frame"], axes).withColumn("square", F.col("d") * F.col("d"))

    nearest, near = None, reach / 8
    while True:
        near = min(near, farthest)
        got = checkpoint(met(left, near).groupBy(*at).agg(F.min("square").alias("least")))
        nearest = got if nearest is None else nearest.unionByName(got)
        left = checkpoint(left.join(got.select(*place), place, "left_anti"))
        if near >= farthest or left.isEmpty():
            break
        near *= 8 if near < reach else 2
    left, found = checkpoint(nearest), None
    while True:
        settled = left if reach >= farthest else left.where(F.col("least") + 40 <= reach * reach)
        pairs = met(settled, reach).where(F.col("square") <= F.col("a_least") + 40)
        weighed = pairs.withColumn("weight", F.exp(F.col("a_least") - F.col("square")))
        summed = checkpoint(weighed.groupBy(*at).agg(*sums))
        found = summed if found is None else found.unionByName(summed)
        left = left.where(F.col("least") + 40 > reach * reach)
        if reach >= farthest or left.isEmpty():
            break
        reach = min(2 * reach, farthest)
    back = [wrap(F.col(a) - F.col(f"u_{a}") / F.col("n"), n).alias(a) for a, n in zip(axes, box, strict=True)]
    return own.join(found, place).select(F.col("ion").alias("atom"), "frame", *back)


def mean_volume(boxes: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """keys, volume: mean over frames of the box volume (lx, ly, lz)."""
    return boxes.groupBy(*keys).agg(F.avg(F.col("lx") * F.col("ly") * F.col("lz")).alias("volume"))
