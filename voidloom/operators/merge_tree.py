"""Components of a growing graph and when they end: 0-dimensional persistence of samples of any size.

The edges of a sample are numbered by value. A range of numbers is halved: its lower half joins points into components
(rounds of joins), the upper half is renamed by them, loses what became a loop or runs beside an earlier edge, and both go on at the same
time, each with the points that it needs. When a range is short enough to be one task's group, its edges are taken in order
there. A component is called by its oldest point, so an edge ends the younger of its two names.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.geometry import AXES, distance, touching_value
from ..session import checkpoint
from .graph import components
from .points import pairs_within
from .scan import numbered
from .tiles import simplices_by_tiles


def _ends(key: tuple, edges: pd.DataFrame) -> pd.DataFrame:
    """sample, age, value of the names that a range's edges end, taken in order."""
    edges = edges.sort_values("rank")
    names, ends = np.unique(edges[["a", "b"]].to_numpy(), return_inverse=True)
    root, out = list(range(len(names))), []

    def find(x: int) -> int:
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for (a, b), value in zip(ends.reshape(-1, 2).tolist(), edges["value"], strict=True):
        old, young = sorted((find(a), find(b)))  # names stand in order of age
        if old != young:
            root[young] = old
            out.append((key[0], int(names[young]), value))
    return pd.DataFrame(out, columns=["sample", "age", "value"])


def merges(edges: DataFrame, chunk: int = 1 << 15) -> DataFrame:
    """sample, age, value: when each point's component meets an older one. ``edges``: sample, a, b (ages: 0 is the oldest of a
    sample), value. Ranges of up to ``chunk`` edges go into one task."""
    kind = edges.schema["sample"].dataType.simpleString()
    ranked = numbered(edges.where("a <> b"), ["value", "a", "b"], "rank", ["sample"]).withColumn("from", F.lit(0).cast("long"))
    left = checkpoint(ranked.select("sample", "from", F.col("rank").cast("long").alias("rank"), F.col("a").cast("long").alias("a"), F.col("b").cast("long").alias("b"), "value"))
    width = 1
    while width < (left.agg(F.max("rank")).first()[0] or 0) + 1:
        width *= 2
    while width > chunk:
        width //= 2
        lower, upper = left.where(F.col("rank") - F.col("from") < width), left.where(F.col("rank") - F.col("from") >= width)
        names = components(lower, ["sample", "from"])
        for side in ("a", "b"):
            own = names.select("sample", "from", F.col("node").alias(side), F.col("component").alias("name"))
            upper = upper.join(own, ["sample", "from", side], "left").withColumn(side, F.coalesce("name", side)).drop("name")
        x, y = F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")
        first = upper.where("a <> b").groupBy("sample", (F.col("from") + width).alias("from"), x, y).agg(F.min(F.struct("rank", "value")).alias("m"))
        left = checkpoint(lower.unionByName(first.select("sample", "from", "m.rank", "a", "b", "m.value")))
    return left.groupBy("sample", "from").applyInPandas(lambda key, f: _ends(key, f), f"sample {kind}, age long, value double")


def h0_by_merging(points: DataFrame, pairs: DataFrame, chunk: int = 1 << 15) -> DataFrame:
    """sample, pid, birth, death: the 0-dimensional diagram from touching pairs alone (sample, a_pid, b_pid, value), without
    points of zero persistence. Points (sample, pid, w) of a sample start at -w and end when their component meets an
    older one, by weight, then pid; no triangulation is needed."""
    aged = checkpoint(numbered(points.select("sample", "pid", "w", (-F.col("w")).alias("birth")), ["birth", "pid"], "age", ["sample"]))
    edges = pairs.select("sample", "a_pid", "b_pid", "value")
    for side in ("a", "b"):
        edges = edges.join(aged.select("sample", F.col("pid").alias(f"{side}_pid"), F.col("age").alias(side)), ["sample", f"{side}_pid"])
    ended = merges(edges.select("sample", "a", "b", "value"), chunk)
    met = aged.join(ended, ["sample", "age"], "left")
    return met.select("sample", F.col("pid").cast("long").alias("pid"), "birth", F.coalesce("value", F.lit(float("inf"))).alias("death")).where("death > birth")


def _h0_of_many(points: DataFrame, chunk: int) -> DataFrame:
    """The same of large samples, from the edges of their triangulation: balls that grow together do so along these. A point that is
    hidden lies in another's ball when its own begins. Samples in a plane have no edges and are absent."""
    found = checkpoint(simplices_by_tiles(points).where("dim <= 1").select("sample", "dim", F.col("verts")[0].alias("a_pid"), F.get("verts", F.lit(1)).alias("b_pid")))
    edges = found.where("dim = 1").select("sample", "a_pid", "b_pid")
    for s in "ab":
        edges = edges.join(points.select("sample", *[F.col(c).alias(f"{s}_{c}") for c in ("pid", *AXES, "w")]), ["sample", f"{s}_pid"])
    d = distance([F.col(f"a_{x}") for x in AXES], [F.col(f"b_{x}") for x in AXES])
    pairs = edges.withColumn("d", d).select("sample", "a_pid", "b_pid", touching_value(F.col("d"), F.col("a_w"), F.col("b_w")).alias("value"))
    seen = found.where("dim = 0").select("sample", F.col("a_pid").alias("pid")).join(pairs.select("sample").distinct(), "sample", "left_semi")
    return h0_by_merging(points.join(seen, ["sample", "pid"], "left_semi"), pairs, chunk)


def h0_of_points(points: DataFrame, reach: float, chunk: int = 1 << 15, most: int = 4000) -> DataFrame:
    """``h0_by_merging`` of weighted points (sample, pid, x, y, z, w) over all pairs that can matter.

    Samples of more than ``most`` points take the edges of their triangulation, a few for each point. In others
    pairs within ``reach`` come first. A sample is done when one class is left and its last end is below what any pair beyond the
    reach can have; the others go on with twice the reach.
    """
    weights = [F.min("w").alias("w0"), F.max("w").alias("w1")]
    spans = [e(a).alias(f"{a}{i}") for a in AXES for i, e in enumerate((F.min, F.max))]
    # a row a sample; ``far``: the diagonal of its points
    size = points.groupBy("sample").agg(F.count("*").alias("many"), *weights, *spans).select("sample", "many", "w0", "w1", F.sqrt(sum(((F.col(f"{a}1") - F.col(f"{a}0")) ** 2 for a in AXES), F.lit(0.0))).alias("far"))
    large = checkpoint(size.where(F.col("many") > most).select("sample"))
    left, found = points.join(size, "sample"), None
    if not large.isEmpty():
        found = checkpoint(_h0_of_many(checkpoint(points.select("sample", F.col("pid").cast("long").alias("pid"), *AXES, "w").join(large, "sample", "left_semi")), chunk))
        left = checkpoint(left.join(found.select("sample").distinct(), "sample", "left_anti"))
        if left.isEmpty():
            return found
    while True:
        at = left.select("sample", "pid", *AXES, "w")
        pairs = pairs_within(at, at, reach, keys=["sample"]).where("a_pid < b_pid")
        value = touching_value(F.col("d"), F.col("a_w"), F.col("b_w"))
        now = checkpoint(h0_by_merging(at, pairs.select(F.col("a_sample").alias("sample"), "a_pid", "b_pid", value.alias("value")), chunk))
        last = now.groupBy("sample").agg(F.count(F.when(F.col("death") == float("inf"), 1)).alias("n"), F.max(F.when(F.col("death") < float("inf"), F.col("death"))).alias("last"))
        gap = F.col("w1") - F.col("w0")
        beyond: Column = F.pow((F.lit(reach * reach) - gap) / (2 * reach), 2) - F.col("w1")
        done = (F.col("far") <= reach) | (F.col("n") == 1) & (gap <= reach * reach) & (F.coalesce("last", F.lit(float("-inf"))) <= beyond)
        settled = checkpoint(size.join(last, "sample").where(done).select("sample"))
        part = now.join(settled, "sample", "left_semi")
        found = part if found is None else found.unionByName(part)
        left = checkpoint(left.join(settled, "sample", "left_anti"))
        if left.isEmpty():
            return found
        reach *= 2
