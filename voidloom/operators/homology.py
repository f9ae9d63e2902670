"""Paths and loops up to homology over Z/2: edge vectors, normal forms, classes, filling chains and short cuts.

A path is homologous to another if their difference bounds a sum of triangles. As this is linear in the edge vectors,
each path gets the normal form of its vector modulo the triangle boundaries, and classes are plain groups of equal forms.
One complex (``keys``) is one group.
"""

from __future__ import annotations

from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.paths import drop_repeats, steps
from ..session import checkpoint

Edge = tuple[int, int]


def edge_vectors(paths: DataFrame, edges: DataFrame | None = None) -> DataFrame:
    """path_id, edges: the edges that a path (path_id, path) uses an odd number of times, in order.

    With ``edges`` (a < b) steps that are no edge are skipped, so loops may be joined across far ends.
    """
    flat = paths.select("path_id", F.explode(steps(drop_repeats(F.col("path")))).alias("e")).select("path_id", "e.u", "e.v")
    if edges is not None:
        flat = flat.join(edges.select(F.col("a").alias("u"), F.col("b").alias("v")), ["u", "v"], "left_semi")
    odd = flat.groupBy("path_id", "u", "v").agg((F.count("*") % 2).alias("odd")).where("odd = 1")
    found = odd.groupBy("path_id").agg(F.array_sort(F.collect_list(F.struct("u", "v"))).alias("edges"))
    empty = F.array().cast("array<struct<u:bigint,v:bigint>>")
    return paths.select("path_id").join(found, "path_id", "left").select("path_id", F.coalesce(F.col("edges").cast("array<struct<u:bigint,v:bigint>>"), empty).alias("edges"))


class Boundaries:
    """Triangle boundaries in echelon form: each stored column ends in an edge of its own."""

    def __init__(self, triangles: list[tuple[int, int, int]], free: list[Edge] = ()):
        self.columns: dict[Edge, tuple[set[Edge], set[int]]] = {}
        for edge in free:  # edges of the boundary that may be crossed at will
            self._add({edge}, set())
        for i, (a, b, c) in enumerate(triangles):
            self._add({(a, b), (a, c), (b, c)}, {i})

    def _add(self, column: set[Edge], chain: set[int]) -> None:
        column, chain = self.reduce(column, chain)
        if column:
            self.columns[max(column)] = column, chain

    def reduce(self, column: set[Edge], chain: set[int] | None = None) -> tuple[set[Edge], set[int]]:
        """(normal form, triangles that were added): the form is empty if the edges bound."""
        rest, chain, kept = set(column), set(chain or ()), set()
        while rest:
            low = max(rest)
            if low in self.columns:
                rest ^= self.columns[low][0]
                chain ^= self.columns[low][1]
            else:
                rest.discard(low)
                kept.add(low)
        return kept, chain


def normal_forms(vectors: DataFrame, triangles: DataFrame, keys: Sequence[str] = (), free: DataFrame | None = None) -> DataFrame:
    """keys, path_id, form (edges left), filling (triangles whose boundary is what was taken away) of each edge vector."""
    k = list(keys)
    if not k:
        vectors, triangles = vectors.withColumn("__all", F.lit(0)), triangles.withColumn("__all", F.lit(0))
        k = ["__all"]
    loose = [] if free is None else [(r["a"], r["b"]) for r in free.select("a", "b").collect()]  # edges of two boundary planes

    def solve(key: tuple, v: pd.DataFrame, t: pd.DataFrame) -> pd.DataFrame:
        t = t.sort_values(["a", "b", "c"])
        named = list(zip(t["a"], t["b"], t["c"], strict=True))
        known = Boundaries(named, loose)
        rows = []
        for path_id, edges in zip(v["path_id"], v["edges"], strict=True):
            form, chain = known.reduce({(e["u"], e["v"]) for e in edges})
            rows.append([*key, path_id, [f"{a}-{b}" for a, b in sorted(form)], [list(map(int, named[i])) for i in sorted(chain)]])
        return pd.DataFrame(rows, columns=[*k, "path_id", "form", "filling"])

    kinds = "".join(f"{x} {vectors.schema[x].dataType.simpleString()}, " for x in k)
    kind = vectors.schema["path_id"].dataType.simpleString()
    renamed = triangles.select(*[F.col(x).alias(f"t_{x}") for x in k], "a", "b", "c")
    out = vectors.groupBy(*k).cogroup(renamed.groupBy(*[f"t_{x}" for x in k])).applyInPandas(solve, f"{kinds}path_id {kind}, form array<string>, filling array<array<bigint>>")
    return out.drop("__all")


def classes(forms: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """keys, path_id, cluster (smallest path of the class) and size."""
    w = Window.partitionBy(*keys, "form")
    return forms.select(*keys, "path_id", F.min("path_id").over(w).alias("cluster"), F.count("*").over(w).alias("size"))


def boundary_matrix(vectors: DataFrame) -> DataFrame:
    """path_id, row: the ones of the matrix whose columns are edge vectors; edges are numbered from 0 in their order."""
    from .scan import numbered

    flat = vectors.select("path_id", F.explode("edges").alias("e")).select("path_id", "e.u", "e.v")
    return flat.join(numbered(flat.select("u", "v").distinct(), ["u", "v"], "row"), ["u", "v"]).select("path_id", "row")


def rank(triangles: DataFrame, p: int = 2, keys: Sequence[str] = ()) -> DataFrame:
    """keys, rank over Z/p (p prime) of the boundary matrix of the triangles (a, b, c) of each complex; one complex is one group.

    A triangle's boundary is (b, c) - (a, c) + (a, b).
    """
    k = list(keys)
    rows = triangles if k else triangles.withColumn("complex", F.lit(0))
    names = k or ["complex"]

    def count(key: tuple, t: pd.DataFrame) -> pd.DataFrame:
        columns: dict[Edge, dict[Edge, int]] = {}
        for a, b, c in zip(t["a"], t["b"], t["c"], strict=True):
            column = {(b, c): 1, (a, c): p - 1, (a, b): 1}
            while column:
                low = max(column)
                if low not in columns:
                    inverse = pow(column[low], -1, p)
                    columns[low] = {e: v * inverse % p for e, v in column.items()}
                    break
                times = column[low]
                for e, v in columns[low].items():
                    left = (column.get(e, 0) - times * v) % p
                    if left:
                        column[e] = left
                    else:
                        column.pop(e, None)
        return pd.DataFrame([[*key, len(columns)]], columns=[*names, "rank"])

    kinds = "".join(f"{x} {rows.schema[x].dataType.simpleString()}, " for x in names)
    found = rows.select(*names, "a", "b", "c").groupBy(*names).applyInPandas(count, f"{kinds}rank long")
    return found.select(*k, "rank")


def overlap_summary(paths: DataFrame, slabs: DataFrame, triangles: DataFrame, edges: DataFrame) -> DataFrame:
    """slab, path_id, cluster, size: classes of the parts of the paths in each slab of nodes (slab, gid)."""
    flat = paths.select("path_id", F.posexplode("path").alias("pos", "gid")).join(slabs, "gid")
    parts = flat.groupBy("slab", "path_id").agg(F.array_sort(F.collect_list(F.struct("pos", "gid"))).alias("p"))
    parts = parts.select(F.struct("slab", "path_id").alias("path_id"), F.transform("p", lambda x: x["gid"]).alias("path"))
    vectors = edge_vectors(parts, edges).select("path_id.slab", "path_id.path_id", "edges")
    inside = triangles
    for c in "abc":
        inside = inside.join(slabs.select(F.col("gid").alias(c), F.col("slab").alias(f"s{c}")), c)
    inside = inside.where("sa = sb and sb = sc").select(F.col("sa").alias("slab"), "a", "b", "c")
    return classes(normal_forms(vectors, inside, ["slab"]), ["slab"])


def shorten(paths: DataFrame, ways: DataFrame, triangles: DataFrame) -> DataFrame:
    """path_id, path: the geodesic between a path's ends where both are homologous and it is shorter, else the path.

    ``ways``: source, node, path of geodesics between ends.
    """
    ends = paths.select("path_id", "path", F.get("path", F.lit(0)).alias("source"), F.element_at("path", -1).alias("node"))
    met = ends.join(ways.select("source", "node", F.col("path").alias("way")), ["source", "node"], "left")
    loops = met.where("way is not null").select("path_id", F.concat("path", F.reverse("way")).alias("path"))
    bound = normal_forms(edge_vectors(loops), triangles).where(F.size("form") == 0).select("path_id", F.lit(True).alias("same"))
    shorter = F.col("same") & (F.size("way") < F.size("path"))
    return met.join(bound, "path_id", "left").select("path_id", F.when(F.coalesce(shorter, F.lit(False)), F.col("way")).otherwise(F.col("path")).alias("path"))


def edge_marks(edges: DataFrame, triangles: DataFrame) -> DataFrame:
    """a, b, mark: numbers of edges whose sum (bitwise, odd times) over a loop is zero where the loop bounds triangles.

    The mark hashes the edge's normal form, which is linear, so equal sums mean equal forms but for one chance in 2^64.
    """
    single = edges.select(F.struct("a", "b").alias("path_id"), F.array(F.struct(F.col("a").alias("u"), F.col("b").alias("v"))).alias("edges"))
    forms = normal_forms(single, triangles).select("path_id", F.explode_outer("form").alias("e"))
    hashed = forms.groupBy("path_id").agg(F.bit_xor(F.when(F.col("e").isNotNull(), F.xxhash64("e"))).alias("mark"))
    return hashed.select("path_id.a", "path_id.b", F.coalesce("mark", F.lit(0)).cast("long").alias("mark"))


def shorten_parts(paths: DataFrame, ways: DataFrame, edges: DataFrame, triangles: DataFrame, rounds: int = 100) -> DataFrame:
    """path_id, path: parts of a path give way to the geodesic between their ends where both are homologous and it is shorter.

    ``edges`` (a < b, length) hold every step of the paths and of the ways (source, node, d, path); ``triangles`` (a, b, c) fill loops. Windows
    from every place over 2, 4, 8, ... steps and to the end are rows; prefix sums of lengths and marks tell what a window gains and
    whether its loop bounds. Of windows that overlap the one with the largest gain wins (ties: the first, the longest), and rounds go on
    until no window gains, so a path never grows and keeps its ends and its class.
    """
    kind = paths.schema["path_id"].dataType.simpleString()
    marks = checkpoint(edges.join(edge_marks(edges, triangles), ["a", "b"]))
    both = marks.select(F.col("a").alias("u"), F.col("b").alias("v"), "length", "mark")
    both = checkpoint(both.unionByName(both.select(F.col("v").alias("u"), F.col("u").alias("v"), "length", "mark")))

    def measured(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
        """keys, pos, node, length and mark of the path up to each place."""
        flat = rows.select(*keys, F.posexplode("path").alias("pos", "node"))
        w = Window.partitionBy(*keys).orderBy("pos")
        steps_ = flat.withColumn("u", F.lag("node").over(w)).join(both.withColumnRenamed("v", "node"), ["u", "node"], "left")
        upto = w.rowsBetween(Window.unboundedPreceding, 0)
        return steps_.select(*keys, "pos", "node", F.coalesce(F.sum("length").over(upto), F.lit(0.0)).alias("length"), F.coalesce(F.bit_xor("mark").over(upto), F.lit(0)).alias("mark"))

    ends = measured(ways.select("source", F.col("node").alias("to"), "path"), ["source", "to"])
    known = ends.groupBy("source", "to").agg(F.max_by("mark", "pos").alias("way_mark"))
    known = checkpoint(ways.select("source", F.col("node").alias("to"), "d", F.col("path").alias("way")).join(known, ["source", "to"]))

    def replace(f: pd.DataFrame) -> pd.DataFrame:
        path, taken = list(f["path"].iloc[0]), []
        for r in f.sort_values(["gain", "i", "j"], ascending=[False, True, False]).itertuples():
            if all(r.j <= i or r.i >= j for i, j, _ in taken):
                taken.append((r.i, r.j, list(r.way)))
        for i, j, way in sorted(taken, reverse=True):
            path[i : j + 1] = way
        return pd.DataFrame({"path_id": [f["path_id"].iloc[0]], "path": [path]})

    left, done = checkpoint(paths.select("path_id", F.col("path").cast("array<long>").alias("path"))), None
    for _ in range(rounds):
        at = checkpoint(measured(left, ["path_id"]))
        last = at.groupBy("path_id").agg(F.max("pos").alias("end"))
        spans = F.array(*[F.least(F.col("pos") + 2**k, F.col("end")) for k in range(1, 31)])
        begin = at.join(last, "path_id").select("path_id", F.col("pos").alias("i"), F.col("node").alias("source"), F.col("length").alias("l0"), F.col("mark").alias("m0"), F.explode(F.array_distinct(spans)).alias("j")).where("j > i + 1")
        windows = begin.join(at.select("path_id", F.col("pos").alias("j"), F.col("node").alias("to"), F.col("length").alias("l1"), F.col("mark").alias("m1")), ["path_id", "j"])
        met = windows.join(known, ["source", "to"]).withColumn("gain", F.col("l1") - F.col("l0") - F.col("d"))
        good = checkpoint(met.where((F.col("gain") > 1e-9) & (F.col("m0").bitwiseXOR(F.col("m1")) == F.col("way_mark"))).select("path_id", "i", "j", "gain", "way"))
        moved = checkpoint(good.join(left, "path_id").groupBy("path_id").applyInPandas(replace, f"path_id {kind}, path array<long>"))
        still = left.join(moved.select("path_id"), "path_id", "left_anti")
        done = still if done is None else done.unionByName(still)
        if moved.isEmpty():
            return done.select("path_id", drop_repeats(F.col("path")).alias("path"))
        left = moved
    raise RuntimeError(f"paths still grow shorter after {rounds} rounds")


def smooth(paths: DataFrame, ways: DataFrame) -> DataFrame:
    """path_id, path: each hop replaced by its way (source, node, path) where there is one."""
    hops = paths.select("path_id", F.posexplode(steps_of(F.col("path"))).alias("pos", "h")).select("path_id", "pos", "h.a", "h.b")
    met = hops.join(ways.select(F.col("source").alias("a"), F.col("node").alias("b"), F.col("path").alias("way")), ["a", "b"], "left")
    parts = met.groupBy("path_id").agg(F.array_sort(F.collect_list(F.struct("pos", F.coalesce("way", F.array("a", "b")).alias("way")))).alias("p"))
    joined = parts.select("path_id", drop_repeats(F.flatten(F.transform("p", lambda x: x["way"]))).alias("smoothed"))
    return paths.join(joined, "path_id", "left").select("path_id", F.coalesce("smoothed", "path").alias("path"))


def steps_of(path: Column) -> Column:
    """``ARRAY<STRUCT<a, b>>``: the ends of each hop, in their direction."""
    return F.zip_with(F.slice(path, 1, F.greatest(F.size(path) - 1, F.lit(0))), F.slice(path, 2, F.greatest(F.size(path) - 1, F.lit(0))), lambda a, b: F.struct(a.alias("a"), b.alias("b")))
