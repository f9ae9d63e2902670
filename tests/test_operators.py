"""Geometry, trajectories, grids, flows and paths on small cases."""

from itertools import product

import numpy as np
import pytest
from pyspark.sql import functions as F

from voidloom.functions import paths as PF
from voidloom.operators import graph as R
from voidloom.operators import grid as G
from voidloom.operators import homology as H
from voidloom.operators import points as P
from voidloom.operators import trajectory as J
from voidloom.operators.scan import numbered, running_total


def test_pairs_within_a_periodic_box_match_brute_force(spark):
    rng = np.random.default_rng(3)
    p = rng.random((60, 3)) * [1.0, 2.0, 1.5]
    df = spark.createDataFrame([(i, *map(float, x)) for i, x in enumerate(p)], "pid int, x double, y double, z double")
    box = (1.0, 2.0, None)
    found = {(r["a_pid"], r["b_pid"]): r["d"] for r in P.pairs_within(df, df, 0.4, box).where("a_pid < b_pid").collect()}
    brute = {}
    for i in range(60):
        for j in range(i + 1, 60):
            d = np.abs(p[i] - p[j])
            d[:2] = np.minimum(d[:2], np.array(box[:2]) - d[:2])
            if np.sqrt((d**2).sum()) <= 0.4:
                brute[i, j] = np.sqrt((d**2).sum())
    assert found.keys() == brute.keys() and all(abs(found[k] - brute[k]) < 1e-12 for k in brute)


def test_weights_and_types(spark):
    df = spark.createDataFrame([(0, "A"), (1, "B"), (2, "C")], "type_id int, species string")
    assert [r["w"] for r in P.weigh(df, [("A", 2.0), ("A", 9.0), ("B", 3.0)]).orderBy("type_id").collect()] == [4.0, 9.0, 0.0]
    assert [r["species"] for r in P.remap_types(df, {0: "Si", 1: "O", 2: "Na"}).orderBy("type_id").collect()] == ["Si", "O", "Na"]
    with pytest.raises(Exception, match="unknown type 2"):
        P.remap_types(df, {0: "Si", 1: "O"}).collect()


def test_unwrap_undoes_wrap_and_stream_agrees(spark, tmp_path):
    from voidloom.streaming.unwrap import unwrap_stream

    rng = np.random.default_rng(0)
    rows = []
    for atom in range(3):
        x = 5 + np.cumsum(rng.normal(0, 1, 40))
        rows += [(atom, f, float(v % 10)) for f, v in enumerate(x)]
    df = spark.createDataFrame(rows, "atom long, frame int, x double")
    plain = {(r["atom"], r["frame"]): r["x"] for r in J.unwrap(df, (10.0,), ("x",)).collect()}
    steps = [abs(plain[a, f + 1] - plain[a, f]) for a in range(3) for f in range(39)]
    assert max(steps) <= 5
    for part in range(2):
        df.where((F.col("frame") >= 20 * part) & (F.col("frame") < 20 * part + 20)).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    q = unwrap_stream(stream, (10.0,), ("x",)).writeStream.format("memory").queryName("unwrapped").outputMode("append").start()
    q.processAllAvailable()
    q.stop()
    got = {(r["atom"], r["frame"]): r["x"] for r in spark.sql("select * from unwrapped").collect()}
    assert got.keys() == plain.keys()


def test_running_total_over_any_group(spark):
    df = spark.range(1000).select((F.col("id") % 2).alias("k"), F.col("id").alias("o"))
    got = {(r["k"], r["o"]): r["s"] for r in running_total(df, ["k"], ["o"], F.col("o"), "s").collect()}
    assert got[0, 998] == sum(range(0, 1000, 2)) and got[1, 999] == sum(range(1, 1000, 2)) and got[1, 1] == 1
    assert sorted(r["n"] for r in numbered(df, ["o"], "n").collect()) == list(range(1000))


def grid_case(spark, seed=0, n=6):
    rng = np.random.default_rng(seed)
    g = G.Grid((n, n, n), (1.0, 1.0, 1.0))
    balls = spark.createDataFrame([(i, *map(float, rng.random(3)), float(r)) for i, r in enumerate(rng.uniform(0.05, 0.3, 12))], "bid int, x double, y double, z double, radius double")
    return g, balls


def test_void_is_what_the_nearest_ball_leaves(spark):
    g, balls = grid_case(spark)
    b = [(r["bid"], np.array([r["x"], r["y"], r["z"]]), r["radius"]) for r in balls.collect()]
    expect = set()
    for ix, iy, iz in product(range(6), repeat=3):
        q = np.array([ix, iy, iz]) / 6
        best = min((np.sqrt((np.where([1, 1, 0], np.minimum(np.abs(q - p), 1 - np.abs(q - p)), np.abs(q - p)) ** 2).sum()), i, r) for i, p, r in b)
        if best[0] > best[2]:
            expect.add((iy * 6 + ix) * 6 + iz)
    assert {r["gid"] for r in G.void(g, balls).collect()} == expect


def test_components_and_empty_graphs(spark):
    edges = spark.createDataFrame([(1, 2), (2, 3), (9, 8), (5, 5)], "a long, b long")
    assert {(r["node"], r["component"]) for r in R.components(edges).collect()} == {(1, 1), (2, 1), (3, 1), (8, 8), (9, 8), (5, 5)}
    assert R.components(edges.where("false")).count() == 0


def brute_circular(edges, wraps):
    best = 0
    ranges = [range(c + 1) for *_, c in edges]
    for flow in product(*ranges):
        net = {}
        for (u, v, _), f in zip(edges, flow, strict=True):
            net[u] = net.get(u, 0) - f
            net[v] = net.get(v, 0) + f
        total, ok = 0, True
        for b, t in wraps:
            w = net.get(t, 0)
            ok &= w >= 0 and net.get(b, 0) == -w
            total += w
        used = {x for w in wraps for x in w}
        ok &= all(v == 0 for k, v in net.items() if k not in used)
        best = max(best, total) if ok else best
    return best


@pytest.mark.parametrize("seed", range(3))
def test_circular_flow_is_the_best(spark, seed):
    rng = np.random.default_rng(seed)
    edges = [(a, b, int(rng.integers(1, 3))) for a in (0, 1) for b in (2, 3)] + [(a, b, int(rng.integers(1, 3))) for a in (2, 3) for b in (4, 5)]
    wraps = [(0, 4), (1, 5)]
    e = spark.createDataFrame([(0, *x) for x in edges], "dir int, src long, dst long, capacity long")
    w = spark.createDataFrame([(0, *x) for x in wraps], "dir int, bottom long, top long")
    assert R.circular_flow(e, w, ["dir"]).first()["flow"] == brute_circular(edges, wraps)


def test_max_flow_and_tunnels(spark):
    e = spark.createDataFrame([(0, 0, 1, 3, 0), (0, 0, 2, 2, 0), (0, 1, 3, 2, 1), (0, 2, 3, 2, 1)], "dir int, src long, dst long, capacity long, level int")
    flow = R.max_flow(e.withColumns({"source": F.lit(0).cast("long"), "sink": F.lit(3).cast("long")}), ["dir"])
    assert flow.where("dst = 3").agg(F.sum("flow")).first()[0] == 4
    dug = R.tunnels(e, ["dir"], 3).orderBy("tunnel").collect()
    assert [(r["narrowest"], r["volume"], r["path"]) for r in dug] == [(2, 5, [0, 1, 3]), (2, 4, [0, 2, 3])]


def test_geodesics_and_paths(spark):
    e = spark.createDataFrame([(0, 1, 1.0), (1, 2, 1.0), (0, 2, 3.0), (4, 5, 1.0)], "a long, b long, length double")
    found = R.geodesics(e, spark.createDataFrame([(0,)], "node long"))
    assert {(r["node"], r["d"]) for r in found.collect()} == {(0, 0.0), (1, 1.0), (2, 2.0)}
    assert {tuple(r["path"]) for r in R.paths_to(found, found.select("source", "node")).collect()} == {(0,), (0, 1), (0, 1, 2)}


def test_paths_around_a_hole_are_told_apart(spark):
    # a square ring of 8 nodes with its hole at 4; triangles fill only the lower left square
    triangles = spark.createDataFrame([(0, 1, 3)], "a long, b long, c long")
    paths = spark.createDataFrame([(0, [0, 1, 2, 5, 8]), (1, [0, 3, 6, 7, 8]), (2, [0, 3, 1, 2, 5, 8]), (3, [])], "path_id int, path array<long>")
    forms = H.normal_forms(H.edge_vectors(paths), triangles)
    got = {r["path_id"]: r["cluster"] for r in H.classes(forms).collect()}
    assert got == {0: 0, 1: 1, 2: 0, 3: 3}
    assert H.rank(triangles).first()["rank"] == 1
    ways = spark.createDataFrame([(0, 8, [0, 1, 2, 5, 8])], "source long, node long, path array<long>")
    short = {r["path_id"]: r["path"] for r in H.shorten(paths.where("size(path) > 0"), ways, triangles).collect()}
    assert short == {0: [0, 1, 2, 5, 8], 1: [0, 3, 6, 7, 8], 2: [0, 1, 2, 5, 8]}


def test_path_columns(spark):
    df = spark.createDataFrame([([1, 1, 2, 2, 1],), ([],), ([3],)], "p array<int>")
    assert [r["q"] for r in df.select(PF.drop_repeats(F.col("p")).alias("q")).collect()] == [[1, 2, 1], [], [3]]
    assert [len(r["q"]) for r in df.select(PF.steps(F.col("p")).alias("q")).collect()] == [2, 0, 0]
    assert df.select(PF.padded(F.col("p"), 3).alias("q")).collect()[2]["q"] == [3, -1, -1]


def test_ion_shift_keeps_ions_far_from_the_backbone(spark):
    rng = np.random.default_rng(5)
    bb, mean = rng.uniform(0, 30, 12), rng.uniform(0, 30, 12)
    ions = [10.0, 37.5, 65.0]  # the last is 35 from any backbone atom
    i = spark.createDataFrame([(k, 0, x) for k, x in enumerate(ions)], "atom int, frame int, x double")
    b = spark.createDataFrame([(k, 0, float(x)) for k, x in enumerate(bb)], "atom int, frame int, x double")
    m = spark.createDataFrame([(k, float(x)) for k, x in enumerate(mean)], "atom int, x double")
    got = {r["atom"]: r["x"] for r in J.ion_shift(i, b, m, (100.0,), ("x",)).collect()}
    for k, x in enumerate(ions):
        d = np.abs(x - bb)
        d = np.minimum(d, 100 - d) ** 2
        w = np.exp(d.min() - d)
        assert abs(got[k] - (x - (w * ((bb - mean + 50) % 100 - 50)).sum() / w.sum()) % 100) < 1e-9


def test_backbone_radii_reach_any_distance(spark):
    from voidloom.plans.pipelines import flow_backbone
    from voidloom.sources.config import Flow

    rows = [(f, a, s, x, 5.0, 5.0) for f in (0, 1) for a, s, x in [(0, "Si", 1.0), (1, "Si", 4.0), (2, "O", 25.0), (3, "Li", 2.0)]]
    frames = spark.createDataFrame(rows, "frame int, atom int, species string, x double, y double, z double")
    told = Flow(backbone_atoms=("Si", "O"), flow_atoms=("Li",), reeb_stride=1, common_backbone=False)
    got = {r["bid"]: r["radius"] for r in flow_backbone(frames, told, (50.0, 50.0, 50.0)).collect()}
    assert got == pytest.approx({0: 1.0, 1: 2.0, 2: 23.0})
    small = {r["bid"]: r["radius"] for r in flow_backbone(frames.withColumn("x", F.col("x") % 8), told, (8.0, 10.0, 10.0)).collect()}
    assert small == pytest.approx({0: 1.0, 1: 2.0, 2: 1.0})
    with pytest.raises(Exception, match="no mobile atom"):
        flow_backbone(frames, Flow(backbone_atoms=("Si", "O"), flow_atoms=("Li",), reeb_stride=1), (50.0, 50.0, 50.0)).collect()


def test_paths_are_padded_to_the_longest(spark, sf_dir):
    from voidloom.plans.path_queries import _paths, padded_paths

    whole = {r["path_id"]: r["path"] for r in _paths(spark, sf_dir).collect()}
    most = max(map(len, whole.values()))
    got = {r["path_id"]: r["row"] for r in padded_paths(spark, sf_dir).collect()}
    assert most > 80 and got == {k: ",".join(map(str, p + [-1] * (most - len(p)))) for k, p in whole.items()}


def test_walks_without_an_end_are_kept(spark):
    rows = spark.createDataFrame([(0, 1, 0.5), (0, 2, 0.5)], "src long, dst long, p double")  # 2 leads nowhere
    starts, stop = spark.range(1).select(F.col("id").alias("node")), spark.range(1, 2).select(F.col("id").alias("node"))
    got = R.random_walks(rows, starts, 40, 3, stop).collect()
    assert len(got) == 40 and all(r["ended"] == (r["path"] == [0, 1]) for r in got) and {r["ended"] for r in got} == {True, False}
    ring = spark.createDataFrame([(0, 0, 1.0)], "src long, dst long, p double")
    assert [(len(r["path"]), r["ended"]) for r in R.random_walks(ring, starts, 1, 3, stop, 20).collect()] == [(20, False)]


def test_totals_of_large_tables_with_other_columns(spark, tmp_path):
    """The rows are dealt once, so what columns a later plan keeps does not move their ranges."""
    n = 2_000_000
    df = spark.range(n).select((F.col("id") % 3).cast("int").alias("k"), F.xxhash64("id").alias("o"), F.col("id").alias("v"), F.rand(1).alias("x"), F.md5(F.col("id").cast("string")).alias("pad"))
    numbered(df, ["o"], "n", ["k"]).select("k", "n").write.parquet(str(tmp_path / "n"))
    got = spark.read.parquet(str(tmp_path / "n")).groupBy("k").agg(F.max("n").alias("m"), F.countDistinct("n").alias("d"), F.min("n").alias("l")).collect()
    assert {(r["k"], r["l"], r["m"] + 1, r["d"]) for r in got} == {(k, 0, c, c) for k, c in ((0, 666_667), (1, 666_667), (2, 666_666))}
    running_total(df, ["k"], ["o"], F.col("v"), "s").write.parquet(str(tmp_path / "s"))
    ends = spark.read.parquet(str(tmp_path / "s")).groupBy("k").agg(F.max(F.struct("o", "s")).alias("e"), F.sum("v").alias("t")).collect()
    assert all(r["e"]["s"] == r["t"] for r in ends) and len(ends) == 3


@pytest.mark.parametrize("chunk", [1 << 20, 7])
def test_components_match_union_find(spark, chunk):
    rng = np.random.default_rng(12)
    edges = [(int(k), int(a), int(b)) for k, a, b in np.column_stack([rng.integers(0, 2, 150), rng.integers(0, 120, 150), rng.integers(0, 120, 150)])]
    edges += [(2, i, i + 1) for i in range(90)] + [(3, 500, i) for i in range(40)]
    root = {(k, x): (k, x) for k, a, b in edges for x in (a, b)}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for k, a, b in edges:
        x, y = sorted((find((k, a)), find((k, b))))
        root[y] = x
    df = spark.createDataFrame(edges, "k int, a long, b long").repartition(5)
    got = {(r["k"], r["node"]): r["component"] for r in R.components(df, ["k"], chunk=chunk).collect()}
    assert got == {x: find(x)[1] for x in root}
    assert {(r["k"], r["component"], r["size"]) for r in R.largest_component(R.components(df, ["k"]), ["k"]).collect() if r["k"] > 1} == {(2, 0, 91), (3, 0, 41)}


def test_image_pairs_and_unequal_ends(spark):
    rng = np.random.default_rng(6)
    p = rng.random((50, 3))
    df = spark.createDataFrame([(i, *map(float, x)) for i, x in enumerate(p)], "pid int, x double, y double, z double")
    found = {(r["a_pid"], r["b_pid"]): r["d"] for r in P.image_pairs(df, (1.0, 1.0, None), 0.3).collect()}
    brute = {(i, j): min(float(np.linalg.norm(p[i] - p[j] - [a, b, 0])) for a in (-1, 0, 1) for b in (-1, 0, 1)) for i in range(50) for j in range(i + 1, 50)}
    assert found == pytest.approx({k: d for k, d in brute.items() if d <= 0.3})
    ends = spark.range(4).select(F.col("id").alias("node"))
    assert [(r["rank"], r["bottom"], r["top"]) for r in P.rank_pairs(ends, ends.select((F.col("node") * 2).alias("node")), "node").orderBy("rank").collect()] == [(i + 1, i, 2 * i) for i in range(4)]
    with pytest.raises(Exception, match="differ in number"):
        P.rank_pairs(ends, ends.where("node > 0"), "node").collect()


def test_ranks_over_primes(spark):
    """Six triangles of a projective plane: its boundary matrix loses a rank over Z/2 only."""
    plane = [(1, 2, 3), (1, 2, 4), (1, 3, 5), (1, 4, 6), (1, 5, 6), (2, 3, 6), (2, 4, 5), (2, 5, 6), (3, 4, 5), (3, 4, 6)]
    t = spark.createDataFrame([(0, *x) for x in plane] + [(1, 1, 2, 3)], "k int, a long, b long, c long")
    assert {(r["k"], r["rank"]) for r in H.rank(t, 2, ["k"]).collect()} == {(0, 9), (1, 1)}
    assert {(r["k"], r["rank"]) for r in H.rank(t, 3, ["k"]).collect()} == {(0, 10), (1, 1)}


def test_smooth_paths_and_boundary_columns(spark):
    paths = spark.createDataFrame([(0, [0, 2, 3]), (1, [5]), (2, [3, 2])], "path_id int, path array<long>")
    ways = spark.createDataFrame([(0, 2, [0, 1, 2])], "source long, node long, path array<long>")
    assert {r["path_id"]: r["path"] for r in H.smooth(paths, ways).collect()} == {0: [0, 1, 2, 3], 1: [5], 2: [3, 2]}
    ones = {(r["path_id"], r["row"]) for r in H.boundary_matrix(H.edge_vectors(paths)).collect()}
    assert ones == {(0, 0), (0, 1), (2, 1)}


def test_circular_means_match_a_search(spark):
    rng = np.random.default_rng(8)
    x = np.r_[rng.normal(99.0, 3.0, 30) % 100, 40.0]
    df = spark.createDataFrame([(0, i, float(v)) for i, v in enumerate(x)], "atom int, frame int, x double")
    got = J.frechet_means(df, (100.0,), ("x",), every=1).first()
    centres = np.linspace(0, 100, 100_001)[:-1]
    cost = (((x[:, None] - centres[None] + 50) % 100 - 50) ** 2).mean(axis=0)
    assert abs(got["x"] - centres[cost.argmin()]) < 2e-3 and abs(got["cost"] - cost.min()) < 1e-4


def test_pairs_and_nearest_centres_keep_no_pairs(spark):
    """Nearest centres by a growing reach, and image pairs whose plan has no aggregate of pairs."""
    rng = np.random.default_rng(2)
    p, c = rng.normal(0, 0.1, (300, 3)), np.vstack([rng.normal(0, 0.1, (80, 3)), [[5.0, 5, 5]]])
    points = spark.createDataFrame([(i, *map(float, x)) for i, x in enumerate(p)], "pid long, x double, y double, z double")
    centres = spark.createDataFrame([(i, *map(float, x)) for i, x in enumerate(c)], "cid long, x double, y double, z double")
    d = np.sqrt(((p[:, None] - c[None]) ** 2).sum(axis=2))
    for cutoff in (0.02, 0.1, 3.0):
        got = {r["pid"]: (r["cid"], round(r["d"], 9)) for r in P.nearest_within(points, centres, cutoff, "pid", "cid").collect()}
        assert got == {i: (int(row.argmin()), round(float(row.min()), 9)) for i, row in enumerate(d) if row.min() <= cutoff}
    assert not P.nearest_within(points, centres.limit(0), 1.0, "pid", "cid").collect()
    pairs = P.image_pairs(points.withColumns({a: F.pmod(a, F.lit(1.0)) for a in "xyz"}), (1.0, 1.0, 1.0), 0.1)
    assert "Aggregate" not in pairs._jdf.queryExecution().optimizedPlan().toString()


def test_ion_shift_meets_places_once(spark, monkeypatch):
    """Copies of atoms and ions at the same places go as one; frames without a backbone have no ions, far ions still move."""
    rng = np.random.default_rng(6)
    spots, ions = rng.random(12).round(1) * 10, [1.0, 5.0, 60.0]
    bb = [(100 + i, 0, float(spots[i % 12])) for i in range(600)]
    mean = [(a, float((x + rng.normal(0, 1)) % 100)) for a, _, x in bb]
    i = spark.createDataFrame([(a, f, ions[a % 3]) for a in range(90) for f in (0, 1)], "atom int, frame int, x double")
    met, plain = [], J.pairs_within
    monkeypatch.setattr(J, "pairs_within", lambda *a: met.append(plain(*a)) or met[-1])
    got = J.ion_shift(i, spark.createDataFrame(bb, "atom int, frame int, x double"), spark.createDataFrame(mean, "atom int, x double"), (100.0,), ("x",)).collect()
    assert sum(m.count() for m in met) <= 2 * len(met) * 3 * 12 and {(r["atom"], r["frame"]) for r in got} == {(a, 0) for a in range(90)}
    for r in got:
        x = ions[r["atom"] % 3]
        d = [min(abs(x - p), 100 - abs(x - p)) for _, _, p in bb]
        w = np.exp(min(d) ** 2 - np.square(d))
        u = [(p - m + 50) % 100 - 50 for (_, _, p), (_, m) in zip(bb, mean, strict=True)]
        assert abs(r["x"] - (x - (w * u).sum() / w.sum()) % 100) < 1e-9
