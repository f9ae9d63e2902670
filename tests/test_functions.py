"""Functions for SQL, matrices as columns, and searches that leave most pairs out, against plain versions."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from voidloom.functions import linear as L
from voidloom.operators import grid as G
from voidloom.operators import topology as T
from voidloom.operators import trajectory as J
from voidloom.plans import sql_functions


@pytest.fixture
def known(spark):
    sql_functions.register(spark)
    return spark


def test_table_functions_give_what_the_operators_give(known):
    rng = np.random.default_rng(2)
    rows = [(s, i, *map(float, rng.random(3)), float(rng.random() * 0.01)) for s in (0, 4) for i in range(15)]
    points = known.createDataFrame(rows, "sample int, pid int, x double, y double, z double, w double")
    points.createOrReplaceTempView("points")
    found = known.sql("SELECT * FROM alpha_complex(TABLE(points) PARTITION BY sample)")
    assert sorted(map(str, found.collect())) == sorted(map(str, T.alpha_complex(points).collect()))
    T.alpha_complex(points).createOrReplaceTempView("simplices")
    found = known.sql("SELECT sample, dim, birth_simplex, death_simplex FROM persistence(TABLE(simplices) PARTITION BY sample) WHERE dim <= 2")
    plain = T.persistence(known.table("simplices")).select("sample", "dim", "birth_simplex", "death_simplex")
    assert sorted(map(tuple, found.collect())) == sorted(map(tuple, plain.collect()))


def test_components_of_levels_in_sql(known):
    rng = np.random.default_rng(0)
    g = G.Grid((6, 6, 6), (1.0, 1.0, 1.0))
    kept = G.nodes(known, g).where(F.col("gid").isin([int(x) for x in rng.permutation(216)[:90]]))
    levels = G.level_sets(kept, 1).cache()
    levels.withColumns({"nx": F.lit(6), "ny": F.lit(6)}).createOrReplaceTempView("nodes")
    found = known.sql("SELECT * FROM reeb_components(TABLE(nodes) PARTITION BY level)")
    plain = G.labelled(g, levels).select("level", "gid", "node")
    assert sorted(map(tuple, found.collect())) == sorted(map(tuple, plain.collect()))


def test_scalar_functions_run_without_python(known):
    df = known.sql("SELECT wrap(-0.25D, 1D) AS w, min_image_gap(0.1D, 0.9D, 1D) AS g, min_image_dist(0.1D, 0D, 0D, 0.9D, 0D, 0D, 1D) AS d, touching_value(1D, 0D, 0D) AS t")
    assert [round(x, 12) for x in df.first()] == [0.75, 0.2, 0.2, 0.25]
    assert "Python" not in df._jdf.queryExecution().toString()


def test_gram_schmidt_and_rotations(spark):
    rng = np.random.default_rng(7)
    mats = rng.normal(size=(20, 3, 3))
    df = spark.createDataFrame([(i, *(m[:, k].tolist() for k in range(3))) for i, m in enumerate(mats)], "i int, a array<double>, b array<double>, c array<double>")
    made = L.gram_schmidt(df, ["a", "b", "c"])
    assert set(made.columns) == {"i", *"abc", *(f"{p}_{c}" for p in "qr" for c in "abc")}
    for r in made.collect():
        q, t = (np.array([r[f"{p}_{c}"] for c in "abc"]).T for p in "qr")
        assert np.allclose(q @ t, mats[r["i"]]) and np.allclose(q.T @ q, np.eye(3)) and np.allclose(np.tril(t, -1), 0)
    flat = L.gram_schmidt(spark.createDataFrame([([1.0, 0.0], [2.0, 0.0])], "a array<double>, b array<double>"), ["a", "b"]).first()
    assert flat["q_b"] is None
    for r in L.rotations(L.sphere_points(spark.range(20), 3), "point").collect():
        m = np.array(r["rotation"]).T
        assert np.allclose(m.T @ m, np.eye(3)) and np.isclose(np.linalg.det(m), 1) and abs(np.linalg.norm(r["point"]) - 1) < 1e-12
    assert [np.array(r["rotation"]).argmax(axis=1).tolist() for r in L.axis_rotations(spark.range(1)).orderBy("turn").collect()] == [[0, 1, 2], [1, 2, 0], [2, 0, 1]]


def test_farthest_positions_and_how_few_pairs_meet(spark):
    rng = np.random.default_rng(3)
    box = (3.0, 2.0, 4.0)
    rows = []
    for atom, width in enumerate((0.02, 0.3, 1.0, 0.0)):
        pos = (rng.normal(0, 1, (150, 3)) * width + [0.1, 1.0, 3.9]) % box
        rows += [(atom, f, *map(float, p)) for f, p in enumerate(pos)]
    frames = spark.createDataFrame(rows, "atom int, frame int, x double, y double, z double")
    got = {r["atom"]: r["travelled"] for r in J.range_travelled(frames, box, 1).collect()}
    for atom in range(4):
        p = np.array([r[2:] for r in rows if r[0] == atom])
        gap = np.abs(p[:, None] - p)
        gap = np.minimum(gap, np.array(box) - gap)
        assert abs(got[atom] - np.sqrt((gap**2).sum(axis=2)).max() / np.linalg.norm(box)) < 1e-12


def test_ions_far_from_all_atoms_are_shifted_too(spark):
    rng = np.random.default_rng(6)
    box = (40.0, 40.0, 40.0)
    bb = [(a, f, *map(float, (rng.random(3) * 3 + 0.1 * f) % 40)) for a in range(6) for f in range(3)]
    mean = [(a, *(float(np.mean([r[2 + k] for r in bb if r[0] == a])) for k in range(3))) for a in range(6)]
    ions = [(100, f, 1.0 + f, 1.0, 1.0) for f in range(3)] + [(101, f, 20.0, 22.0, 25.0) for f in range(3)]
    kind = "atom int, frame int, x double, y double, z double"
    got = J.ion_shift(spark.createDataFrame(ions, kind), spark.createDataFrame(bb, kind), spark.createDataFrame(mean, "atom int, x double, y double, z double"), box).collect()
    assert len(got) == 6
    for r in got:
        here = np.array(next(i[2:] for i in ions if i[:2] == (r["atom"], r["frame"])))
        p = np.array([b[2:] for b in bb if b[1] == r["frame"]])
        gap = (p - here + 20) % 40 - 20
        square = (gap**2).sum(axis=1)
        w = np.exp(square.min() - square)
        move = (p - np.array([m[1:] for m in mean]) + 20) % 40 - 20
        want = (here - (w[:, None] * move).sum(axis=0) / w.sum()) % 40
        assert np.allclose([r["x"], r["y"], r["z"]], want)


def test_walks_are_the_same_in_tasks_and_in_joins(spark):
    from voidloom.operators import graph as R

    rows = spark.createDataFrame([(i, j, 0.5) for i in range(6) for j in (i + 1, max(0, i - 1))] + [(6, 7, 1.0)], "src long, dst long, p double")
    starts, stop = spark.createDataFrame([(2,), (3,)], "node long"), spark.createDataFrame([(6,), (99,)], "node long")
    a, b = (sorted(map(str, R.random_walks(rows, starts, 12, 5, stop, 40, send_rows=n).collect())) for n in (1 << 20, 0))
    assert a == b and any("ended=True" in x for x in a)


def test_equal_ways_go_by_the_smaller_node(spark):
    from voidloom.operators import graph as R

    edges = spark.createDataFrame([(0, 3, 2.0), (0, 1, 1.0), (1, 2, 0.5), (2, 3, 0.5), (1, 3, 1.0)], "a long, b long, length double")
    ways = R.geodesics(edges, spark.createDataFrame([(0,), (3,)], "node long"))
    paths = {(r["source"], r["node"]): r["path"] for r in R.paths_to(ways, ways.select("source", "node")).collect()}
    assert paths[0, 3] == [0, 3] and paths[3, 0] == [3, 2, 1, 0] and paths[3, 1] == [3, 2, 1] and paths[0, 2] == [0, 1, 2]


def test_parts_of_paths_are_shortened_within_their_class(spark):
    """A strip of triangles around a hole: detours go, the way around the hole stays."""
    from voidloom.operators import graph as R
    from voidloom.operators import homology as H

    rng = np.random.default_rng(9)
    n = 12
    ring = [(i, (i + 1) % n) for i in range(n)] + [(n + i, n + (i + 1) % n) for i in range(n)]
    rungs = [(i, n + i) for i in range(n)] + [(i, n + (i + 1) % n) for i in range(n)]
    pairs = sorted({tuple(sorted(e)) for e in ring + rungs})
    length = {e: 1.0 if max(e) < n else 1.3 for e in pairs}
    edges = spark.createDataFrame([(a, b, length[a, b]) for a, b in pairs], "a long, b long, length double").cache()
    tris = [tuple(sorted(t)) for i in range(n) for t in ((i, n + i, n + (i + 1) % n), (i, (i + 1) % n, n + (i + 1) % n))]
    triangles = spark.createDataFrame(sorted(set(tris)), "a long, b long, c long").cache()
    links = {}
    for a, b in pairs:
        links.setdefault(a, []).append(b)
        links.setdefault(b, []).append(a)
    paths = []
    for p in range(25):
        at, walk = int(rng.integers(0, 2 * n)), []
        for _ in range(int(rng.integers(1, 40))):
            walk.append(at)
            at = int(rng.choice(sorted(links[at])))
        paths.append((p, walk))
    df = spark.createDataFrame(paths, "path_id long, path array<long>")
    nodes = spark.range(2 * n).select(F.col("id").alias("node"))
    found = R.geodesics(edges, nodes)
    ways = R.paths_to(found, found.select("source", "node")).join(found.select("source", "node", "d"), ["source", "node"]).cache()
    got = {r["path_id"]: r["path"] for r in H.shorten_parts(df, ways, edges, triangles).collect()}

    def measure(path):
        return sum(length[tuple(sorted(e))] for e in zip(path, path[1:], strict=False))

    shorter = 0
    for p, walk in paths:
        assert got[p][0] == walk[0] and got[p][-1] == walk[-1] and measure(got[p]) <= measure(walk) + 1e-9
        shorter += measure(got[p]) < measure(walk) - 1e-9
    assert shorter > 10
    loops = spark.createDataFrame([(p, walk + got[p][::-1]) for p, walk in paths], "path_id long, path array<long>")
    assert H.normal_forms(H.edge_vectors(loops), triangles).where(F.size("form") > 0).isEmpty()
    again = {r["path_id"]: r["path"] for r in H.shorten_parts(spark.createDataFrame(list(got.items()), "path_id long, path array<long>"), ways, edges, triangles).collect()}
    assert again == got
    around = spark.createDataFrame([(0, [*range(n), 0])], "path_id long, path array<long>")
    assert H.shorten_parts(around, ways, edges, triangles).first()["path"] == [*range(n), 0]  # a loop around the hole has no shorter way
