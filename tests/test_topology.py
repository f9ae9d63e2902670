"""Triangulation, persistence and the diagrams of inclusions, against brute force and identities."""

from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import functions as F

from voidloom.operators import cobordism as C
from voidloom.operators import diagrams as D
from voidloom.operators import points as P
from voidloom.operators import merge_tree as M
from voidloom.operators import topology as T
from voidloom.operators import z2


def cloud(n, seed, weights=True):
    rng = np.random.default_rng(seed)
    return rng.random((n, 3)), (rng.random(n) * 0.05 if weights else np.zeros(n))


@pytest.mark.parametrize("seed", range(5))
def test_cells_are_those_with_empty_orthospheres(seed):
    p, w = cloud(12, seed)
    brute = set()
    for c in combinations(range(12), 4):
        centre, power = T.orthocentres(p[list(c)][None], w[list(c)][None])
        others = [i for i in range(12) if i not in c]
        if (((p[others] - centre[0]) ** 2).sum(axis=1) - w[others] >= power[0]).all():
            brute.add(c)
    assert {tuple(map(int, c)) for c in T.regular_cells(p, w)} == brute


def test_lattice_points_are_triangulated():
    p = np.array([[x, y, z] for x in range(4) for y in range(4) for z in range(4)], float)
    s = T.alpha_simplices(p, np.zeros(64))
    assert sum((-1) ** d * len(v) for d, v, _ in s) == 1
    assert len(s[0][1]) == 64


def test_few_or_flat_points_have_no_cells():
    assert not len(T.regular_cells(np.zeros((3, 3)), np.zeros(3)))
    flat = np.c_[np.random.default_rng(1).random((8, 2)), np.zeros(8)]
    assert not len(T.regular_cells(flat, np.zeros(8)))


def frame(spark, p, w, sample=0):
    return spark.createDataFrame([(sample, i, *map(float, x), float(y)) for i, (x, y) in enumerate(zip(p, w, strict=True))], "sample int, pid int, x double, y double, z double, w double")


def test_diagrams_of_samples(spark):
    a, b = cloud(40, 1), cloud(25, 2)
    points = frame(spark, *a, 0).union(frame(spark, *b, 1))
    simplices = T.alpha_complex(points).cache()
    euler = {r["sample"]: r["e"] for r in simplices.groupBy("sample").agg(F.sum(F.when(F.col("dim") % 2 == 0, 1).otherwise(-1)).alias("e")).collect()}
    assert euler == {0: 1, 1: 1}
    found = T.persistence(simplices).cache()
    h0 = found.where("dim = 0")
    assert h0.where("death = double('inf')").count() == 2
    pairs = P.pairs_within(points, points, 3.0, keys=["sample"]).where("a_pid < b_pid")
    value = P.touching_value(F.col("d"), F.col("a_w"), F.col("b_w"))
    merged = M.h0_by_merging(points.select("sample", F.col("pid").cast("long"), "w"), pairs.select(F.col("a_sample").alias("sample"), F.col("a_pid").cast("long"), F.col("b_pid").cast("long"), value.alias("value")))
    mine = sorted((r["sample"], round(r["birth"], 9), round(r["death"], 9)) for r in h0.collect())
    assert sorted((r["sample"], round(r["birth"], 9), round(r["death"], 9)) for r in merged.collect()) == mine
    cycles = T.representative_cycles(found, simplices)
    for r in cycles.collect():
        degree = np.bincount([v for e in r["edges"] for v in e])
        assert (degree % 2 == 0).all() and r["lifetime"] > 0
    assert T.neighbour_edges(cycles, simplices).count() >= cycles.count()
    on = {(r["sample"], r["cycle_id"]): set(r["verts"]) for r in cycles.collect()}
    for r in T.neighbour_cells(cycles, simplices).collect():
        near = on[r["sample"], r["cycle_id"]]
        assert near <= set(r["points"]) and all(near & set(e) for e in r["edges"]) and {v for e in r["edges"] for v in e} == set(r["points"])


def rank_z2(columns):
    return sum(1 for c in T.reduce_columns(columns)[0] if c)


def test_kernel_image_cokernel_ranks(spark):
    p, w = cloud(9, 5)
    sub = np.arange(9) % 2 == 0
    points = frame(spark, p, w).withColumn("sub", F.col("pid") % 2 == 0)
    simplices = T.alpha_complex(points)
    bars = T.kernel_image_cokernel(T.in_subcomplex(simplices, points)).toPandas()
    rows = sorted(simplices.collect(), key=lambda r: (r["value"], r["dim"], r["sid"]))
    verts = [tuple(sorted(r["verts"])) for r in rows]
    values = [r["value"] for r in rows]
    for at in range(4, len(rows), 9):
        t = values[at]
        upto = [i for i in range(len(rows)) if values[i] <= t]

        def betti(keep, dim):
            low = [verts[i] for i in keep if len(verts[i]) == dim]
            mid = [verts[i] for i in keep if len(verts[i]) == dim + 1]
            high = [verts[i] for i in keep if len(verts[i]) == dim + 2]
            at_low, at_mid = {v: i for i, v in enumerate(low)}, {v: i for i, v in enumerate(mid)}
            b1 = [{at_low[f] for f in combinations(v, dim)} for v in mid] if dim else [set() for _ in mid]
            b2 = [{at_mid[f] for f in combinations(v, dim + 1)} for v in high]
            return len(mid) - rank_z2(b1) - rank_z2(b2)

        inner = [i for i in upto if all(sub[v] for v in verts[i])]
        for dim in (0, 1):
            alive = {k: int(((bars.kind == k) & (bars.dim == dim) & (bars.birth <= t) & (bars.death > t)).sum()) for k in ("kernel", "image", "cokernel", "codomain")}
            assert alive["codomain"] == betti(upto, dim)
            assert alive["image"] + alive["kernel"] == betti(inner, dim)
            assert alive["image"] + alive["cokernel"] == betti(upto, dim)


def test_apf_and_display(spark):
    dgm = spark.createDataFrame([("a", 0.0, 1.0), ("a", 0.0, 3.0), ("a", 0.0, 3.0), ("b", 1.0, float("inf"))], "k string, birth double, death double")
    curve = [(r["k"], r["mean_age"], r["lifetime"]) for r in D.apf(dgm, ["k"]).orderBy("k", "lifetime").collect()]
    assert curve == [("a", 0.5, 1.0), ("a", 1.5, 4.0), ("a", 1.5, 7.0), ("b", float("inf"), float("inf"))]
    assert D.apf(dgm.where("false"), ["k"]).count() == 0
    shown = {(r["k"], r["tag"], r["shown"]) for r in D.display(dgm, ["k"]).collect()}
    assert ("a", "fin", 3.0) in shown and ("b", "inf", None) in shown


def test_cobordism_of_samples_side_by_side(spark):
    clouds = [cloud(30, 11), cloud(24, 12)]
    points = frame(spark, *clouds[0], 0).union(frame(spark, *clouds[1], 1))

    def flagged(pts):
        s = T.alpha_complex(pts)
        top = pts.select("sample", "pid", (F.col("z") > 0.6).alias("sub"))
        low = pts.select("sample", "pid", (F.col("z") < 0.4).alias("sub"))
        return T.in_subcomplex(T.in_subcomplex(s, top).withColumnRenamed("in_sub", "in_a"), low).withColumnRenamed("in_sub", "in_b")

    both = sorted((r["sample"], r["birth_id"], r["death_id"], r["birth"], r["death"]) for r in C.cobordism(flagged(points)).collect())
    alone = []
    for k in (0, 1):
        alone += [(r["sample"], r["birth_id"], r["death_id"], r["birth"], r["death"]) for r in C.cobordism(flagged(points.where(F.col("sample") == k))).collect()]
    assert both == sorted(alone) and both


def test_renamed_simplices_and_shared_ids(spark):
    s = spark.createDataFrame([(0, [3, 1]), (1, [2]), (2, [1, 9])], "sid long, verts array<long>")
    names = spark.createDataFrame([(1, 7), (2, 0), (3, 4)], "pid long, name long")
    assert {(r["sid"], tuple(r["verts"])) for r in T.renamed(s, names).collect()} == {(0, (4, 7)), (1, (0,))}
    assert [r["sid"] for r in T.shared_ids(s.where("sid < 2"), s.where("sid > 0"), "sid").collect()] == [1]


def test_merges_do_not_depend_on_the_size_of_a_range(spark):
    rng = np.random.default_rng(4)
    rows = [(s, int(a), int(b), float(v)) for s in (0, 3) for a, b, v in zip(rng.integers(0, 60, 400), rng.integers(0, 60, 400), rng.integers(0, 50, 400), strict=True)]
    edges = spark.createDataFrame(rows, "sample int, a long, b long, value double")
    plain = {}
    for s in (0, 3):
        root = {}

        def find(x, root=root):
            while root.get(x, x) != x:
                x = root[x]
            return x

        for _, a, b, v in sorted((r for r in rows if r[0] == s), key=lambda r: (r[3], r[1], r[2])):
            old, young = sorted((find(a), find(b)))
            if old != young:
                root[young] = old
                plain[s, young] = v
    for chunk in (7, 60, 1 << 15):
        assert {(r["sample"], r["age"]): r["value"] for r in M.merges(edges, chunk).collect()} == plain


def test_h0_of_a_long_chain(spark):
    """Gaps that shrink along a chain of 100,000 points: each link ends the point on its far side, in many tasks."""
    n = 100_000
    points = spark.range(n).select(F.lit(0).alias("sample"), F.col("id").alias("pid"), F.lit(0.0).alias("w"))
    pairs = spark.range(n - 1).select(F.lit(0).alias("sample"), F.col("id").alias("a_pid"), (F.col("id") + 1).alias("b_pid"), (F.lit(float(n)) - F.col("id")).alias("value"))
    found = M.h0_by_merging(points, pairs, chunk=1 << 14)
    assert found.where("death = double('inf')").select("pid").collect()[0][0] == 0
    assert found.where(F.col("death") == F.lit(float(n)) - (F.col("pid") - 1)).count() == n - 1


def test_h0_widens_its_reach_until_one_class_is_left(spark):
    rng = np.random.default_rng(1)
    rows = [(s, i, *map(float, rng.normal(0, 1, 3) + (40.0 * s if i == 0 else 0)), 0.1 * (i % 3)) for s in range(3) for i in range(20)]
    points = spark.createDataFrame(rows, "sample int, pid long, x double, y double, z double, w double")
    near, far = (sorted(map(str, M.h0_of_points(points, r).collect())) for r in (0.3, 1000.0))
    assert near == far and sum("inf" in x for x in near) == 3


def test_chunked_persistence_is_the_kernels(spark):
    points = frame(spark, *cloud(40, 21), 0).union(frame(spark, *cloud(25, 22), 2))
    simplices = T.alpha_complex(points).cache()

    def rows(df):
        return sorted((r["sample"], r["dim"], r["birth_simplex"], r["death_simplex"], r["birth"], r["death"]) for r in df.collect())

    plain = rows(T.persistence(simplices))
    assert len({r[1] for r in plain}) == 3
    for chunk in (50, 1 << 13):
        found = z2.persistence(simplices, chunk=chunk).cache()
        assert rows(found) == plain
        for r in T.representative_cycles(found, simplices).collect():
            assert (np.bincount([v for e in r["edges"] for v in e]) % 2 == 0).all()


def test_products_and_dense_columns(spark):
    rng = np.random.default_rng(0)
    left, right = rng.integers(0, 2, (6, 5)), rng.integers(0, 2, (5, 7))

    def rows(m):
        return spark.createDataFrame([(int(c), int(r)) for r, c in zip(*np.nonzero(m), strict=True)], "col long, row long")

    found = z2.product(rows(left), rows(right))
    want = left @ right % 2
    assert {(r["row"], r["col"]) for r in found.collect()} == {(int(r), int(c)) for r, c in zip(*np.nonzero(want), strict=True)}
    assert {r["col"]: r["cells"] for r in z2.dense(found, 6).collect()} == {c: want[:, c].tolist() for c in range(7) if want[:, c].any()}


def plain_phi(rows, a, b):
    """Columns [(simplex, rows)] of phi from plain reductions; rows: (sid, dim, verts, value); a and b: vertices."""
    rows = sorted(rows, key=lambda r: (r[3], r[1], r[0]))
    verts = [tuple(sorted(r[2])) for r in rows]
    kept = []
    for part in (a, b):
        inside = [set(v) <= part for v in verts]
        order = sorted(range(len(verts)), key=lambda j: (not inside[j], j))
        rank = [order.index(j) for j in range(len(verts))]
        r, v, _ = T.reduce_columns(T.boundaries(verts), rank, with_v=True)
        state = [None if not c else inside[max(c, key=rank.__getitem__)] for c in r]
        kept.append((state, [sorted(rows[i][0] for i in c) for c in v]))
    out = []
    for sid, j in sorted((r[0], j) for j, r in enumerate(rows)):
        (sa, va), (sb, vb) = kept
        if sa[j] is False or sb[j] is False:
            continue
        columns = [va[j]] if sb[j] is None else [va[j], vb[j]] if verts[j][0] in a else [vb[j], va[j]]
        out += [(sid, c) for c in columns]
    return out


def test_phi_and_cobordism_against_plain_reductions(spark):
    p, w = cloud(26, 31)
    points = frame(spark, p, w)
    simplices = T.alpha_complex(points).cache()
    a, b = {int(i) for i in np.flatnonzero(p[:, 2] > 0.6)}, {int(i) for i in np.flatnonzero(p[:, 2] < 0.4)}
    for name, part in (("in_a", a), ("in_b", b)):
        sub = points.select("sample", "pid", F.col("pid").isin(list(part)).alias("sub"))
        flagged = T.in_subcomplex(simplices if name == "in_a" else flagged, sub).withColumnRenamed("in_sub", name)
    flagged = flagged.cache()
    plain = plain_phi([(r["sid"], r["dim"], r["verts"], r["value"]) for r in simplices.collect()], a, b)
    of = lambda flag: C.image_decomposition(flagged.withColumn("in_sub", F.col(flag)))
    got = {}
    for r in C.phi_columns(flagged, of("in_a"), of("in_b")).collect():
        got.setdefault((r["simplex"], r["ord"]), []).append(r["row"])
    twice, want = {}, {}
    for sid, rows in plain:
        want[sid, twice.get(sid, 0)] = rows
        twice[sid] = twice.get(sid, 0) + 1
    assert {k: sorted(v) for k, v in got.items()} == want and 2 in twice.values()
    reduced, _, _ = T.reduce_columns([set(c) for _, c in plain])
    lows = {}
    for (sid, _), col in zip(plain, reduced, strict=True):
        lows.setdefault(sid, []).append(max(col) if col else None)
    kernel = {f: {r["birth_simplex"] for r in T.kernel_image_cokernel(flagged.withColumn("in_sub", F.expr(f))).where("kind = 'kernel' and dim <= 1").collect()} for f in ("in_a", "in_b", "in_a or in_b")}
    new = kernel["in_a or in_b"] - kernel["in_a"] - kernel["in_b"]
    ends = {x[1]: sid for sid, x in lows.items() if len(x) == 2 and x[1] in new}
    want = {(i, ends.get(i, D.ESSENTIAL)) for i in new}
    for chunk in (16, 1 << 13):
        assert {(r["birth_id"], r["death_id"]) for r in C.cobordism(flagged, chunk=chunk).collect()} == want and want


@pytest.mark.parametrize("cap", [-0.01, 0.002, 0.02])
def test_tiles_give_the_complex_up_to_a_value(spark, cap):
    from voidloom.operators.tiles import alpha_complex_up_to

    rng = np.random.default_rng(8)
    sparse = np.vstack([rng.random((3, 3)) + 5, [[9.0, 9, 9]], rng.random((2, 3)) * 0.02 - 3])  # tiles with few points
    points = frame(spark, *cloud(300, 41), 0).union(frame(spark, np.vstack([cloud(60, 42)[0], sparse]), np.full(66, 0.01), 1))

    def rows(df):
        return sorted((r["sample"], r["sid"], r["dim"], tuple(r["verts"]), round(r["value"], 9)) for r in df.collect())

    whole = rows(T.alpha_complex(points).where(F.col("value") <= cap))
    found = rows(alpha_complex_up_to(points, cap))
    assert {(r[0], *r[2:]) for r in found} == {(r[0], *r[2:]) for r in whole}
    assert len(found) == len(whole) and {r[1] for r in found if r[0] == 0} == set(range(sum(r[0] == 0 for r in found)))
    assert found and (cap < 0.01 or {r[2] for r in found} == {0, 1, 2, 3})


def test_chunked_reduction_has_the_plain_lows(spark):
    rng = np.random.default_rng(12)
    rows = [(k, c, int(r)) for k in (0, 1) for c in range(60) for r in rng.choice(12 if k else 40, 3, replace=False)]
    df = spark.createDataFrame(rows, "k int, col long, row long")
    for k in (0, 1):
        plain, _, _ = T.reduce_columns([{r for q, c, r in rows if q == k and c == col} for col in range(60)])
        want = {col: max(held) for col, held in enumerate(plain) if held}
        for chunk in (7, 1000):
            found = z2.lows(z2.reduce(df, ["k"], chunk), ["k"]).where(F.col("k") == k)
            assert {r["col"]: r["low"] for r in found.collect()} == want


@pytest.mark.parametrize("cap", [None, 0.004])
def test_tiles_settle_points_in_rounds(spark, cap):
    """Clusters of unlike density, copies, a lattice and hidden points: tiles of few points give what one group gives."""
    from voidloom.operators.tiles import alpha_complex_by_tiles

    rng = np.random.default_rng(5)
    lattice = np.array([[x, y, z] for x in range(6) for y in range(6) for z in range(6)], float)
    many = np.vstack([rng.normal(0, 0.05, (300, 3)), rng.normal(0, 0.3, (200, 3)), rng.random((40, 3)) * 3])
    points = frame(spark, many, rng.random(540) * 0.002, 0).union(frame(spark, lattice, np.zeros(216), 3)).union(frame(spark, np.repeat(many[:60], 3, axis=0), np.zeros(180), 4))
    points = points.union(frame(spark, np.c_[rng.random((90, 2)), np.zeros(90)], np.zeros(90), 5)).union(frame(spark, rng.random((200, 3)), rng.random(200) * 0.1, 6))

    def rows(df):
        return {(r["sample"], r["dim"], tuple(r["verts"])): r["value"] for r in df.collect()}

    whole, found = rows(alpha_complex_by_tiles(points, cap)), rows(alpha_complex_by_tiles(points, cap, most=60, own=40))
    assert found.keys() == whole.keys() and {k[0] for k in whole} == ({0, 3, 4, 5, 6} if cap is None else {k[0] for k in whole})
    assert all(abs(found[k] - whole[k]) < 1e-9 for k in whole)


def test_cells_of_points_that_go_in_together():
    """6,000 points: every cell's sphere is empty, and the cells fill the hull."""
    p, w = cloud(6000, 3)
    w = w * 0.002
    cells, balls, hull = T.cells_and_spheres(p, w)
    assert len(cells) > 30_000 and len(hull) > 50
    for at in np.random.default_rng(0).choice(len(cells), 300, replace=False):
        assert (((p - balls[at, :3]) ** 2).sum(axis=1) - w >= balls[at, 3] - 1e-6).all()


def test_reduction_takes_few_rounds(spark):
    """Columns whose lows fall through all rows, and many more columns than rows."""
    n = 300
    chain = [(0, c, r) for c in range(n) for r in ({0, n - 1 - c // 2} if c % 2 else {n - 1 - c // 2, max(0, n - 2 - c // 2)})]
    rng = np.random.default_rng(4)
    wide = [(1, c, int(r) + 20 * (c // 400)) for c in range(1200) for r in rng.choice(20, 4, replace=False)]
    df = spark.createDataFrame(sorted(set(chain + wide)), "k int, col long, row long")
    for k, m in ((0, n), (1, 1200)):
        plain, _, _ = T.reduce_columns([{r for q, c, r in chain + wide if q == k and c == col} for col in range(m)])
        found = z2.lows(z2.reduce(df, ["k"], 8, rounds=8), ["k"]).where(F.col("k") == k)
        assert {r["col"]: r["low"] for r in found.collect()} == {col: max(held) for col, held in enumerate(plain) if held}
    held = spark.createDataFrame([r[1:] for r in wide], "col long, row long").groupBy("col").agg(F.collect_list("row").alias("rows"))
    assert z2._independent(held, [], 100).count() <= 300  # the first range of each 400 columns tells that later ones are empty


def test_boundaries_reduced_from_above_are_the_plain_ones():
    """Reduced columns, ends and cycles of births, without a look at the columns of births."""
    p, w = cloud(60, 9)
    rows = sorted((x, dim, tuple(v.tolist())) for dim, verts, values in T.alpha_simplices(p, w) for v, x in zip(verts, values.tolist(), strict=True))
    columns, dim = T.boundaries([r[2] for r in rows]), np.array([r[1] for r in rows])
    plain, _, owner = T.reduce_columns(columns)
    births = set(owner)
    reduced, found, cycles = T.reduce_boundaries([None if j in births and dim[j] else c for j, c in enumerate(columns)], dim)
    assert found == owner and reduced == {j: c for j, c in enumerate(plain) if c}
    for j, cycle in cycles.items():
        total = set()
        for i in cycle:
            total ^= set(columns[i])
        assert not total and max(cycle) == j
    assert set(cycles) == {j for j, c in enumerate(plain) if not c}


def test_h0_of_large_samples_takes_few_pairs(spark, monkeypatch):
    """Samples that count as large meet no pairs by cells, unless they lie in a plane, and have the same ends."""
    rng = np.random.default_rng(11)
    p = np.vstack([rng.normal(0, 0.1, (200, 3)), rng.random((30, 3)) * 2, rng.normal(0, 0.1, (10, 3)).repeat(2, axis=0)])
    points = frame(spark, p, rng.random(250) * 0.02, 0).union(frame(spark, np.c_[rng.random((70, 2)), np.zeros(70)], np.zeros(70), 1))
    rows = lambda df: sorted((r["sample"], r["pid"], round(r["birth"], 9), round(r["death"], 9)) for r in df.collect())
    plain = rows(M.h0_of_points(points, 0.25))
    met, within = [], M.pairs_within
    monkeypatch.setattr(M, "pairs_within", lambda *a, **b: met.append(a[0]) or within(*a, **b))
    assert rows(M.h0_of_points(points, 0.25, most=60)) == plain and len({r[0] for r in plain}) == 2
    assert all({r["sample"] for r in df.select("sample").distinct().collect()} == {1} for df in met)
