"""Queries over a void grid around the embeddings' points in a unit box, and over the Reeb graph of its levels."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.geometry import AXES, wrap
from ..operators import graph as R
from ..operators import grid as G
from ..operators import transport as M
from ..operators.points import rank_pairs
from ..session import checkpoint
from ..sources.tables import POINTS_SQL, embedding_points, table
from .registry import query

N, STRIDE = 16, 2
GRID = G.Grid((N, N, N), (1.0, 1.0, 1.0))
STEP = 1.0 / N


def _balls(spark: SparkSession, sf_dir: str) -> DataFrame:
    pts = embedding_points(spark, sf_dir).withColumns({a: wrap(F.col(a), 1.0) for a in AXES})
    return pts.select(F.col("pid").alias("bid"), *AXES, (0.04 + 0.004 * F.col("label")).alias("radius"))


def _void(spark: SparkSession, sf_dir: str) -> DataFrame:
    return checkpoint(G.void(GRID, _balls(spark, sf_dir)))


VOID_SQL = f"""{POINTS_SQL}, balls AS (SELECT pid AS bid, x - floor(x) AS x, y - floor(y) AS y, z - floor(z) AS z, 0.04 + 0.004 * label AS radius FROM pts),
nodes AS (SELECT CAST(i AS BIGINT) AS gid, CAST((i // {N}) % {N} AS INTEGER) AS ix, CAST(i // {N * N} AS INTEGER) AS iy, CAST(i % {N} AS INTEGER) AS iz FROM range({N**3}) t(i)),
near AS (SELECT gid, bid, radius, sqrt(power(least(abs(ix * {STEP} - x), 1 - abs(ix * {STEP} - x)), 2) + power(least(abs(iy * {STEP} - y), 1 - abs(iy * {STEP} - y)), 2) + power(iz * {STEP} - z, 2)) AS d FROM nodes, balls),
best AS (SELECT gid, arg_min(radius, (d, bid)) AS radius, min(d) AS d FROM near GROUP BY gid),
void AS (SELECT n.* FROM nodes n JOIN best USING (gid) WHERE d > radius)"""
PAIRS_SQL = f"""pairs AS (SELECT DISTINCT a.gid, b.gid AS nid FROM void a, (SELECT unnest(range(-1, 2)) AS i) p, (SELECT unnest(range(-1, 2)) AS j) q, (SELECT unnest(range(-1, 2)) AS k) r, void b
  WHERE b.ix = (a.ix + i + {N}) % {N} AND b.iy = (a.iy + j + {N}) % {N} AND b.iz = a.iz + k AND a.gid <> b.gid)"""


def _levels_sql(stride: int) -> str:
    return f"""planes AS (SELECT iz, row_number() OVER (ORDER BY iz) - 1 AS plane FROM (SELECT DISTINCT iz FROM void)),
chosen AS (SELECT iz AS cz, row_number() OVER (ORDER BY plane) - 1 AS level FROM planes WHERE plane % {stride} = 0 OR plane >= ((SELECT max(plane) FROM planes) // {stride}) * {stride}),
levels AS (SELECT gid, ix, iy, v.iz, CAST(level AS INTEGER) AS level FROM void v JOIN chosen ON v.iz BETWEEN cz - 1 AND cz + 1)"""


LEVELS_SQL = _levels_sql(STRIDE)


@query(f"WITH {VOID_SQL} SELECT gid, ix, iy, iz FROM void")
def grid_void(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.void(GRID, _balls(spark, sf_dir)).select("gid", "ix", "iy", "iz")


@query(f"WITH {VOID_SQL} SELECT gid, ix, iy, iz FROM nodes WHERE gid NOT IN (SELECT gid FROM void)")
def grid_covered(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.covered(GRID, _balls(spark, sf_dir)).select("gid", "ix", "iy", "iz")


@query(f"WITH {VOID_SQL} SELECT gid, ix, iy, iz FROM nodes WHERE gid NOT IN (SELECT gid FROM near WHERE d < radius) OR iz IN (0, {N - 1})")
def grid_void_any_ball(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.void(GRID, _balls(spark, sf_dir), any_ball=True, open_ends=True).select("gid", "ix", "iy", "iz")


@query(f"WITH {VOID_SQL}, {PAIRS_SQL} SELECT gid, nid FROM pairs")
def grid_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.neighbours(GRID, _void(spark, sf_dir))


@query(f"""WITH {VOID_SQL}, {PAIRS_SQL}, f AS (SELECT gid, (7 * ix * ix + 3 * iy + 5 * iz * iy) % 101 AS f FROM void)
SELECT p.gid, max(abs(b.f - a.f)) AS variation FROM pairs p JOIN f a ON a.gid = p.gid JOIN f b ON b.gid = p.nid GROUP BY p.gid""")
def grid_variation(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = _void(spark, sf_dir)
    return G.largest_variation(G.neighbours(GRID, v), v.select("gid", ((7 * F.col("ix") * F.col("ix") + 3 * F.col("iy") + 5 * F.col("iz") * F.col("iy")) % 101).alias("f")))


@query(f"WITH {VOID_SQL}, {LEVELS_SQL} SELECT level, gid FROM levels")
def level_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.level_sets(_void(spark, sf_dir), STRIDE).select("level", "gid")


def _members(spark: SparkSession, sf_dir: str, stride: int = STRIDE) -> DataFrame:
    return checkpoint(G.labelled(GRID, G.level_sets(_void(spark, sf_dir), stride)))


def _members_sql(stride: int) -> str:
    return f"""WITH RECURSIVE {VOID_SQL}, {PAIRS_SQL}, {_levels_sql(stride)},
steps AS MATERIALIZED (SELECT a.level, a.gid, b.gid AS nid FROM levels a JOIN pairs p ON p.gid = a.gid JOIN levels b ON b.gid = p.nid AND b.level = a.level),
label(level, gid, node) USING KEY (level, gid) AS (
  SELECT level, gid, gid FROM levels
  UNION
  SELECT s.level, s.nid, min(l.node) FROM label l JOIN steps s ON s.level = l.level AND s.gid = l.gid
    JOIN recurring.label o ON o.level = s.level AND o.gid = s.nid WHERE l.node < o.node GROUP BY s.level, s.nid),
members AS (SELECT l.level, l.gid, l.node, v.ix, v.iy, v.iz FROM label l JOIN void v USING (gid))"""


MEMBERS_SQL = _members_sql(STRIDE)
NORM, FINE = G.norm_of(STRIDE), G.norm_of(1)  # 1 and 2: at stride 1 neighbouring levels share planes


@query(f"{MEMBERS_SQL} SELECT level, gid, node FROM members")
def level_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _members(spark, sf_dir).select("level", "gid", "node")


def _nodes_sql(norm: int) -> str:
    return f"""SELECT level, node, CAST(greatest(round_even(count(*) / {norm}, 0), 1) AS BIGINT) AS measure, round(avg(ix) * {STEP}, 6) AS px, round(avg(iy) * {STEP}, 6) AS py, round(avg(iz) * {STEP}, 6) AS pz
FROM members GROUP BY level, node"""


def _rounded(nodes: DataFrame) -> DataFrame:
    return nodes.select("level", "node", "measure", *[F.round(c, 6).alias(c) for c in ("px", "py", "pz")])


@query(f"{MEMBERS_SQL} {_nodes_sql(NORM)}")
def reeb_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(G.reeb_nodes(_members(spark, sf_dir), NORM, GRID))


@query(f"{_members_sql(1)} {_nodes_sql(FINE)}")
def reeb_nodes_fine(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every plane is a level, so sizes are divided by 2."""
    return _rounded(G.reeb_nodes(_members(spark, sf_dir, 1), FINE, GRID))


@query(f"{MEMBERS_SQL}, n AS (SELECT DISTINCT level, node FROM members) SELECT level, node, CAST(row_number() OVER (ORDER BY level, node) - 1 AS BIGINT) AS number FROM n")
def reeb_node_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.node_numbers(_members(spark, sf_dir)).select("level", "node", F.col("number").cast("long").alias("number"))


@query(f"""{MEMBERS_SQL}, c AS (SELECT level, node, count(*) AS size FROM members GROUP BY ALL)
SELECT level, arg_min(node, (-size, node)) AS component, max(size) AS size FROM c GROUP BY level""")
def largest_component(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The largest component of each level of the void."""
    return R.largest_component(_members(spark, sf_dir).select("level", "gid", F.col("node").alias("component")), ["level"])


@query(f"{MEMBERS_SQL}, own AS (SELECT gid, arg_min(bid, (d, bid)) AS bid FROM near WHERE d <= 0.2 GROUP BY gid) SELECT DISTINCT level, node, bid FROM members JOIN own USING (gid)")
def reeb_surroundings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The balls around each component of a level."""
    return G.surroundings(_members(spark, sf_dir), _balls(spark, sf_dir), GRID, 0.2)


@query(f"WITH {VOID_SQL}, {PAIRS_SQL} SELECT p.gid, nid FROM pairs p JOIN void a ON a.gid = p.gid JOIN void b ON b.gid = nid WHERE a.iz = 3 AND b.iz = 3")
def plane_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The edges of one plane of the void."""
    return G.plane_edges(G.neighbours(GRID, _void(spark, sf_dir)), GRID, 3)


@query(f"""WITH {VOID_SQL}, hop AS (SELECT e.label AS path_id, v.gid, b.bid, sqrt(power(least(abs(v.ix * {STEP} - b.x), 1 - abs(v.ix * {STEP} - b.x)), 2) + power(least(abs(v.iy * {STEP} - b.y), 1 - abs(v.iy * {STEP} - b.y)), 2) + power(v.iz * {STEP} - b.z, 2)) AS d
  FROM balls b JOIN pts e ON e.pid = b.bid, void v),
own AS (SELECT path_id, bid, arg_min(gid, (d, gid)) AS gid FROM hop WHERE d <= 0.2 GROUP BY path_id, bid) SELECT DISTINCT path_id, gid FROM own""")
def visited_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The void nodes that each label's points are projected onto."""
    pts = embedding_points(spark, sf_dir).select(F.col("label").alias("path_id"), F.col("pid").alias("pos"), "x", "y", wrap(F.col("z"), 1.0).alias("z"))
    v = _void(spark, sf_dir).withColumns({a: F.col(f"i{a}") * STEP for a in AXES})
    return M.visited(M.project(pts, v, GRID, 0.2))


def _edges_sql(norm: int) -> str:
    return f"""edges AS (SELECT a.level, a.node AS src, b.node AS dst, CAST(greatest(count(*) // {norm}, 1) AS BIGINT) AS capacity
  FROM members a JOIN members b ON a.gid = b.gid AND b.level = a.level + 1 GROUP BY ALL)"""


EDGES_SQL = _edges_sql(NORM)


def _edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return checkpoint(G.reeb_edges(_members(spark, sf_dir), NORM))


@query(f"{MEMBERS_SQL}, {EDGES_SQL} SELECT * FROM edges")
def reeb_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _edges(spark, sf_dir)


@query(f"{_members_sql(1)}, {_edges_sql(FINE)} SELECT * FROM edges")
def reeb_edges_fine(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.reeb_edges(_members(spark, sf_dir, 1), FINE)


def _layered(edges: DataFrame) -> DataFrame:
    """Reeb nodes as one number for each (level, component)."""
    return edges.select("level", (F.col("level") * N**3 + F.col("src")).alias("src"), ((F.col("level") + 1) * N**3 + F.col("dst")).alias("dst"), "capacity")


def _ends(e: DataFrame) -> tuple[DataFrame, DataFrame]:
    low, high = e.agg(F.min("level"), F.max("level")).first()
    return e.where(F.col("level") == low).select(F.col("src").alias("node")).distinct(), e.where(F.col("level") == high).select(F.col("dst").alias("node")).distinct()


LAYERED_SQL = f"{EDGES_SQL}, e AS (SELECT level, level * {N**3} + src AS src, (level + 1) * {N**3} + dst AS dst, capacity FROM edges)"


@query(f"""{MEMBERS_SQL}, {LAYERED_SQL}, d AS (SELECT src AS node, capacity AS v FROM e UNION ALL SELECT dst, -capacity FROM e) SELECT node, CAST(sum(v) AS BIGINT) AS divergence FROM d GROUP BY node""")
def bottleneck(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.bottlenecks(_layered(_edges(spark, sf_dir)))


@query(f"""{MEMBERS_SQL}, {LAYERED_SQL}, up(node) AS (SELECT DISTINCT src FROM e WHERE level = 0 UNION SELECT e.dst FROM up JOIN e ON e.src = up.node),
down(node) AS (SELECT DISTINCT dst FROM e WHERE level = (SELECT max(level) FROM e) UNION SELECT e.src FROM down JOIN e ON e.dst = down.node)
SELECT level, src, dst, capacity FROM e WHERE src IN (SELECT node FROM up INTERSECT SELECT node FROM down) AND dst IN (SELECT node FROM up INTERSECT SELECT node FROM down)""")
def reachability(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _layered(_edges(spark, sf_dir))
    return R.through(e, *_ends(e)).select("level", "src", "dst", "capacity")


@query()
def max_flow(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = checkpoint(_layered(_edges(spark, sf_dir)))
    bottom, top = _ends(e)
    total = e.agg(F.sum("capacity")).first()[0] or 0
    wires = e.select("src", "dst", "capacity").union(bottom.select(F.lit(-1), "node", F.lit(total))).union(top.select("node", F.lit(-2), F.lit(total)))
    return R.max_flow(wires.select(F.lit(0).alias("dir"), F.lit(-1).cast("long").alias("source"), F.lit(-2).cast("long").alias("sink"), "src", "dst", "capacity"), ["dir"])


def _flow_of(edges: DataFrame, direction: int) -> DataFrame:
    """dir, flow of one direction's Reeb graph; bottom and top pair by rank, and unequal ends raise."""
    e = checkpoint(_layered(edges))
    wraps = rank_pairs(*_ends(e), "node").select(F.lit(direction).alias("w_dir"), "bottom", "top")
    return R.circular_flow(e.withColumn("dir", F.lit(direction)).select("dir", "src", "dst", "capacity"), wraps.withColumnRenamed("w_dir", "dir"), ["dir"])


@query()
def circular_flow(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flow along the three axes, in nodes and as an area. The outer planes are open, so each way has one bottom and one top."""
    balls, out = _balls(spark, sf_dir), None
    for direction in range(3):
        members = G.labelled(GRID, G.level_sets(checkpoint(G.void(GRID, balls, open_ends=True)), STRIDE))
        flow = _flow_of(G.reeb_edges(checkpoint(members), NORM), direction)
        out = flow if out is None else out.unionByName(flow)
        balls = balls.withColumns({"x": F.col("z"), "y": F.col("x"), "z": F.col("y")})
    return checkpoint(out).select("dir", "flow", (F.col("flow") * STEP * STEP).alias("area"))


@query()
def tunnels(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _layered(_edges(spark, sf_dir)).withColumn("dir", F.lit(0))
    return R.tunnel_sections(R.tunnels(e, ["dir"], 5), STEP * STEP, 0.05)


@query("""WITH x AS (SELECT o_orderkey AS node, row_number() OVER (ORDER BY o_orderkey) AS rank FROM orders),
y AS (SELECT o_custkey * 1000000000 + o_orderkey AS node, row_number() OVER (ORDER BY o_custkey, o_orderkey) AS rank FROM orders)
SELECT CAST(rank AS BIGINT) AS rank, x.node AS bottom, CAST(y.node AS BIGINT) AS top FROM x JOIN y USING (rank)""")
def pair_bottom_top(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders by their key (bottom) and by customer (top): two orders of as many nodes."""
    orders = table(spark, sf_dir, "orders")
    bottom = orders.select(F.col("o_orderkey").cast("long").alias("node"))
    top = orders.select((F.col("o_custkey").cast("long") * 1_000_000_000 + F.col("o_orderkey")).alias("node"))
    return rank_pairs(bottom, top, "node")


@query(f"""WITH {VOID_SQL}, way AS (SELECT * FROM (VALUES (1, 0, 0, 0, 1, 0), (1, 0, 0, 0, 0, 1), (0, 1, 0, 0, 0, 1)) t(d0, d1, d2, e0, e1, e2)),
corners AS (SELECT n.gid * 3 + row_number() OVER (PARTITION BY n.gid ORDER BY w.d0, w.d1, w.e0, w.e1) AS sq, n.ix, n.iy, n.iz, w.* FROM nodes n, way w),
met AS (SELECT sq, (ix + i * d0 + j * e0) % {N} AS x, (iy + i * d1 + j * e1) % {N} AS y, iz + i * d2 + j * e2 AS z FROM corners, (SELECT unnest([0, 1]) AS i), (SELECT unnest([0, 1]) AS j)),
there AS (SELECT sq, v.gid FROM met e JOIN void v ON v.ix = e.x AND v.iy = e.y AND v.iz = e.z)
SELECT DISTINCT p.gid AS a, q.gid AS b, r.gid AS c FROM there p JOIN there q ON q.sq = p.sq AND p.gid < q.gid JOIN there r ON r.sq = q.sq AND q.gid < r.gid""")
def grid_triangles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.triangles(GRID, _void(spark, sf_dir))
