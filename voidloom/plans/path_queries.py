"""Queries over paths: users' events as walks over cells of ten value units, and walks through the void grid."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import paths as P
from ..functions.geometry import AXES
from ..operators import graph as R
from ..operators import grid as G
from ..operators import homology as H
from ..operators import transport as T
from ..session import checkpoint
from ..sources.tables import table
from .grid_queries import GRID, STEP, VOID_SQL, N, _balls, _void
from .registry import query

PATHS_SQL = "paths AS (SELECT user_id AS path_id, list(CAST(floor(value / 10) AS BIGINT) ORDER BY ts, event_id) AS path FROM events GROUP BY user_id)"
STEPS_SQL = f"""{PATHS_SQL}, cells AS (SELECT user_id AS path_id, CAST(floor(value / 10) AS BIGINT) AS c, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS pos FROM events),
hops AS (SELECT path_id, pos, c AS src, lead(c) OVER (PARTITION BY path_id ORDER BY pos) AS dst FROM cells)"""


def _paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select("user_id", F.struct("ts", "event_id", F.floor(F.col("value") / 10).cast("long").alias("c")).alias("s"))
    return e.groupBy(F.col("user_id").alias("path_id")).agg(F.transform(F.array_sort(F.collect_list("s")), lambda s: s["c"]).alias("path"))


def _hops(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    c = F.floor(F.col("value") / 10).cast("long")
    e = table(spark, sf_dir, "events").withColumn("c", c)
    return e.select(F.col("user_id").alias("path_id"), F.col("c").alias("src"), F.lead("c").over(w).alias("dst")).where("dst is not null")


@query(f"WITH {STEPS_SQL}, k AS (SELECT path_id, pos, src, lag(src) OVER (PARTITION BY path_id ORDER BY pos) AS p FROM hops) SELECT path_id, string_agg(src, ',' ORDER BY pos) AS path FROM k WHERE p IS NULL OR p <> src GROUP BY path_id")
def dedup_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _paths(spark, sf_dir).select("path_id", F.array_join(P.drop_repeats(F.col("path")), ",").alias("path"))


@query(f"""WITH {STEPS_SQL} SELECT path_id, least(src, dst) AS u, greatest(src, dst) AS v FROM hops WHERE dst IS NOT NULL AND src <> dst GROUP BY ALL HAVING count(*) % 2 = 1""")
def path_edges_mod2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return H.edge_vectors(_paths(spark, sf_dir)).select("path_id", F.explode("edges").alias("e")).select("path_id", "e.u", "e.v")


@query(f"""WITH {STEPS_SQL}, odd AS (SELECT path_id, least(src, dst) AS u, greatest(src, dst) AS v FROM hops WHERE dst IS NOT NULL AND src <> dst GROUP BY ALL HAVING count(*) % 2 = 1)
SELECT path_id, CAST(dense_rank() OVER (ORDER BY u, v) - 1 AS BIGINT) AS row FROM odd""")
def path_boundary_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return H.boundary_matrix(H.edge_vectors(_paths(spark, sf_dir))).select("path_id", F.col("row").cast("long").alias("row"))


@query(f"WITH {STEPS_SQL} SELECT path_id, CAST(sum(abs(dst - src)) AS BIGINT) AS length FROM hops WHERE dst IS NOT NULL GROUP BY path_id")
def path_length(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _hops(spark, sf_dir).groupBy("path_id").agg(F.sum(F.abs(F.col("dst") - F.col("src"))).alias("length"))


@query(f"""WITH {STEPS_SQL}, n AS (SELECT path_id, max(pos) AS n, coalesce(min(pos) FILTER (pos > 1 AND c > 15 * (1 + 1e-5)), max(pos) + 1) AS far FROM cells GROUP BY path_id)
SELECT path_id, count(*) AS n, CAST(sum(c) AS BIGINT) AS total FROM cells JOIN n USING (path_id) WHERE n < 2 OR pos >= far - 1 GROUP BY path_id""")
def trim_bottom(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = P.trim_below(F.col("path"), F.col("path"), 15.0)
    return _paths(spark, sf_dir).select("path_id", cut.alias("p")).select("path_id", F.size("p").cast("long").alias("n"), F.aggregate("p", F.lit(0).cast("long"), lambda a, x: a + x).alias("total"))


@query(f"""WITH {STEPS_SQL}, n AS (SELECT path_id, max(pos) AS n, coalesce(max(pos) FILTER (c < 30 * (1 - 1e-6) AND pos < m), 0) AS low FROM (SELECT *, max(pos) OVER (PARTITION BY path_id) AS m FROM cells) GROUP BY path_id)
SELECT path_id, count(*) AS n, CAST(sum(c) AS BIGINT) AS total FROM cells JOIN n USING (path_id) WHERE n < 2 OR pos <= greatest(low + 1, 1) GROUP BY path_id""")
def trim_top(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = P.trim_above(F.col("path"), F.col("path"), 30.0)
    return _paths(spark, sf_dir).select("path_id", cut.alias("p")).select("path_id", F.size("p").cast("long").alias("n"), F.aggregate("p", F.lit(0).cast("long"), lambda a, x: a + x).alias("total"))


@query(f"WITH {PATHS_SQL} SELECT path_id, list_aggregate(list_concat(list_reverse(path[1:3]), list_concat(path, list_reverse(path[1:2]))), 'string_agg', ',') AS loop FROM paths")
def close_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = F.col("path")
    return _paths(spark, sf_dir).select("path_id", F.array_join(P.close_loop(F.slice(p, 1, 3), p, F.slice(p, 1, 2)), ",").alias("loop"))


@query(f"WITH {PATHS_SQL} SELECT path_id, list_aggregate(list_resize(path, (SELECT max(len(path)) FROM paths), -1), 'string_agg', ',') AS row FROM paths")
def padded_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    paths = _paths(spark, sf_dir)
    longest = table(spark, sf_dir, "events").groupBy("user_id").count().agg(F.max("count").cast("int").alias("most"))
    return paths.crossJoin(F.broadcast(longest)).select("path_id", F.array_join(P.padded(F.col("path"), F.col("most")), ",").alias("row"))  # one row


@query(f"""WITH {STEPS_SQL}, w AS (SELECT src, dst, sum(exp(-0.5 * abs(dst - src) / 2.0 - (0.1 * (dst - src) + 0.05 * abs(dst - src)) / 4.0)) AS w FROM hops WHERE dst IS NOT NULL GROUP BY src, dst)
SELECT src, dst, round(w / sum(w) OVER (PARTITION BY src), 6) AS p FROM w""")
def markov_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _markov(spark, sf_dir).select("src", "dst", F.round("p", 6).alias("p"))


def _markov(spark: SparkSession, sf_dir: str) -> DataFrame:
    step = F.col("dst") - F.col("src")
    weight = R.transition(F.abs(step), step, F.abs(step), 0.5, 0.1, 0.05, 2.0)
    summed = _hops(spark, sf_dir).groupBy("src", "dst").agg(F.sum(weight).alias("weight"))
    return R.markov_rows(summed, F.col("weight")).select("src", "dst", "p")


@query(f"""WITH {VOID_SQL}, gaps AS (SELECT v.gid, {', '.join(f'v.i{a} * {STEP} - b.{a} - {f"floor(v.i{a} * {STEP} - b.{a} + 0.5)" if a != "z" else "0"} AS g{a}' for a in 'xyz')} FROM void v, balls b),
far AS (SELECT *, sqrt(gx * gx + gy * gy + gz * gz) AS d FROM gaps),
field AS (SELECT gid, {', '.join(f'sum(g{a} / power(d, 4)) AS r{a}' for a in 'xyz')} FROM far WHERE d > 0 AND d <= 0.2 GROUP BY gid),
ways AS (SELECT iz AS path_id, iy * {N} + CASE WHEN iy % 2 = 0 THEN ix ELSE {N - 1} - ix END AS pos, gid, {', '.join(f'i{a} * {STEP} AS {a}' for a in 'xyz')} FROM void),
steps AS (SELECT w.*, f.*, {', '.join(f'lead(w.{a}) OVER (PARTITION BY path_id ORDER BY pos) - w.{a} AS d{a}' for a in 'xyz')} FROM ways w LEFT JOIN field f ON f.gid = w.gid)
SELECT path_id, round(CAST(sum(dx + 0.5 * dy + 0.25 * dz) AS DOUBLE), 6) AS along, round(CAST(sum(dx * coalesce(rx, 0) + dy * coalesce(ry, 0) + dz * coalesce(rz, 0)) AS DOUBLE), 3) AS push FROM steps WHERE dx IS NOT NULL GROUP BY path_id""")
def line_integrals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A way through each plane of the void, row by row there and back, in the repulsion of the balls."""
    v = _void(spark, sf_dir).withColumns({a: F.col(f"i{a}") * STEP for a in AXES})
    field = T.repulsion(v.withColumnRenamed("gid", "pid"), _balls(spark, sf_dir), 0.2, (1.0, 1.0, None)).withColumnRenamed("pid", "gid")
    turn = F.when(F.col("iy") % 2 == 0, F.col("ix")).otherwise(N - 1 - F.col("ix"))
    ways = v.select(F.col("iz").alias("path_id"), (F.col("iy") * N + turn).alias("pos"), "gid", *AXES)
    return T.line_integrals(ways, field, (1.0, 0.5, 0.25)).select("path_id", F.round("along", 6).alias("along"), F.round("push", 3).alias("push"))


#: Ways over all hops from the cells below 5, by rounds of relaxation: a way has at most as many hops as there are cells.
WAYS_SQL = f"""{STEPS_SQL}, g AS (SELECT DISTINCT src AS u, dst AS v FROM hops WHERE dst IS NOT NULL AND src <> dst), e AS (SELECT u, v FROM g UNION SELECT v, u FROM g),
r(source, node, d, n) AS (SELECT DISTINCT c, c, CAST(0 AS BIGINT), 0 FROM cells WHERE c < 5
  UNION ALL (SELECT source, node, min(d) AS d, max(n) + 1 AS n FROM (SELECT source, node, d, n FROM r UNION ALL SELECT r.source, e.v, r.d + abs(e.u - e.v), r.n FROM r JOIN e ON e.u = r.node) WHERE n < 50 GROUP BY source, node)),
ways AS (SELECT source, node, CAST(min(d) AS DOUBLE) AS d FROM r GROUP BY source, node)"""


@query(f"WITH RECURSIVE {WAYS_SQL} SELECT * FROM ways")
def geodesic_distances(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _ways(spark, sf_dir).select("source", "node", "d")


def _cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """a, b, length: the hops between different cells that some user makes."""
    h = _hops(spark, sf_dir).where("src <> dst")
    return checkpoint(h.select(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b")).distinct().withColumn("length", (F.col("b") - F.col("a")).cast("double")))


def _ways(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ways from all cells below 5."""
    sources = table(spark, sf_dir, "events").select(F.floor(F.col("value") / 10).cast("long").alias("node")).where("node < 5").distinct()
    return R.geodesics(_cells(spark, sf_dir), sources)


@query(f"""WITH RECURSIVE {WAYS_SQL}, pred AS (SELECT w.source, w.node, min(e.u) AS p FROM ways w JOIN e ON e.v = w.node JOIN ways x ON x.source = w.source AND x.node = e.u
  WHERE w.node <> w.source AND x.d + abs(e.u - e.v) = w.d AND x.d < w.d GROUP BY ALL),
back(source, node, head, path) AS (SELECT source, node, node, CAST(node AS VARCHAR) FROM ways UNION ALL SELECT b.source, b.node, p.p, p.p || ',' || b.path FROM back b JOIN pred p ON p.source = b.source AND p.node = b.head)
SELECT source, node, path FROM back WHERE head = source""")
def geodesic_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    ways = _ways(spark, sf_dir)
    return R.paths_to(ways, ways.select("source", "node")).select("source", "node", F.array_join("path", ",").alias("path"))


@query()
def random_walks(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = checkpoint(_markov(spark, sf_dir))
    starts = rows.select(F.col("src").alias("node")).distinct().where("node < 5")
    stop = rows.select(F.col("dst").alias("node")).distinct().where("node > 10")
    return R.random_walks(rows, starts, 50, 7, stop)


@query()
def shortened_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Users' paths over cells, each part replaced by its geodesic where triangles of hops of up to six cells fill the loop."""
    edges = _cells(spark, sf_dir)
    near = edges.where("length <= 6").select("a", "b")
    ab, bc, ac = (near.select(F.col("a").alias(p), F.col("b").alias(q)) for p, q in (("a", "b"), ("b", "c"), ("a", "c")))
    triangles = checkpoint(ab.join(bc, "b").join(ac, ["a", "c"]).select("a", "b", "c"))
    ways = checkpoint(R.geodesics(edges, edges.select(F.col("a").alias("node")).union(edges.select("b")).distinct()))
    ways = R.paths_to(ways, ways.select("source", "node")).join(ways.select("source", "node", "d"), ["source", "node"])
    paths = _paths(spark, sf_dir).select("path_id", P.drop_repeats(F.col("path")).alias("path"))
    return H.shorten_parts(paths, ways, edges, triangles)


def _grid_paths(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(void nodes, triangles, straight walks along x) of the void grid, in all its planes."""
    v = _void(spark, sf_dir)
    w = v.groupBy("iy", "iz").agg(F.array_sort(F.collect_list(F.struct("ix", "gid"))).alias("p"))
    walks = w.select((F.col("iy") * N + F.col("iz")).cast("long").alias("path_id"), F.transform("p", lambda x: x["gid"]).alias("path"))
    return v, checkpoint(G.triangles(GRID, v)), checkpoint(walks)


def _plane_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Normal forms of the walks within their plane: each plane of the void is a complex and a group of its own."""
    v, triangles, walks = _grid_paths(spark, sf_dir)
    edges = G.neighbours(GRID, v, "edge").select(F.col("gid").alias("a"), F.col("nid").alias("b"))
    vectors = H.edge_vectors(walks, edges).withColumn("iz", (F.col("path_id") % N).cast("int"))
    flat = triangles.where(f"a % {N} = b % {N} and b % {N} = c % {N}")
    return H.normal_forms(vectors, flat.withColumn("iz", (F.col("a") % N).cast("int")), ["iz"])


@query()
def path_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return H.classes(_plane_forms(spark, sf_dir), ["iz"])


@query()
def loop_fillings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _plane_forms(spark, sf_dir).select("path_id", F.size("form").alias("left"), F.size("filling").alias("triangles"))


@query()
def plane_ranks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rank over Z/3 of the boundary matrix of each plane's triangles."""
    _, triangles, _ = _grid_paths(spark, sf_dir)
    flat = triangles.where(f"a % {N} = b % {N} and b % {N} = c % {N}")
    return H.rank(flat.withColumn("iz", (F.col("a") % N).cast("int")), 3, ["iz"])


@query()
def path_overlaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    v, triangles, walks = _grid_paths(spark, sf_dir)
    edges = G.neighbours(GRID, v, "edge").select(F.col("gid").alias("a"), F.col("nid").alias("b"))
    return H.overlap_summary(walks, v.select("gid", (F.col("ix") / 4).cast("int").alias("slab")), triangles, edges)
