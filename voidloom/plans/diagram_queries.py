"""Queries over diagrams: the lineitem table as a large one, and those of the embeddings' point clouds."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import cobordism as C
from ..operators import diagrams as D
from ..operators import points as P
from ..operators import topology as T
from ..operators import z2
from ..operators.merge_tree import h0_of_points
from ..operators.scan import numbered
from ..operators.tiles import alpha_complex_up_to
from ..session import checkpoint
from ..sources.tables import DIAGRAM_SQL, POINTS_SQL, RADII, embedding_points, lineitem_diagram, table
from .registry import query

KEYS = ["l_returnflag", "l_linestatus"]
TIES = ["birth", "l_orderkey", "l_linenumber"]
LABELS_SQL = "SELECT vec_id AS pid, label, CAST(embedding[3] AS DOUBLE) AS z FROM embeddings"


def _r(*names: str) -> list:
    return [F.round(n, 6).alias(n) for n in names]


@query(f"""WITH {DIAGRAM_SQL} SELECT l_returnflag, l_linestatus, l_orderkey, l_linenumber, round((birth + death) / 2, 6) AS mean_age,
round(sum(abs(death - birth)) OVER (PARTITION BY l_returnflag, l_linestatus ORDER BY (birth + death) / 2, birth, l_orderkey, l_linenumber ROWS UNBOUNDED PRECEDING), 6) AS lifetime FROM dgm""")
def apf_curve(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.apf(lineitem_diagram(spark, sf_dir), KEYS, TIES).select(*KEYS, "l_orderkey", "l_linenumber", *_r("mean_age", "lifetime"))


@query(f"""WITH {DIAGRAM_SQL} SELECT l_returnflag, l_linestatus, count(*) AS n, round(max((birth + death) / 2), 6) AS mean_age, round(sum(abs(death - birth)), 4) AS lifetime FROM dgm GROUP BY 1, 2""")
def apf_final(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.apf_end(lineitem_diagram(spark, sf_dir), KEYS).select(*KEYS, "n", *_r("mean_age"), F.round("lifetime", 4).alias("lifetime"))


@query(f"""WITH {DIAGRAM_SQL}, c AS (SELECT l_returnflag, l_linestatus, (birth + death) / 2 AS mean_age, sum(abs(death - birth)) AS s FROM dgm GROUP BY ALL),
curve AS (SELECT l_returnflag, l_linestatus, mean_age, sum(s) OVER (PARTITION BY l_returnflag, l_linestatus ORDER BY mean_age) AS lifetime FROM c),
ends AS (SELECT l_returnflag, l_linestatus, (SELECT ceil(1.1 * max(mean_age)) FROM c) AS mean_age, max(lifetime) AS lifetime FROM curve GROUP BY 1, 2)
SELECT l_returnflag, l_linestatus, round(mean_age, 6) AS mean_age, round(lifetime, 4) AS lifetime FROM (SELECT * FROM curve UNION ALL SELECT * FROM ends)""")
def apf_padded(spark: SparkSession, sf_dir: str) -> DataFrame:
    curves = D.apf(lineitem_diagram(spark, sf_dir), KEYS, TIES, dedup=True)
    return D.apf_padded(curves, KEYS).select(*KEYS, *_r("mean_age"), F.round("lifetime", 4).alias("lifetime"))


@query(f"""WITH {DIAGRAM_SQL}, e AS (SELECT * REPLACE (CASE WHEN l_orderkey % 7 = 0 THEN 'inf'::DOUBLE ELSE death END AS death) FROM dgm)
SELECT l_orderkey, l_linenumber, round(CASE WHEN isinf(death) THEN 1.1 * max(death) FILTER (NOT isinf(death)) OVER (PARTITION BY l_returnflag, l_linestatus) ELSE death END, 6) AS shown,
CASE WHEN isinf(death) THEN 'inf' ELSE 'fin' END AS tag FROM e""")
def pd_display(spark: SparkSession, sf_dir: str) -> DataFrame:
    dgm = lineitem_diagram(spark, sf_dir).withColumn("death", F.when(F.col("l_orderkey") % 7 == 0, float("inf")).otherwise(F.col("death")))
    return D.display(dgm, KEYS).select("l_orderkey", "l_linenumber", *_r("shown"), "tag")


@query(f"""WITH {DIAGRAM_SQL} SELECT l_returnflag AS sample, l_linestatus AS kind, CAST(l_linenumber AS INTEGER) AS dim, count(*) AS n, round(sum(death - birth), 4) AS persistence
FROM dgm GROUP BY ROLLUP (l_returnflag, l_linestatus, l_linenumber)""")
def diagram_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    named = lineitem_diagram(spark, sf_dir).select(F.col("l_returnflag").alias("sample"), F.col("l_linestatus").alias("kind"), F.col("l_linenumber").alias("dim"), "birth", "death")
    return D.summary(named).select("sample", "kind", "dim", "n", F.round("persistence", 4).alias("persistence"))


@query("""SELECT o_orderkey AS birth_id FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R') AND o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'A')""")
def new_births(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("birth_id"), "l_returnflag")
    union = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("birth_id"))
    return D.new_births(union, lines.where("l_returnflag = 'R'"), lines.where("l_returnflag = 'A'"))


@query("""SELECT l_orderkey AS birth_id FROM lineitem WHERE l_returnflag = 'R' INTERSECT SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'A'""")
def shared_births(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids that two parts have in common."""
    lines = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("birth_id"), "l_returnflag")
    return T.shared_ids(lines.where("l_returnflag = 'R'"), lines.where("l_returnflag = 'A'"), "birth_id")


@query("""WITH names AS (SELECT s_suppkey AS pid, row_number() OVER (ORDER BY s_acctbal, s_suppkey) - 1 AS name FROM supplier)
SELECT l_orderkey AS sid, list_aggregate(list_sort(list(name)), 'string_agg', ',') AS verts FROM lineitem JOIN names ON pid = l_suppkey GROUP BY l_orderkey""")
def renamed_simplices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as simplices of suppliers, which are renamed by the order of their balance."""
    names = numbered(table(spark, sf_dir, "supplier").select("s_acctbal", F.col("s_suppkey").alias("pid")), ["s_acctbal", "pid"], "name").select("pid", "name")
    simplices = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("sid")).agg(F.collect_list("l_suppkey").alias("verts"))
    return T.renamed(simplices, names).select("sid", F.array_join("verts", ",").alias("verts"))


@query("""WITH n AS (SELECT l_partkey AS simplex, l_suppkey AS low, row_number() OVER (PARTITION BY l_partkey ORDER BY l_orderkey, l_linenumber) AS n FROM lineitem),
p AS (SELECT low AS birth_id, min(simplex) AS death_id FROM n WHERE n = 2 GROUP BY 1)
SELECT s_suppkey AS birth_id, coalesce(death_id, 9223372036854775807) AS death_id FROM supplier LEFT JOIN p ON s_suppkey = birth_id""")
def dup_pairing(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem")
    columns = lines.select(F.col("l_partkey").alias("simplex"), F.struct("l_orderkey", "l_linenumber").alias("ord"), F.col("l_suppkey").alias("low"))
    return D.duplicate_pairs(columns, table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("birth_id")))


@query("""WITH s AS (SELECT o_orderkey AS sid, o_totalprice AS v FROM orders)
SELECT round(b.v, 6) AS birth, round(coalesce(d.v, 'inf'::DOUBLE), 6) AS death, b.sid AS birth_id, l_partkey AS death_id, 2 AS n_vertices
FROM (SELECT DISTINCT l_orderkey, l_partkey FROM lineitem) JOIN s b ON b.sid = l_orderkey LEFT JOIN s d ON d.sid = l_partkey""")
def index_to_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    simplices = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("sid"), F.col("o_totalprice").alias("value"), F.array(F.lit(0), F.lit(1)).alias("verts"))
    pairs = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("birth_id"), F.col("l_partkey").alias("death_id")).distinct()
    return D.to_values(pairs, simplices).select(*_r("birth", "death"), "birth_id", "death_id", "n_vertices")


@query("""WITH v AS (SELECT DISTINCT l_orderkey AS cycle_id, l_suppkey AS pid FROM lineitem)
SELECT cycle_id, 'n' || s_nationkey AS species, count(*) AS n FROM v JOIN supplier ON s_suppkey = pid GROUP BY ALL""")
def cycle_composition(spark: SparkSession, sf_dir: str) -> DataFrame:
    cycles = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("cycle_id")).agg(F.collect_list("l_suppkey").alias("verts"))
    points = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("pid"), F.concat(F.lit("n"), F.col("s_nationkey").cast("string")).alias("species"))
    return D.cycle_composition(cycles, points)


def _samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each label is a sample: its embeddings' points with weights."""
    return P.weigh(embedding_points(spark, sf_dir), RADII).withColumn("sample", F.col("label")).withColumn("pid", F.col("pid").cast("int"))


#: Value at which the balls of a and b touch.
TOUCH_SQL = "CASE WHEN d > 0 AND (d * d + wa - wb) / (2 * d) BETWEEN 0 AND d THEN power((d * d + wa - wb) / (2 * d), 2) - wa ELSE greatest(-wa, -wb) END"
#: Ends by widest ways: in each step ways of twice as many edges, from the least of their largest values. 512 points a label at most.
_WAYS = ", ".join(f"m{i + 1} AS MATERIALIZED (SELECT p.s, p.a, q.b, min(greatest(p.v, q.v)) AS v FROM m{i} p JOIN m{i} q ON q.s = p.s AND q.a = p.b GROUP BY ALL)" for i in range(9))


H0_SQL = f"""{POINTS_SQL}, touch AS (SELECT a.label AS s, a.pid AS a, b.pid AS b, a.w AS wa, b.w AS wb, sqrt(power(a.x - b.x, 2) + power(a.y - b.y, 2) + power(a.z - b.z, 2)) AS d
  FROM pts a JOIN pts b ON a.label = b.label AND a.pid < b.pid),
e AS (SELECT s, a, b, {TOUCH_SQL} AS v FROM touch),
m0 AS MATERIALIZED (SELECT * FROM e UNION ALL SELECT s, b, a, v FROM e UNION ALL SELECT label, pid, pid, -w FROM pts), {_WAYS},
ends AS (SELECT p.label AS s, p.pid, min(v) AS death FROM pts p JOIN m9 ON s = p.label AND a = p.pid JOIN pts o ON o.label = s AND o.pid = b AND (o.w > p.w OR o.w = p.w AND o.pid < p.pid) GROUP BY ALL),
h0 AS (SELECT CAST(p.label AS INTEGER) AS sample, p.pid, -w AS birth, coalesce(death, 'inf'::DOUBLE) AS death
  FROM pts p LEFT JOIN ends e ON e.s = p.label AND e.pid = p.pid WHERE coalesce(death, 'inf'::DOUBLE) > -w)"""


@query(f"WITH {H0_SQL} SELECT sample, pid, round(birth, 6) AS birth, round(death, 6) AS death FROM h0")
def h0_diagram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _h0(spark, sf_dir).select("sample", "pid", *_r("birth", "death"))


def _h0(spark: SparkSession, sf_dir: str) -> DataFrame:
    return h0_of_points(_samples(spark, sf_dir), 0.25)


@query(f"""WITH {H0_SQL} SELECT sample, pid, round((birth + death) / 2, 6) AS mean_age, round(birth, 6) AS birth,
round(sum(death - birth) OVER (PARTITION BY sample ORDER BY (birth + death) / 2, birth, pid ROWS UNBOUNDED PRECEDING), 6) AS lifetime FROM h0""")
def apf_of_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.apf(_h0(spark, sf_dir), ["sample"], ["birth", "pid"]).select("sample", "pid", *_r("mean_age", "birth", "lifetime"))


@query()
def alpha_complex(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.alpha_complex(_samples(spark, sf_dir))


@query()
def alpha_complex_in_tiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Simplices up to a value, by tiles of each sample."""
    return alpha_complex_up_to(_samples(spark, sf_dir), 0.01)


@query()
def persistence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.persistence(T.alpha_complex(_samples(spark, sf_dir)))


@query()
def representative_cycles(spark: SparkSession, sf_dir: str) -> DataFrame:
    simplices = T.alpha_complex(_samples(spark, sf_dir))
    return T.representative_cycles(T.persistence(simplices), simplices)


@query()
def cycle_species(spark: SparkSession, sf_dir: str) -> DataFrame:
    pts = embedding_points(spark, sf_dir)
    cycles = representative_cycles(spark, sf_dir).select(F.struct("sample", "cycle_id").alias("cycle_id"), "verts")
    return D.cycle_composition(cycles, pts).select("cycle_id.sample", "cycle_id.cycle_id", "species", "n")


@query()
def cycle_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    simplices = T.alpha_complex(_samples(spark, sf_dir))
    return T.neighbour_edges(T.representative_cycles(T.persistence(simplices), simplices), simplices)


@query()
def cycle_neighbour_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges that touch a cycle, with their ends."""
    simplices = checkpoint(T.alpha_complex(_samples(spark, sf_dir)))
    return T.neighbour_cells(T.representative_cycles(T.persistence(simplices), simplices), simplices)


@query()
def persistence_in_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Persistence with columns dealt over tasks."""
    return z2.persistence(T.alpha_complex(_samples(spark, sf_dir)))


@query()
def kernel_image_cokernel(spark: SparkSession, sf_dir: str) -> DataFrame:
    pts = P.auto_slab(_samples(spark, sf_dir), 0.25, ["sample"])
    return T.kernel_image_cokernel(T.in_subcomplex(T.alpha_complex(pts), pts))


@query()
def cobordism_diagram(spark: SparkSession, sf_dir: str) -> DataFrame:
    pts = P.auto_slab(_samples(spark, sf_dir), 0.25, ["sample"])
    simplices = checkpoint(T.alpha_complex(pts))
    top = pts.select("sample", "pid", (F.col("z") >= F.col("upper")).alias("sub"))
    bottom = pts.select("sample", "pid", ((F.col("z") < F.col("upper")) & (F.col("z") <= F.col("lower"))).alias("sub"))
    flagged = T.in_subcomplex(simplices, top).withColumnRenamed("in_sub", "in_a")
    return C.cobordism(T.in_subcomplex(flagged, bottom).withColumnRenamed("in_sub", "in_b"))


@query("""SELECT l_orderkey AS col, s_nationkey AS "row" FROM (SELECT DISTINCT l_orderkey, l_suppkey FROM lineitem) JOIN supplier ON s_suppkey = l_suppkey GROUP BY ALL HAVING count(*) % 2 = 1""")
def z2_product(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders by suppliers times suppliers by nations, over Z/2."""
    orders = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("col"), F.col("l_suppkey").alias("row")).distinct()
    return z2.product(table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("col"), F.col("s_nationkey").alias("row")), orders)


@query("""WITH m AS (SELECT l_orderkey AS col, s_nationkey AS r FROM (SELECT DISTINCT l_orderkey, l_suppkey FROM lineitem) JOIN supplier ON s_suppkey = l_suppkey GROUP BY ALL HAVING count(*) % 2 = 1)
SELECT col, array_to_string(list_transform(range(25), lambda i: CASE WHEN list_contains(list(r), i) THEN 1 ELSE 0 END), '') AS cells FROM m GROUP BY col""")
def z2_dense(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same columns as zeros and ones."""
    rows = z2_product(spark, sf_dir).withColumn("row", F.col("row").cast("long"))
    return z2.dense(rows, 25).select("col", F.array_join(F.transform("cells", lambda c: c.cast("string")), "").alias("cells"))


@query()
def reduced_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as columns of their suppliers, reduced: each order's low. A supplier is the low of one order at most."""
    orders = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("col"), F.col("l_suppkey").alias("row")).distinct()
    return z2.lows(z2.reduce(orders, chunk=1 << 13))
