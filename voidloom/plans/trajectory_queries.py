"""Queries over the events as one-dimensional periodic trajectories: user = atom, rank = frame, value = coordinate."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import trajectory as T
from ..sources.tables import BOX, FRAMES_SQL, event_frames, table
from .registry import query

AXIS, BOX1 = ("x",), (BOX,)
UNWRAP_SQL = f"""{FRAMES_SQL}, crossed AS (SELECT *, coalesce(floor((x - lag(x) OVER w + 50.0) / 100.0), 0) AS c FROM frames WINDOW w AS (PARTITION BY atom ORDER BY frame)),
unwrapped AS (SELECT atom, frame, x - 100.0 * sum(c) OVER (PARTITION BY atom ORDER BY frame ROWS UNBOUNDED PRECEDING) AS x FROM crossed)"""


def _unwrapped(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.unwrap(event_frames(spark, sf_dir), BOX1, AXIS)


@query(f"WITH {UNWRAP_SQL} SELECT atom, CAST(frame AS INTEGER) AS frame, round(x, 6) AS x FROM unwrapped")
def unwrap_traj(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _unwrapped(spark, sf_dir).select("atom", "frame", F.round("x", 6).alias("x"))


@query(f"WITH {UNWRAP_SQL}, m AS (SELECT atom, avg(x) AS x FROM unwrapped GROUP BY atom) SELECT atom, round(x - 100.0 * floor(x / 100.0), 6) AS x FROM m")
def mean_position(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.mean_positions(_unwrapped(spark, sf_dir), BOX1, AXIS).select("atom", F.round("x", 6).alias("x"))


@query(f"WITH {FRAMES_SQL} SELECT atom, CAST(frame AS INTEGER) AS frame, round(x, 6) AS x FROM frames WHERE frame >= 5 AND frame < 60 AND (frame - 5) % 10 = 0")
def frame_stride(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.every_nth(event_frames(spark, sf_dir), 10, 5, 60).select("atom", "frame", F.round("x", 6).alias("x"))


@query("SELECT user_id, event_id FROM events WHERE user_id IN (SELECT user_id FROM events GROUP BY user_id HAVING bool_and(value >= 0 AND value <= 300))")
def inside_atoms(spark: SparkSession, sf_dir: str) -> DataFrame:
    frames = table(spark, sf_dir, "events").select(F.col("user_id").alias("atom"), "event_id", F.col("value").alias("x"))
    return T.always_inside(frames, (300.0,), AXIS).select(F.col("atom").alias("user_id"), "event_id")


@query(f"""WITH {FRAMES_SQL}, k AS (SELECT * FROM frames WHERE frame % 5 = 0)
SELECT a.atom, round(max(least(abs(a.x - b.x), 100.0 - abs(a.x - b.x))) / 100.0, 6) AS travelled FROM k a JOIN k b ON a.atom = b.atom AND a.frame <= b.frame GROUP BY a.atom""")
def range_travelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.range_travelled(event_frames(spark, sf_dir), BOX1, 5, AXIS).select("atom", F.round("travelled", 6).alias("travelled"))


@query(f"""WITH {UNWRAP_SQL}, m AS (SELECT atom, avg(x) - 100.0 * floor(avg(x) / 100.0) AS m FROM unwrapped GROUP BY atom)
SELECT atom, round(avg(CASE WHEN abs(x - m) <= 50.0 THEN power(least(abs(x - m), 100.0 - abs(x - m)), 2) END), 6) AS spread FROM frames JOIN m USING (atom) GROUP BY atom""")
def position_spread(spark: SparkSession, sf_dir: str) -> DataFrame:
    means = T.mean_positions(_unwrapped(spark, sf_dir), BOX1, AXIS)
    return T.spread(event_frames(spark, sf_dir), means, BOX1, AXIS).select("atom", F.round("spread", 6).alias("spread"))


@query(f"""WITH {FRAMES_SQL}, m AS (SELECT atom, avg(x) AS m FROM frames GROUP BY atom), g AS (SELECT atom, 's' || atom % 3 AS species, abs(x - m) AS d, max(abs(x - m)) OVER (PARTITION BY atom) AS most FROM frames JOIN m USING (atom)),
v AS (SELECT species, var_pop(d) AS v FROM g WHERE most < 55 GROUP BY species)
SELECT atom, 's' || atom % 3 AS species, round(m, 6) AS x, round(10.0 * (1 + atom % 3) - v + 0.5, 6) AS radius FROM m LEFT JOIN v ON species = 's' || atom % 3""")
def forbidden_balls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Users as atoms of three species: mean positions, and radii less the variance around them."""
    frames = event_frames(spark, sf_dir).withColumn("species", F.concat(F.lit("s"), (F.col("atom") % 3).cast("string")))
    found = T.forbidden_balls(frames, 55.0, {"s0": 10.0, "s1": 20.0, "s2": 30.0}, -1.0, 0.5, AXIS)
    return found.select("atom", "species", F.round("x", 6).alias("x"), F.round("radius", 6).alias("radius"))


@query(f"""WITH {FRAMES_SQL}, ions AS (SELECT * FROM frames WHERE atom % 10 = 0), bb AS (SELECT * FROM frames WHERE atom % 10 <> 0),
m AS (SELECT atom, avg(x) AS m FROM bb GROUP BY atom),
p AS (SELECT i.atom, i.frame, i.x, least(abs(i.x - b.x), 100.0 - abs(i.x - b.x)) AS d, (b.x - m + 50.0) - 100.0 * floor((b.x - m + 50.0) / 100.0) - 50.0 AS u
  FROM ions i JOIN bb b USING (frame) JOIN m ON m.atom = b.atom),
w AS (SELECT *, exp(min(d * d) OVER (PARTITION BY atom, frame, x) - d * d) AS w FROM p),
s AS (SELECT atom, frame, x, x - sum(w * u) / sum(w) AS y FROM w GROUP BY atom, frame, x)
SELECT atom, CAST(frame AS INTEGER) AS frame, round(y - 100.0 * floor(y / 100.0), 6) AS x FROM s""")
def ion_shift(spark: SparkSession, sf_dir: str) -> DataFrame:
    frames = event_frames(spark, sf_dir)
    backbone = frames.where("atom % 10 <> 0")
    means = backbone.groupBy("atom").agg(F.avg("x").alias("x"))
    return T.ion_shift(frames.where("atom % 10 = 0"), backbone, means, BOX1, AXIS).select("atom", "frame", F.round("x", 6).alias("x"))


@query()
def frechet_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.frechet_means(event_frames(spark, sf_dir), BOX1, AXIS)


@query("""SELECT l_returnflag, round(avg(l_quantity * (1 + l_discount) * (1 + l_tax)), 6) AS volume FROM lineitem GROUP BY l_returnflag""")
def mean_volume(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem")
    boxes = lines.select("l_returnflag", F.col("l_quantity").alias("lx"), (1 + F.col("l_discount")).alias("ly"), (1 + F.col("l_tax")).alias("lz"))
    return T.mean_volume(boxes, ["l_returnflag"]).select("l_returnflag", F.round("volume", 6).alias("volume"))
