"""The driver's tables seen as points, trajectories and diagrams."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Radii by species: species s0 to s9 are the labels of the embeddings.
RADII = [(f"s{i}", 0.05 + 0.01 * i) for i in range(10)]
BOX = 100.0


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def embedding_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """pid, species, x, y, z: the first three components of each embedding."""
    e = table(spark, sf_dir, "embeddings")
    xyz = [F.col("embedding")[i].cast("double").alias(a) for i, a in enumerate("xyz")]
    return e.select(F.col("vec_id").alias("pid"), F.concat(F.lit("s"), F.col("label").cast("string")).alias("species"), "label", *xyz)


#: The same in SQL, as the view ``pts``.
POINTS_SQL = """pts AS (
  SELECT vec_id AS pid, 's' || label AS species, label, CAST(embedding[1] AS DOUBLE) AS x, CAST(embedding[2] AS DOUBLE) AS y,
         CAST(embedding[3] AS DOUBLE) AS z, 0.05::DOUBLE + 0.01::DOUBLE * label AS radius, power(0.05::DOUBLE + 0.01::DOUBLE * label, 2) AS w
  FROM embeddings)"""


def event_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """atom, frame, x: each user's events in order of time, the value wrapped into the box."""
    e = table(spark, sf_dir, "events")
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    x = F.pmod("value", F.lit(BOX))
    return e.select(F.col("user_id").alias("atom"), (F.row_number().over(w) - 1).alias("frame"), x.alias("x"), "event_id")


FRAMES_SQL = """frames AS (
  SELECT user_id AS atom, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS frame,
         value - 100.0 * floor(value / 100.0) AS x, event_id
  FROM events)"""


def lineitem_diagram(spark: SparkSession, sf_dir: str) -> DataFrame:
    """birth, death by (l_returnflag, l_linestatus), with the line's key."""
    q = table(spark, sf_dir, "lineitem")
    birth = F.col("l_discount")
    return q.select("l_returnflag", "l_linestatus", "l_orderkey", "l_linenumber", birth.alias("birth"), (birth + F.col("l_quantity") / 10).alias("death"))


DIAGRAM_SQL = """dgm AS (
  SELECT l_returnflag, l_linestatus, l_orderkey, l_linenumber, l_discount AS birth, l_discount + l_quantity / 10 AS death FROM lineitem)"""
