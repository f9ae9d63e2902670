import numpy as np
from pyspark.sql import functions as F

from voidloom.operators import grid as G
from voidloom.operators import transport as T


def test_box_and_projection(spark, tmp_path):
    (tmp_path / "cell").write_text("# step a\n0 4.0\n1 4.5\n")
    assert T.cubic_box(spark, str(tmp_path / "cell")) == 4.5
    g = G.Grid((4, 4, 4), (1.0, 1.0, 1.0))
    void = G.nodes(spark, g).where("gid <> 0")
    paths = spark.createDataFrame([(0, 0, 0.26, 0.0, 0.0), (0, 1, 1.24, 0.49, 0.5)], "path_id int, pos int, x double, y double, z double")
    found = {r["pos"]: r for r in T.project(paths, void, g, 0.3).collect()}
    assert found[0]["gid"] == 4 and abs(found[0]["error"] - 0.01) < 1e-12 and found[1]["gid"] == (2 * 4 + 1) * 4 + 2
    assert T.projection_report(T.project(paths, void, g, 0.3)).first()["n"] == 2


def test_segments_fields_and_lengths(spark):
    ends = spark.createDataFrame([(0, 0.9, 0.0, 0.0, 0.1, 0.0, 0.0)], "segment int, ax double, ay double, az double, bx double, by double, bz double")
    xs = [r["x"] for r in T.straight_segments(ends, (1.0, 1.0, 1.0), 5).orderBy("step").collect()]
    assert np.allclose(np.sort(xs), [0.0, 0.05, 0.1, 0.9, 0.95], atol=1e-9) or np.allclose(np.sort(xs), [0.05, 0.1, 0.9, 0.95, 1.0], atol=1e-9)
    pts = spark.createDataFrame([(0, 0.5, 0.5, 0.5)], "pid int, x double, y double, z double")
    centres = spark.createDataFrame([(0, 0.4, 0.5, 0.5), (1, 0.5, 0.7, 0.5)], "bid int, x double, y double, z double")
    r = T.repulsion(pts, centres, 0.25, (None, None, None)).first()
    assert abs(r["rx"] - 1000.0) < 1e-6 and abs(r["ry"] + 125.0) < 1e-6
    ways = spark.createDataFrame([(0, i, i, float(i), 0.0, 0.0) for i in range(4)], "path_id int, pos int, gid int, x double, y double, z double")
    field = spark.range(4).select(F.col("id").alias("gid"), F.lit(2.0).alias("rx"), F.lit(0.0).alias("ry"), F.lit(0.0).alias("rz"))
    got = T.line_integrals(ways, field, (1.0, 0.0, 0.0)).first()
    assert (got["along"], got["push"]) == (3.0, 6.0) and T.arc_length(ways).first()["length"] == 3.0
