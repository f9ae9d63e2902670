"""Results as files: diagrams, flows, structures and graphs."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def write_diagrams(diagrams: DataFrame, path: str) -> None:
    """CSV by sample, kind and dimension; infinite deaths are written ``inf`` (read them with ``positiveInf="inf"``)."""
    death = F.when(F.col("death") == float("inf"), "inf").otherwise(F.col("death").cast("string"))
    diagrams.withColumn("death", death).write.mode("overwrite").partitionBy("sample", "kind", "dim").csv(path, header=True)


def write_diagram_files(diagrams: DataFrame, folder: str, stem: str, dims: tuple[int, ...] = (0, 1, 2)) -> list[str]:
    """A CSV file for each sample and dimension, named ``<stem>_sample_<s>_PD_<d>.csv``, with an unnamed column that numbers its rows; other kinds
    than ``full`` stand before ``PD``. A diagram without points has its names alone, and a file ``APF`` with the point (0, 0) beside it.

    Rows are numbered by birth simplex, which is the order of (dimension, value). One Spark job writes all files to the folder's
    file system; the driver only renames them, and holds no rows. Returns the names.
    """
    spark = diagrams.sparkSession
    kinds = [(r["sample"], r["kind"]) for r in diagrams.select("sample", "kind").distinct().orderBy("sample", "kind").collect()]  # names of files
    w = Window.partitionBy("sample", "kind", "dim").orderBy("birth_simplex", "death_simplex")
    death = F.when(F.col("death") == float("inf"), "inf").otherwise(F.col("death").cast("string"))
    line = F.concat_ws(",", (F.row_number().over(w) - 1).cast("string"), F.col("birth").cast("string"), death, F.col("birth_simplex").cast("string"), F.col("death_simplex").cast("string"))
    asked = spark.createDataFrame([(s, k, d) for s, k in kinds for d in dims], "sample int, kind string, dim int")
    body = diagrams.select("sample", "kind", "dim", F.row_number().over(w).alias("n"), line.alias("value"))
    rows = body.join(F.broadcast(asked), ["sample", "kind", "dim"], "left_semi")
    heads = asked.select("*", F.lit(0).alias("n"), F.lit(",birth,death,birth simplex,death simplex").alias("value"))
    empty = asked.join(rows.select("sample", "kind", "dim").distinct(), ["sample", "kind", "dim"], "left_anti")
    zero = empty.select("sample", "kind", "dim", F.explode(F.array(F.struct(F.lit(0).alias("n"), F.lit(",mean age,lifetime").alias("value")), F.struct(F.lit(1).alias("n"), F.lit("0,0,0").alias("value")))).alias("r")).select("sample", "kind", "dim", "r.n", "r.value")
    every = heads.unionByName(rows).withColumn("what", F.lit("PD")).unionByName(zero.withColumn("what", F.lit("APF")))
    part = F.when(F.col("kind") == "full", F.lit("")).otherwise(F.concat("kind", F.lit("_")))
    named = every.withColumn("name", F.concat(F.lit(f"{stem}_sample_"), F.col("sample").cast("string"), F.lit("_"), part, "what", F.lit("_"), F.col("dim").cast("string")))
    temporary = f"{folder}/_parts-{uuid.uuid4().hex}"
    named.repartition("name").sortWithinPartitions("name", "n").select("name", "value").write.partitionBy("name").text(temporary)
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    files = path(temporary).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    out = []
    for made in files.listStatus(path(temporary)):
        if made.isDirectory():
            name = made.getPath().getName().removeprefix("name=")
            (one,) = [f.getPath() for f in files.listStatus(made.getPath()) if f.getPath().getName().startswith("part-")]
            files.delete(path(f"{folder}/{name}.csv"), False)
            files.rename(one, path(f"{folder}/{name}.csv"))
            out.append(f"{name}.csv")
    files.delete(path(temporary), True)
    return sorted(out)


def read_diagrams(spark, path: str) -> DataFrame:
    schema = "birth double, death double, birth_simplex long, death_simplex long, sample int, kind string, dim int"
    return spark.read.schema(schema).csv(path, header=True, positiveInf="inf")


def write_flow(result: DataFrame, path: str) -> None:
    """One row: Flow, Slice Area, Normalized Flow."""
    result.select(F.col("flow").alias("Flow"), F.col("slice_area").alias("Slice Area"), F.col("norm_flow").alias("Normalized Flow")).coalesce(1).write.mode("overwrite").csv(path, header=True)


def write_structure(atoms: DataFrame, box: tuple[float, float, float], path: str) -> None:
    """An extended XYZ file of one frame (species, x, y, z), as a folder with one text part in order of ``bid``."""
    n = atoms.count()
    lattice = f"{box[0]} 0 0 0 {box[1]} 0 0 0 {box[2]}"
    head = atoms.sparkSession.createDataFrame([(-2, str(n)), (-1, f'Lattice="{lattice}" Properties=species:S:1:pos:R:3 pbc="T T T"')], "bid long, value string")
    rows = atoms.select(F.col("bid").cast("long").alias("bid"), F.format_string("%s %.8f %.8f %.8f", "species", "x", "y", "z").alias("value"))
    head.union(rows).coalesce(1).sortWithinPartitions("bid").select("value").write.mode("overwrite").text(path)


def write_graph(nodes: DataFrame, edges: DataFrame, members: DataFrame, path: str) -> None:
    """Nodes, edges and members of a Reeb graph as Parquet."""
    for name, df in (("nodes", nodes), ("edges", edges), ("members", members)):
        df.write.mode("overwrite").parquet(f"{path}/{name}")


def write_table(rows: DataFrame, path: str) -> None:
    """Any table as CSV with names."""
    rows.write.mode("overwrite").csv(path, header=True)
