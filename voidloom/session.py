"""Session settings shared by scripts, tests and the bench."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Folders that this process has made.
_made: set[str] = set()


def session(app: str = "voidloom", cores: int | None = None, **conf: str) -> SparkSession:
    """A local session for tests and benches; on a cluster the submitter's settings win.

    ``getOrCreate`` returns a running session unchanged, so nothing here overrides a cluster's own values.
    """
    n = cores or int(os.environ.get("BENCH_CPUS", os.cpu_count() or 1))
    builder = (
        SparkSession.builder.master(f"local[{n}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(n))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.sql.python.filterPushdown.enabled", "true")
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
    )
    for key, value in conf.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_folder(spark: SparkSession) -> str:
    """A folder of this application in the one that spark.checkpoint.dir names; it is deleted when the application ends.

    Where no folder is set, a temporary one serves local sessions (tests); on a cluster this raises, as executors would
    each write to a disk of their own.
    """
    sc = spark.sparkContext
    folder = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not folder:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
        sc.setCheckpointDir(folder)
    own = f"{folder}/{sc.applicationId}"
    if own not in _made:
        path = sc._jvm.org.apache.hadoop.fs.Path(own)
        files = path.getFileSystem(sc._jsc.hadoopConfiguration())
        files.mkdirs(path)
        files.deleteOnExit(path)
        _made.add(own)
    return own


def checkpoint(df: DataFrame) -> DataFrame:
    """Cut the lineage by a table in the shared folder: a lost executor costs no recomputation of what is before it, and
    later plans start from a plain scan that reads only the columns they need."""
    path = f"{shared_folder(df.sparkSession)}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
