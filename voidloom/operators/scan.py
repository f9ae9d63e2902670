"""Running totals and dense numbers over any number of rows: range shuffle, totals of partitions, then local windows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import checkpoint


def running_total(df: DataFrame, keys: Sequence[str], order: Sequence[str], value: Column, out: str, largest: bool = False) -> DataFrame:
    """Sum (or ``largest``) of ``value`` up to each row within its keys, in a total order; no group has to fit into one task.

    Rows are dealt by ranges of (keys, order) once and kept as a table with their range's number: a plan that dealt them
    again would draw other bounds. What a range adds to the next ones reaches a window of its own, a row for each range
    and key. Only a key that goes on from an earlier range has something to carry, and a range has one such key at most
    (its first), so the broadcast side has fewer rows than there are ranges.
    """
    n = max(1, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    dealt = df.withColumn("__v", value).repartitionByRange(n, *keys, *order).withColumn("__p", F.spark_partition_id())
    local = Window.partitionBy("__p", *keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    of = F.max if largest else F.sum
    held = checkpoint(dealt.withColumn("__run", of("__v").over(local)))
    totals = held.groupBy("__p", *keys).agg(of("__v").alias("__sum"))
    before = Window.partitionBy(*keys).orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)
    carried = totals.withColumn("__before", of("__sum").over(before)).where("__before is not null")
    carried = carried.select(F.col("__p").alias("__q"), *[F.col(k).alias(f"__{k}") for k in keys], "__before")
    on = F.col("__p") == F.col("__q")
    for k in keys:
        on = on & F.col(k).eqNullSafe(F.col(f"__{k}"))
    summed = held.join(F.broadcast(carried), on, "left")
    total = F.when(F.col("__before").isNull(), F.col("__run")).otherwise(F.greatest("__run", "__before") if largest else F.coalesce("__run", F.lit(0)) + F.col("__before"))
    return summed.select(*[F.col(c) for c in df.columns if c != out], total.alias(out))


def numbered(df: DataFrame, order: Sequence[str], out: str, keys: Sequence[str] = ()) -> DataFrame:
    """Consecutive numbers from 0 in a total order (within keys)."""
    return running_total(df, keys, order, F.lit(1), out).withColumn(out, F.col(out) - 1)
