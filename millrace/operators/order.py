"""Places and running sums in one total order, without one task that sorts everything.

Rows are range-partitioned, each range is summed up by its own window, and the few totals of the ranges
before it are added. The ranges are written to the checkpoint folder, so that they can't shift between
the two passes.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..runtime import durable


def running(df: DataFrame, order: list[str], value: Column | None = None, out: str = "before") -> DataFrame:
    """`df` with `out`: the sum of `value` (1 by default) over all rows earlier in the order, which must be total."""
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = durable(df.withColumn("_v", value if value is not None else F.lit(1)).repartitionByRange(parts, *order).withColumn("_range", F.spark_partition_id()))
    totals = ranged.groupBy("_range").agg(F.sum("_v").alias("_t"))
    starts = totals.select("_range", F.coalesce(F.sum("_t").over(Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_start"))
    inner = F.coalesce(F.sum("_v").over(Window.partitionBy("_range").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return ranged.join(F.broadcast(starts), "_range").withColumn(out, F.col("_start") + inner).drop("_v", "_range", "_start")
