"""Places and running sums over a whole table, without a task that sees all of it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut


def running_sum(rows: DataFrame, order: list[str], value: Column, name: str) -> DataFrame:
    """``rows`` with the sum of ``value`` (long) over the rows up to and with each, in the order of the columns.

    The rows are sorted into ranges of about equal size; each range is summed by itself and moved by
    the sums of the ranges before it, of which there are as many as shuffle partitions.
    """
    ranged = cut(rows.withColumn(name, value.cast("long")).repartitionByRange(*order).withColumn("__range", F.spark_partition_id()))
    sums = ranged.groupBy("__range").agg(F.sum(name).alias("__own"))
    before = Window.orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)  # one row a range
    shifts = sums.select("__range", F.coalesce(F.sum("__own").over(before), F.lit(0)).alias("__before"))
    within = Window.partitionBy("__range").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    own = ranged.withColumn(name, F.sum(name).over(within)).join(F.broadcast(shifts), "__range")
    return own.withColumn(name, F.col(name) + F.col("__before")).drop("__range", "__before")
