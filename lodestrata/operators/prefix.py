"""Running sums over a whole table without a window over all of it: ranges of the order, sums of the ranges, offsets added."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestrata.operators.graph import checkpoint_dir


def running_sum(rows: DataFrame, order: list[str], value: str, name: str) -> DataFrame:
    """Adds ``name``: the sum of ``value`` over all rows that come before a row in ``order``, exclusive of it.

    Rows are range-partitioned by ``order`` once and checkpointed, so that a range keeps its number. Each range is summed up
    (map side first), the sums - one for each range - are summed along, and rows are summed inside their range. ``order`` must tell
    all rows apart; rows that it doesn't are one range.
    """
    checkpoint_dir(rows.sparkSession)
    parted = rows.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()).checkpoint()
    before = lambda w: w.rowsBetween(Window.unboundedPreceding, -1)
    sums = parted.groupBy("_part").agg(F.sum(value).alias("_sum"))
    starts = sums.select("_part", F.coalesce(F.sum("_sum").over(before(Window.orderBy("_part"))), F.lit(0)).alias("_start"))  # a row for each range
    inside = F.coalesce(F.sum(value).over(before(Window.partitionBy("_part").orderBy(*order))), F.lit(0))
    return parted.withColumn("_inside", inside).join(F.broadcast(starts), "_part").withColumn(name, F.col("_start") + F.col("_inside")).drop("_part", "_inside", "_start")


def within_budget(rows: DataFrame, order: list[str], size: str, budget) -> DataFrame:
    """Adds ``kept``: whether all sizes up to and with a row, in ``order``, fit the budget."""
    return running_sum(rows, order, size, "_before").withColumn("kept", F.col("_before") + F.col(size) <= budget).drop("_before")
