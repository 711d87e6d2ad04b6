"""Running sums over a whole table in a given order, without a task that sees all of it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.shared import stored


def sum_before(df: DataFrame, order: list[Column], value: str, out: str) -> DataFrame:
    """The sum of ``value`` over all rows that stand before each row (0 for the first). Ties in ``order`` have an order of
    their own, so the last column should be unique.

    Rows are dealt to ranges of the order and stored, as ranges are sampled anew whenever they are computed. Each range
    is summed along its own rows; what the ranges before it add is one number a range, and the only rows that are
    broadcast.
    """
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = stored(df.repartitionByRange(parts, *order).withColumn("_range", F.spark_partition_id()))
    along = Window.partitionBy("_range").orderBy(*order)
    own = F.coalesce(F.sum(value).over(along.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    sums = dealt.groupBy("_range").agg(F.sum(value).alias("_sum"))
    before = sums.select("_range", F.coalesce(F.sum("_sum").over(Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    return dealt.withColumn(out, own).join(F.broadcast(before), "_range").withColumn(out, (F.col(out) + F.col("_before")).cast("long")).drop("_range", "_before")
