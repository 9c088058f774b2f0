"""Places and running totals in a global order without a one-task window.

Rows are dealt by a bucket column that follows the order (a prefix of the key, or an interval of it). The buckets' sizes
are a small table, whose running total gives each bucket's start; within a bucket a window does the rest.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Intervals of an integer key.
BUCKETS = 4096


def intervals(key: str, low: int, high: int, buckets: int = BUCKETS) -> Column:
    """The interval of an integer between the bounds that a value is in."""
    width = max(1, -(-(high - low + 1) // buckets))
    return F.floor((F.col(key) - F.lit(low)) / F.lit(width)).cast("bigint")


def running(df: DataFrame, bucket: Column, order: list[str], value: Column, out: str = "before") -> DataFrame:
    """Adds ``out``, the total of ``value`` over all rows before this one; ``order`` must tell rows apart for a fixed result."""
    dealt = df.withColumn("__b", bucket).withColumn("__v", value)
    sizes = dealt.groupBy("__b").agg(F.sum("__v").alias("__n"))
    starts = sizes.select("__b", (F.sum("__n").over(Window.orderBy("__b").rowsBetween(Window.unboundedPreceding, 0)) - F.col("__n")).alias("__s"))  # a row a bucket
    inside = F.sum("__v").over(Window.partitionBy("__b").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)) - F.col("__v")
    return dealt.join(F.broadcast(starts), "__b").withColumn(out, (F.col("__s") + inside).cast("bigint")).drop("__b", "__v", "__s")  # starts: at most the buckets


def placed(df: DataFrame, bucket: Column, order: list[str], out: str = "place") -> DataFrame:
    """Adds ``out``, the row's place from 0."""
    return running(df, bucket, order, F.lit(1).cast("bigint"), out)
