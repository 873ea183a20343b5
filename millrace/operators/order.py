"""Row order: dense indices without a single-task window, seeded ranks that any engine can repeat, rounding."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.session import settle


def seeded(seed: int, *keys: str | Column) -> Column:
    """A sort key that shuffles rows by ``seed`` alike at any partitioning: md5 of 'seed:key:...'."""
    return F.md5(F.concat_ws(":", F.lit(str(seed)), *[F.col(k).cast("string") if isinstance(k, str) else k.cast("string") for k in keys]))


def half_even(value: Column) -> Column:
    """The nearest whole number, halves to the even one."""
    return F.bround(value, 0).cast("long")


def running_sum(df: DataFrame, amount: str, *order: str | Column, into: str = "before") -> DataFrame:
    """``df`` with the sum of ``amount`` over all rows in front, in ``order``; one sum for each range leaves its task."""
    part = "__part"
    ranged = df.repartitionByRange(*[F.col(o) if isinstance(o, str) else o for o in order]).withColumn(part, F.spark_partition_id())
    ranged = settle(ranged, "ranged")
    sums = ranged.groupBy(part).agg(F.sum(amount).alias("__n"))
    front = sums.select(part, F.coalesce(F.sum("__n").over(Window.orderBy(part).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__front"))
    local = F.coalesce(F.sum(amount).over(Window.partitionBy(part).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return ranged.withColumn("__local", local).join(F.broadcast(front), part).withColumn(into, F.col("__front") + F.col("__local")).drop(part, "__local", "__front")


def dense_index(df: DataFrame, *order: str | Column, into: str = "row_idx") -> DataFrame:
    """``df`` with consecutive numbers from 0 in ``order`` (ties keep no promised order).

    Rows are range-partitioned and numbered within partitions; only one count for each partition leaves them.
    """
    part = "__part"
    ranged = df.repartitionByRange(*[F.col(o) if isinstance(o, str) else o for o in order]).withColumn(part, F.spark_partition_id())
    ranged = settle(ranged, "ranged")  # partition numbers must not change between the two uses
    sizes = ranged.groupBy(part).agg(F.count("*").alias("__n"))
    before = sizes.select(part, F.coalesce(F.sum("__n").over(Window.orderBy(part).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__before"))
    local = F.row_number().over(Window.partitionBy(part).orderBy(*order)) - 1
    return ranged.withColumn("__local", local).join(F.broadcast(before), part).withColumn(into, (F.col("__before") + F.col("__local")).cast("long")).drop(part, "__local", "__before")
