"""Training metrics as ordered series: changes, baselines, curves, recaps, drift."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.operators.order import half_even


def finite(value: Column) -> Column:
    return value.isNotNull() & ~F.isnan(value) & (F.abs(value) != float("inf"))


def changes(df: DataFrame, by: str, seq: str, value: str, low: float | None = None, high: float | None = None) -> DataFrame:
    """``df`` with ``change`` against the previous logged value and ``out_of_range``; rows that lack a value are skipped over."""
    before = Window.partitionBy(by).orderBy(seq).rowsBetween(Window.unboundedPreceding, -1)
    v = F.col(value)
    outside = F.lit(False)
    if low is not None:
        outside = outside | (v < low)
    if high is not None:
        outside = outside | (v > high)
    return df.withColumn("change", v - F.last(v, ignorenulls=True).over(before)).withColumn("out_of_range", F.when(v.isNotNull(), outside | F.isnan(v)))


def baseline_delta(df: DataFrame, by: str, seq: str, value: str) -> DataFrame:
    """``df`` with ``baseline``, the first finite value, ``carried``, the last known one, and ``delta`` between them."""
    upto = Window.partitionBy(by).orderBy(seq).rowsBetween(Window.unboundedPreceding, 0)
    good = F.when(finite(F.col(value)), F.col(value))
    out = df.withColumn("baseline", F.first(good, ignorenulls=True).over(upto)).withColumn("carried", F.last(good, ignorenulls=True).over(upto))
    return out.withColumn("delta", F.col("carried") - F.col("baseline"))


def carried_forward(df: DataFrame, by: str, seq: str, value: str, into: str) -> DataFrame:
    """``df`` with ``into``: the last value known at each record, null before the first; nonfinite values count as known."""
    return df.withColumn(into, F.last(value, ignorenulls=True).over(Window.partitionBy(by).orderBy(seq).rowsBetween(Window.unboundedPreceding, 0)))


def curve(df: DataFrame, step: str, seq: str, value: str, *by: str) -> DataFrame:
    """(by, step, value): the last record of each step; nonfinite values become gaps."""
    last = F.max_by(F.struct(value), seq)[value]
    return df.groupBy(*by, step).agg(last.alias(value)).withColumn(value, F.when(finite(F.col(value)), F.col(value)))


def recap(df: DataFrame, seq: str, value: str, *by: str) -> DataFrame:
    """First and last observation, their difference and the relative change."""
    good = df.filter(finite(F.col(value)))
    out = good.groupBy(*by).agg(F.min_by(value, seq).alias("first"), F.max_by(value, seq).alias("last"), F.min(seq).alias("first_step"), F.max(seq).alias("last_step"))
    return out.withColumn("delta", F.col("last") - F.col("first")).withColumn("relative", F.try_divide(F.col("delta"), F.abs("first")))


def recap_text(percent: Column, delta: Column, relative: Column) -> Column:
    """A change in percent points for shares, else as a relative change."""
    return F.when(percent, F.format_string("%+.1f pp", delta * 100)).otherwise(F.format_string("%+.1f%%", relative * 100))


def latest_series(df: DataFrame, series: str, seq: str) -> DataFrame:
    """Records of the series that the last record belongs to, from its baseline on."""
    last = df.agg(F.max_by(series, seq).alias("__s"))
    start = df.crossJoin(F.broadcast(last)).filter(F.col(series) == F.col("__s"))
    base = start.filter("kind = 'baseline'").agg(F.max(seq).alias("__from"))
    return start.crossJoin(F.broadcast(base)).filter(F.col(seq) >= F.col("__from")).drop("__s", "__from")


def nonfinite_notices(df: DataFrame, log: str, *keys: str) -> DataFrame:
    """(keys, metric, value) of nonfinite values in a map of metrics."""
    return df.select(*keys, F.explode(log).alias("metric", "value")).filter(F.isnan("value") | (F.abs("value") == float("inf")))


def epoch_means(df: DataFrame, epoch: str, step: str, value: str) -> DataFrame:
    """``df`` with the running mean in its epoch and the change of that mean from the row before."""
    w = Window.partitionBy(epoch).orderBy(step)
    out = df.withColumn("running_mean", F.avg(value).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return out.withColumn("mean_change", F.col("running_mean") - F.lag("running_mean").over(w))


def raster(df: DataFrame, step: Column, value: Column, width: int = 39, height: int = 13) -> DataFrame:
    """(x, y, n): points binned to a grid, the greatest value at the top row."""
    points = df.select(step.cast("double").alias("s"), value.cast("double").alias("v")).filter(finite(F.col("v")))
    ends = points.agg(F.max("s").alias("s1"), F.min("v").alias("v0"), F.max("v").alias("v1"))
    x = half_even(F.col("s") / F.col("s1") * (width - 1))
    y = half_even((F.col("v1") - F.col("v")) / F.when(F.col("v1") > F.col("v0"), F.col("v1") - F.col("v0")).otherwise(1.0) * (height - 1))
    return points.crossJoin(F.broadcast(ends)).groupBy(x.alias("x"), y.alias("y")).agg(F.count("*").alias("n"))


def windows(ids: Column, length: int) -> Column:
    """Windows of ``length`` ids that overlap by one, for scoring each next token once."""
    n = F.size(ids)
    return F.when(n > 1, F.transform(F.sequence(F.lit(0), n - 2, F.lit(length - 1)), lambda i: F.slice(ids, i + 1, F.lit(length)))).otherwise(F.array().cast("array<array<int>>"))


def drift(df: DataFrame, *by: str, now: str = "now", base: str = "base", moved: str = "moved") -> DataFrame:
    """Mean absolute drift, and consistency: drift over the sum of the single updates, 0 where nothing moved."""
    gap = F.sum(F.abs(F.col(now) - F.col(base)))
    out = df.groupBy(*by).agg(F.count("*").alias("n"), gap.alias("drift"), F.sum(F.abs(moved)).alias("moved"))
    return out.select(*by, "n", F.coalesce(F.try_divide("drift", "n"), F.lit(0.0)).alias("mean_drift"), F.coalesce(F.try_divide("drift", "moved"), F.lit(0.0)).alias("consistency"))


def overlapping_spans(df: DataFrame, *by: str) -> DataFrame:
    """Spans that reach into the next one of their field."""
    w = Window.partitionBy(*by).orderBy("start", "end")
    return df.withColumn("next_start", F.lead("start").over(w)).filter("next_start < end")


def first_occurrences(df: DataFrame, key: str, *order: str) -> DataFrame:
    return df.withColumn("__n", F.row_number().over(Window.partitionBy(key).orderBy(*order))).filter("__n = 1").drop("__n")


def reserve_last(df: DataFrame, by: str, order: str, n: int) -> DataFrame:
    """``df`` with ``evaluation``: whether a row is among its group's last ``n``."""
    return df.withColumn("evaluation", F.row_number().over(Window.partitionBy(by).orderBy(F.desc(order))) <= n)


def warnings(df: DataFrame) -> DataFrame:
    """(logger, level, message, n, sources) of repeated warnings."""
    return df.groupBy("logger", "level", "message").agg(F.count("*").alias("n"), F.sort_array(F.collect_set("source")).alias("sources"))


def failures(df: DataFrame) -> DataFrame:
    """The last operation of each source and its first failure that is not a consequence of another."""
    return df.groupBy("source").agg(F.max_by("operation", "seq").alias("last_operation"), F.min_by(F.when(~F.col("cascading"), F.col("message")), F.when(~F.col("cascading"), F.col("seq"))).alias("first_failure"))
