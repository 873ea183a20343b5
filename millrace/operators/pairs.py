"""Preference pairs by aligned conversations, and overlaps between sets of rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.operators.rows import RowError


def _ranked(side: DataFrame, key: str, order: str) -> DataFrame:
    return side.withColumn("__rn", F.row_number().over(Window.partitionBy(key).orderBy(order)))


def align(chosen: DataFrame, rejected: DataFrame, key: str, order: str) -> DataFrame:
    """Rows of equal keys, the first with the first, the second with the second: (key, nth, c.*, r.*) as structs chosen and rejected."""
    a = _ranked(chosen, key, order).select(F.col(key).alias("key"), F.col("__rn").alias("nth"), F.struct(*chosen.columns).alias("chosen"))
    b = _ranked(rejected, key, order).select(F.col(key).alias("key"), F.col("__rn").alias("nth"), F.struct(*rejected.columns).alias("rejected"))
    return a.join(b, ["key", "nth"])


def unmatched(chosen: DataFrame, rejected: DataFrame, key: str, order: str) -> DataFrame:
    """(side, order column, key) of rows that found no partner."""
    a, b = _ranked(chosen, key, order), _ranked(rejected, key, order)
    left = a.join(b, [key, "__rn"], "left_anti").select(F.lit("chosen").alias("side"), order, key)
    right = b.join(a, [key, "__rn"], "left_anti").select(F.lit("rejected").alias("side"), order, key)
    return left.union(right)


def align_strict(chosen: DataFrame, rejected: DataFrame, key: str, order: str) -> DataFrame:
    odd = unmatched(chosen, rejected, key, order).orderBy("side", order).limit(5).collect()
    if odd:
        raise RowError(f"rows without a partner, among them {[(r['side'], r[order]) for r in odd]}")
    return align(chosen, rejected, key, order)


def overlap(train: DataFrame, held_out: DataFrame, digest: str, index: str) -> DataFrame:
    """(digest, train_rows, eval_rows): rows of both sides with equal digests, as ascending lists."""
    a = train.groupBy(digest).agg(F.sort_array(F.collect_list(index)).alias("train_rows"))
    b = held_out.groupBy(digest).agg(F.sort_array(F.collect_list(index)).alias("eval_rows"))
    return a.join(b, digest)


def overlap_rows(train: DataFrame, held_out: DataFrame, digest: str, index: str) -> DataFrame:
    """(digest, side, row): the rows of overlap() one by one, so that a digest of any number of rows is never gathered."""
    a, b = (x.select(F.col(digest).alias("digest"), F.lit(side).alias("side"), F.col(index).alias("row")) for x, side in ((train, "train"), (held_out, "eval")))
    both = a.select("digest").distinct().join(b.select("digest").distinct(), "digest")
    return a.union(b).join(both, "digest", "left_semi")


def already_recorded(records: DataFrame, known: DataFrame, series: str) -> DataFrame:
    """Records whose series has a baseline."""
    return records.join(known.filter("kind = 'baseline'").select(series).distinct(), series, "left_semi")


def as_of(left: DataFrame, right: DataFrame, by: str, at: str, value: str, into: str) -> DataFrame:
    """``left`` with the last ``value`` of ``right`` whose ``at`` is not later, by group: one sort of the union, no range join."""
    own = left.withColumn("__v", F.lit(None).cast(dict(right.dtypes)[value])).withColumn("__side", F.lit(1))
    other = right.select(by, at, F.col(value).alias("__v")).withColumn("__side", F.lit(0))
    both = own.unionByName(other, allowMissingColumns=True)
    w = Window.partitionBy(by).orderBy(at, "__side").rowsBetween(Window.unboundedPreceding, 0)
    return both.withColumn(into, F.last("__v", ignorenulls=True).over(w)).filter("__side = 1").drop("__v", "__side")


def best_steps(checkpoints: DataFrame, losses: DataFrame) -> DataFrame:
    """Checkpoints with their evaluation loss and whether it is the least; equal ones are all best."""
    joined = checkpoints.join(losses, "step", "left")
    least = losses.agg(F.min("eval_loss").alias("__least"))
    return joined.crossJoin(F.broadcast(least)).withColumn("best", F.coalesce(F.col("eval_loss") == F.col("__least"), F.lit(False))).drop("__least")


def flat_config(df: DataFrame, column: str = "config") -> DataFrame:
    """(path, value) of the leaves of JSON objects of two levels, given as text."""
    top = df.select(F.explode(F.from_json(column, "map<string,string>")).alias("k", "v"))
    inner = F.from_json("v", "map<string,string>")
    nested = top.select("k", "v", F.explode_outer(F.when(F.col("v").startswith("{"), inner)).alias("k2", "v2"))
    return nested.select(F.when(F.col("k2").isNull(), F.col("k")).otherwise(F.concat_ws(".", "k", "k2")).alias("path"), F.coalesce("v2", "v").alias("value"))


def config_difference(a: DataFrame, b: DataFrame, ignore: tuple[str, ...] = ()) -> DataFrame:
    """(path, state, a_value, b_value): only_a, only_b or different."""
    x = a.select("path", F.col("value").alias("a_value"), F.lit(True).alias("__a"))
    y = b.select("path", F.col("value").alias("b_value"), F.lit(True).alias("__b"))
    joined = x.join(y, "path", "full_outer").filter(~F.col("path").isin(*ignore))
    state = F.when(F.col("__b").isNull(), "only_a").when(F.col("__a").isNull(), "only_b").otherwise("different")
    return joined.filter(F.col("__a").isNull() | F.col("__b").isNull() | ~F.col("a_value").eqNullSafe(F.col("b_value"))).select("path", state.alias("state"), "a_value", "b_value")


def tokens_in_spans(offsets: DataFrame, spans: DataFrame, by: str, offset: str = "offset") -> DataFrame:
    """(by, start, end, n_tokens): token offsets inside [start, end). Both sides have the group column, which the join hashes."""
    inside = F.col(offset).between(F.col("start"), F.col("end") - 1)
    return spans.join(offsets, by, "left").groupBy(by, "start", "end").agg(F.count_if(inside).alias("n_tokens"))


def count_inside(offsets: Column, start: Column, end: Column) -> Column:
    """The same where the offsets are an array beside the span."""
    return F.size(F.filter(offsets, lambda o: (o >= start) & (o < end)))
