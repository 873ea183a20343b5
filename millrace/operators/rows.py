"""Ordered-row transforms: shuffle, sample, split, mix, train and evaluation sets, replay, filters.

Each takes the columns that order the rows; results keep that order in the columns themselves.
"""

from __future__ import annotations

import math
from decimal import Decimal
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.operators.order import dense_index, running_sum, seeded


class RowError(ValueError):
    """Rows or arguments that an operator refuses, named before anything is written."""


def shuffle(df: DataFrame, seed: int, *keys: str) -> DataFrame:
    """All rows in an order that depends on ``seed`` and the unique ``keys`` only."""
    return df.orderBy(seeded(seed, *keys), *keys)


#: Rows that a top-k may gather in one task.
TOP = 10_000


def first_rows(df: DataFrame, n: int, *order: str) -> DataFrame:
    """The ``n`` rows that come first in ``order``, in no order themselves.

    More than TOP of them are those up to the n-th order value, which is found among the order columns by ranges; no row meets the others.
    """
    if n <= TOP:
        return df.orderBy(*order).limit(n)
    numbered = dense_index(df.select(*order), *order, into="__at")
    last = numbered.filter(F.col("__at") == n - 1).first()
    if last is None:
        return df
    kinds, key = dict(df.dtypes), F.struct(*order)
    bound = F.struct(*[F.lit(last[c]).cast(kinds[c]).alias(c) for c in order])
    before = numbered.filter(key < bound).count()
    return df.filter(key < bound).unionByName(df.filter(key == bound).limit(n - before))  # rows that share the last value, mostly one


def sample(df: DataFrame, n: int, seed: int, *keys: str) -> DataFrame:
    """Exactly ``n`` rows without replacement, in input order."""
    if n < 0:
        raise RowError(f"cannot sample {n} rows")
    mark = "__rank"
    return first_rows(df.withColumn(mark, seeded(seed, *keys)), n, mark, *keys).drop(mark).orderBy(*keys)


def head(df: DataFrame, n: int, *order: str) -> DataFrame:
    return first_rows(df, n, *order).orderBy(*order)


def split_count(total: int, n: int | None = None, fraction: float | None = None) -> int:
    """Rows of the first part: ``n``, or the fraction of the total with halves rounded to even."""
    if (n is None) == (fraction is None):
        raise RowError("give either a count or a fraction")
    count = n if n is not None else round(total * fraction)
    if not 0 < count < total:
        raise RowError(f"a split of {count} of {total} rows leaves one side empty")
    return count


def split(df: DataFrame, *order: str, n: int | None = None, fraction: float | None = None) -> tuple[DataFrame, DataFrame]:
    """(first rows, the rest) in order."""
    count = split_count(df.count(), n, fraction)
    first = head(df, count, *order)
    last = first.agg(F.max(F.struct(*order)).alias("m")).first()["m"]
    bound = F.struct(*[F.lit(last[c]).alias(c) for c in order])
    key = F.struct(*order)
    return df.filter(key <= bound), df.filter(key > bound)


def split_by_key(df: DataFrame, key: str, order: str, n: int) -> DataFrame:
    """``df`` with a boolean ``first``: whole groups of equal keys, in order of first appearance, go to the
    first part while it has fewer than ``n`` rows. Null is a key like others."""
    groups = df.groupBy(key).agg(F.min(order).alias("__at"), F.count("*").alias("__n"))
    side = running_sum(groups, "__n", "__at", into="__before").select(F.col(key).alias("__key"), (F.col("__before") < n).alias("first"))
    return df.join(side, F.col(key).eqNullSafe(F.col("__key"))).drop("__key")


def mix(sources: list[tuple[DataFrame, float]], seed: int, key: str) -> DataFrame:
    """A seeded share of each source, sources in the given order and rows in theirs; columns are united.

    Adds ``source_no``. The size of each share is the fraction of its source with halves rounded to even.
    """
    parts = []
    for number, (df, fraction) in enumerate(sources):
        if not 0 < fraction <= 1:
            raise RowError(f"source {number}: a fraction lies above 0 and up to 1, got {fraction}")
        parts.append(sample(df, round(df.count() * fraction), seed, key).withColumn("source_no", F.lit(number)))
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts).orderBy("source_no", key)


def evaluation_count(total: int, fraction: str) -> int:
    """The fraction, as the decimal it is written as, of the total, rounded up; both sides must have rows."""
    count = math.ceil(Decimal(total) * Decimal(fraction))
    if not 0 < count < total:
        raise RowError(f"a fraction of {fraction} of {total} rows leaves one side empty")
    return count


def train_eval(df: DataFrame, fraction: str, key: str, seed: int | None = None) -> DataFrame:
    """``df`` with a boolean ``evaluation``: the last rows, or seeded ones, in the input's order on both sides."""
    count = evaluation_count(df.count(), fraction)
    ranked = df.orderBy(F.desc(key)) if seed is None else df.orderBy(seeded(seed, key), key)
    chosen = ranked.limit(count).select(F.col(key).alias("__key"), F.lit(True).alias("evaluation"))
    return df.join(chosen, F.col(key).eqNullSafe(F.col("__key")), "left").drop("__key").withColumn("evaluation", F.coalesce("evaluation", F.lit(False)))


def replay_count(primary: int, fraction: float) -> int:
    """Replay rows that make up ``fraction`` of the mixed rows, at least one."""
    return max(1, round(fraction * primary / (1 - fraction)))


def replay_mix(primary: DataFrame, replay: DataFrame, fraction: float, order: str, marker: str | None = "replay") -> DataFrame:
    """The primary rows and the first replay rows, marked; both must have the same columns."""
    if set(primary.columns) != set(replay.columns):
        raise RowError(f"columns differ: {sorted(set(primary.columns) ^ set(replay.columns))}")
    if marker in primary.columns:
        raise RowError(f"column {marker!r} is reserved for the mix")
    chosen = head(replay, replay_count(primary.count(), fraction), order)
    if marker:
        primary, chosen = primary.withColumn(marker, F.lit(False)), chosen.withColumn(marker, F.lit(True))
    return primary.unionByName(chosen)


def truthy(value: Column, kind: str) -> Column:
    """Python's truth of a value of a Spark type: null, zero and empty are false."""
    if kind == "boolean":
        found = value
    elif kind.startswith(("array", "map")):
        found = F.size(value) > 0
    elif kind == "string":
        found = F.length(value) > 0
    elif kind.startswith("struct"):
        found = value.isNotNull()
    else:
        found = value != 0
    return F.coalesce(found, F.lit(False))


def limit_lengths(df: DataFrame, limits: dict[str, int]) -> DataFrame:
    """Rows whose strings have at most so many characters, and whose lists so many items."""
    kinds = dict(df.dtypes)
    for name, most in limits.items():
        if name not in kinds:
            raise RowError(f"no column {name!r}")
        if kinds[name] != "string" and not kinds[name].startswith("array"):
            raise RowError(f"column {name!r} is {kinds[name]}, which has no length")
        df = df.filter((F.length(name) if kinds[name] == "string" else F.size(name)) <= most)
    return df


def dedup_append(existing: DataFrame, new: DataFrame, identity: list[str], order: str) -> DataFrame:
    """The rows of ``new`` to append: first of their identity in the batch, and not in ``existing``; nulls compare equal."""
    first = new.withColumn("__n", F.row_number().over(Window.partitionBy(*identity).orderBy(order))).filter("__n = 1").drop("__n")
    known = existing.select(*[F.col(c).alias(f"__{c}") for c in identity]).distinct()
    same = reduce(Column.__and__, [F.col(c).eqNullSafe(F.col(f"__{c}")) for c in identity])
    return first.join(known, same, "left_anti")


def replace_row(lines: DataFrame, digest: str, new: str | None, column: str = "line") -> DataFrame:
    """``lines`` with the one line of that SHA-256 replaced, or deleted if ``new`` is None; any other count of hits is refused."""
    hit = F.sha2(F.col(column), 256) == digest
    found = lines.filter(hit).count()
    if found != 1:
        raise RowError(f"{found} rows have the digest {digest}, expected 1")
    return lines.filter(~hit | hit.isNull()) if new is None else lines.withColumn(column, F.when(hit, F.lit(new)).otherwise(F.col(column)))


def rewind(records: DataFrame, step: int, column: str = "step") -> DataFrame:
    """Records up to ``step``."""
    return records.filter(F.col(column) <= step)


def keep_newest(exports: DataFrame, k: int, column: str = "step") -> DataFrame:
    """``exports`` with ``keep``: whether a row is among the ``k`` highest steps. A top-k."""
    last = exports.select(column).distinct().orderBy(F.desc(column)).limit(k).select(F.col(column).alias("__s"), F.lit(True).alias("keep"))
    return exports.join(F.broadcast(last), F.col(column) == F.col("__s"), "left").drop("__s").withColumn("keep", F.coalesce("keep", F.lit(False)))


def vocabulary_difference(a: DataFrame, b: DataFrame, token: str = "token", number: str = "id") -> DataFrame:
    """(token, a_id, b_id) of tokens whose ids differ or that one side lacks, by token."""
    x, y = a.select(token, F.col(number).alias("a_id")), b.select(token, F.col(number).alias("b_id"))
    return x.join(y, token, "full_outer").filter(~F.col("a_id").eqNullSafe(F.col("b_id"))).orderBy(token)


def next_run_number(names: DataFrame, date: str, column: str = "name") -> int:
    """One more than the greatest number after ``date`` in any name."""
    number = F.regexp_extract(column, rf"{date}-(\d+)", 1)
    return (names.select(F.max(number.try_cast("int")).alias("m")).first()["m"] or 0) + 1


