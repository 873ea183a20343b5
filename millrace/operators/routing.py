"""Routing totals of mixture-of-experts gates, selection of experts, and counts of changed codes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def exploded(df: DataFrame, *keys: str, indices: str = "indices", weights: str = "weights", mask: str | None = "token_mask") -> DataFrame:
    """(keys, expert, weight), one row for each slot of unmasked tokens."""
    rows = df.filter(F.col(mask)) if mask else df
    return rows.select(*keys, F.explode(F.arrays_zip(F.col(indices).alias("expert"), F.col(weights).alias("weight"))).alias("s")).select(*keys, "s.expert", "s.weight")


def totals(slots: DataFrame, layer: str = "layer", expert: str = "expert", weight: str = "weight") -> DataFrame:
    """(layer, expert, slots, gate_sum)"""
    return slots.groupBy(layer, expert).agg(F.count("*").alias("slots"), F.sum(weight).alias("gate_sum"))


def scores(total: DataFrame, topk: int, layer: str = "layer") -> DataFrame:
    """Totals with token_score, the share of the layer's slots, and gate_score, the weight by token."""
    w = Window.partitionBy(layer)
    all_ = F.sum("slots").over(w)
    return total.withColumn("token_score", F.col("slots") / all_).withColumn("gate_score", F.col("gate_sum") / (all_ / topk))


def _before(score: str, layer: str, expert: str) -> Column:
    ordered = Window.partitionBy(layer).orderBy(F.desc(score), expert).rowsBetween(Window.unboundedPreceding, -1)
    return F.coalesce(F.sum(score).over(ordered), F.lit(0))


def coverage(total: DataFrame, score: str = "slots", layer: str = "layer", expert: str = "expert", fractions=(0.2, 0.5, 0.8)) -> DataFrame:
    """(layer, experts_20, ...): experts by falling score that it takes to reach each share of the total."""
    prior = total.withColumn("__prior", _before(score, layer, expert)).withColumn("__all", F.sum(score).over(Window.partitionBy(layer)))
    return prior.groupBy(layer).agg(*[F.count_if(F.col("__prior") < f * F.col("__all")).alias(f"experts_{int(100 * f)}") for f in fractions])


def select_top_p(scored: DataFrame, top_p: float | Column, score: str = "token_score", layer: str = "layer", expert: str = "expert") -> DataFrame:
    """Experts by falling score until the sum reaches ``top_p``, a number or a column of each layer's own, the one that crosses it included; ties go to the lower number."""
    return scored.withColumn("__prior", _before(score, layer, expert)).filter(F.col("__prior") < top_p).drop("__prior")


def select_per_rank(scored: DataFrame, n: int, ranks: int, experts: int, score: str = "token_score", layer: str = "layer", expert: str = "expert") -> DataFrame:
    """The ``n`` best of each of ``ranks`` equal ranges of expert numbers."""
    if experts % ranks or not 0 <= n <= experts // ranks:
        raise ValueError(f"{experts} experts in {ranks} ranks do not give {n} each")
    rank = F.floor(F.col(expert) / (experts // ranks))
    w = Window.partitionBy(layer, rank).orderBy(F.desc(score), expert)
    return scored.withColumn("__n", F.row_number().over(w)).filter(F.col("__n") <= n).drop("__n")


def layer_report(total: DataFrame, topk: int, experts: int, layer: str = "layer") -> DataFrame:
    """(layer, tokens, max_token_share, experts_with_zero_slots)"""
    return total.groupBy(layer).agg((F.sum("slots") / topk).cast("long").alias("tokens"), (F.max("slots") / F.sum("slots")).alias("max_token_share"), (F.lit(experts) - F.count_if(F.col("slots") > 0)).alias("experts_with_zero_slots"))


def missing_layers(report: DataFrame, expected: DataFrame, layer: str = "layer") -> DataFrame:
    return expected.join(report.select(layer).distinct(), layer, "left_anti")


def selection_faults(selected: DataFrame, expected: DataFrame, experts: int, layer: str = "layer", expert: str = "expert") -> DataFrame:
    """(layer, expert, fault): layers that a report lacks, and ids that no expert has."""
    lacks = missing_layers(selected, expected.select(layer).distinct(), layer).select(layer, F.lit(None).cast("long").alias(expert), F.lit("no selection").alias("fault"))
    outside = selected.filter((F.col(expert) < 0) | (F.col(expert) >= experts)).select(layer, F.col(expert).cast("long").alias(expert), F.lit("no such expert").alias("fault"))
    return lacks.union(outside.distinct())


def flips(before: DataFrame, after: DataFrame, keys: list[str], group: str, layer: str, value: str = "code") -> DataFrame:
    """(group, layer, elements, flipped): changed codes by class, and by class and layer in the same pass (layer null for the class)."""
    joined = before.withColumnRenamed(value, "__a").join(after.select(*keys, F.col(value).alias("__b")), keys)
    return joined.groupingSets([[F.col(group)], [F.col(group), F.col(layer)]], F.col(group), F.col(layer)).agg(F.count("*").alias("elements"), F.count_if(~F.col("__a").eqNullSafe(F.col("__b"))).alias("flipped"))


def summed_entries(df: DataFrame, position: str, value: str, k: int) -> DataFrame:
    """(expert, total): each ``k`` consecutive entries belong to one expert."""
    return df.groupBy(F.floor(F.col(position) / k).alias("expert")).agg(F.sum(value).alias("total"))


def inventory(df: DataFrame, trainable: str = "trainable", dtype: str = "dtype", elements: str = "elements", width: str = "width") -> DataFrame:
    return df.groupBy(trainable, dtype).agg(F.sum(elements).cast("long").alias("elements"), F.sum(F.col(elements) * F.col(width)).cast("long").alias("bytes"))


def adapter_matches(a: DataFrame, b: DataFrame, value: str = "value", tolerance: float = 0.01) -> DataFrame:
    """One row: tensors and greatest magnitudes of both sides, and whether they agree within the relative tolerance."""
    x = a.agg(F.countDistinct("tensor").alias("n_a"), F.max(F.abs(value)).alias("max_a"))
    y = b.agg(F.countDistinct("tensor").alias("n_b"), F.max(F.abs(value)).alias("max_b"))
    return x.crossJoin(y).withColumn("matches", (F.col("n_a") == F.col("n_b")) & (F.abs(F.col("max_a") - F.col("max_b")) <= tolerance * F.greatest("max_a", "max_b")))


def module_counts(names: DataFrame, column: str = "name") -> DataFrame:
    """(prefix, n): modules by the path before the first number in it."""
    return names.groupBy(F.regexp_extract(column, r"^(.*?)(?:\.\d+(?:\.|$)|$)", 1).alias("prefix")).agg(F.count("*").alias("n"))


def changed_payloads(a: DataFrame, b: DataFrame) -> DataFrame:
    """Tensors of equal headers whose payload digests differ: both sides have name, header and payload (binary)."""
    x = a.select("name", "header", F.sha2("payload", 256).alias("a_digest"))
    y = b.select("name", F.col("header").alias("__h"), F.sha2("payload", 256).alias("b_digest"))
    return x.join(y, "name").filter("header = __h AND a_digest <> b_digest").drop("__h", "header")
