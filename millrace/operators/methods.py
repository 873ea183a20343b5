"""What each training method makes of a row, and what it says of settings: rules as tables of predicates over columns."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.operators.rows import RowError


@dataclass(frozen=True)
class RowRule:
    """SQL over raw, kept (tokens before and after the window, summed over branches), longest (the longest branch), prompt, trained (tokens
    with loss in the kept windows), most and packing. ``window``: branches are cut to ``most`` tokens; ``skip_first``: the first token of a
    window has no loss; ``loss``: the method's loss is counted by token; ``end``: the window may keep the end instead of the start."""

    dropped: str
    truncated: str
    window: bool = True
    skip_first: bool = False
    loss: bool = True
    end: bool = True


_PREFERENCE = RowRule(dropped="NOT keep_end AND prompt >= most", truncated="kept <> raw", skip_first=True)
#: A row of the table for each method; those that only read prompts cut and drop nothing.
ROW_RULES = {
    "sft": RowRule(dropped="NOT packing AND trained = 0", truncated="IF(packing, raw > most, kept < raw)"),
    "dpo": _PREFERENCE,
    "kto": RowRule(dropped=_PREFERENCE.dropped, truncated=_PREFERENCE.truncated, skip_first=True, end=False),
    "reward": RowRule(dropped="longest > most", truncated="false", window=False, loss=False),
    "grpo": RowRule(dropped="false", truncated="false", window=False, loss=False),
    "rloo": RowRule(dropped="false", truncated="false", window=False, loss=False),
}


def row_effects(df: DataFrame, method: str, masks: str, prompt: str, most: int | None, keep_end: bool = False, packing: bool = False) -> DataFrame:
    """``df`` with struct ``effect`` (raw, retained, loss, truncated, dropped, zero_loss) of each row.

    ``masks`` is an array with an array for each branch (one for sft and prompts, chosen and rejected for pairs): 1 for a token with loss, else 0.
    Without ``most`` nothing is cut or dropped. A dropped row retains nothing. Where the method's loss is not counted by token, loss and zero_loss are null.
    A row whose masks are null has a null effect.
    """
    if method not in ROW_RULES:
        raise RowError(f"method {method!r} is not one of {', '.join(ROW_RULES)}")
    rule, bound = ROW_RULES[method], F.lit(most)
    keep_end = keep_end and rule.end

    def window(mask: Column) -> Column:
        if most is None or not rule.window or packing:
            return mask
        return F.when(F.size(mask) <= bound, mask).otherwise(F.slice(mask, -most, most) if keep_end else F.slice(mask, 1, most))

    def total(values: Column) -> Column:
        return F.aggregate(values, F.lit(0).cast("long"), lambda a, x: a + x)

    kept = F.transform(masks, window)
    first = 2 if rule.skip_first else 1
    trained = total(F.transform(kept, lambda m: total(F.transform(F.slice(m, F.lit(first), F.greatest(F.size(m), F.lit(1))), lambda x: x.cast("long")))))
    seen = F.struct(
        total(F.transform(masks, lambda m: F.size(m).cast("long"))).alias("raw"),
        total(F.transform(kept, lambda m: F.size(m).cast("long"))).alias("kept"),
        F.array_max(F.transform(masks, lambda m: F.size(m))).alias("longest"),
        F.col(prompt).alias("prompt"),
        trained.alias("trained"),
        bound.cast("long").alias("most"),
        F.lit(packing).alias("packing"),
        F.lit(keep_end).alias("keep_end"),
    )
    told = df.withColumn("__seen", F.when(F.col(masks).isNotNull(), seen))
    inner = told.select("*", "__seen.*") if not {"raw", "kept", "longest", "prompt", "trained", "most", "packing", "keep_end"} & set(df.columns) else None
    if inner is None:
        raise RowError("columns named raw, kept, longest, prompt, trained, most, packing or keep_end are the rules' own; rename them")
    holds = lambda sql: F.coalesce(F.expr(sql), F.lit(False)) if most is not None else F.lit(False)
    out = inner.withColumn("__dropped", holds(rule.dropped)).withColumn("__truncated", holds(rule.truncated) & ~F.col("__dropped") if method != "sft" else holds(rule.truncated))
    loss = F.when(F.col("__dropped"), 0).otherwise(F.col("trained")) if rule.loss else F.lit(None)
    effect = F.struct(
        F.col("raw"),
        F.when(F.col("__dropped"), 0).otherwise(F.col("kept")).cast("long").alias("retained"),
        loss.cast("long").alias("loss"),
        F.col("__truncated").alias("truncated"),
        F.col("__dropped").alias("dropped"),
        ((F.col("trained") == 0) & ~F.col("__dropped") if rule.loss else F.lit(None).cast("boolean")).alias("zero_loss"),
    )
    return out.withColumn("effect", F.when(F.col("__seen").isNotNull(), effect)).select(*df.columns, "effect")


_KL = "loss_types[0] <> 'apo_zero_unpaired'"
_ONE_WORKER = "coalesce(workers, 1) = 1"
#: The codes of findings. (methods or none for all, code, severity, condition, evidence), all SQL over a row of settings.
FINDING_RULES = (
    (("kto",), "kto_kl_batch", "'warning'", f"{_KL} AND (per_device <= 1 OR sampling <> 'sequential')", "concat_ws(',', per_device, accumulation, sampling)"),
    (("kto",), "kto_parallel_kl_groups", "'info'", f"{_KL} AND effective_rows IS NOT NULL AND per_device > 1 AND NOT {_ONE_WORKER}", "concat_ws(',', effective_rows, per_device, workers)"),
    (("kto",), "kto_singleton_kl", "'warning'", f"{_KL} AND per_device > 1 AND {_ONE_WORKER} AND effective_rows % per_device = 1", "concat_ws(',', effective_rows, per_device)"),
    (("kto",), "kto_weighted_balance", "IF(desirable = 0 OR undesirable = 0, 'warning', 'info')", "desirable IS NOT NULL AND undesirable IS NOT NULL AND row_errors = 0", "concat_ws(',', desirable, undesirable)"),
    (("dpo",), "dpo_aot_batch", "IF(per_device = 1, 'warning', 'info')", "arrays_overlap(loss_types, array('aot', 'aot_unpaired'))", "concat_ws(',', per_device, accumulation)"),
    (("dpo",), "dpo_inactive_smoothing", "'warning'", "smoothing <> 0 AND NOT fused AND size(array_except(loss_types, array('robust', 'exo_pair', 'aot', 'aot_unpaired'))) > 0", "array_join(array_sort(array_except(loss_types, array('robust', 'exo_pair', 'aot', 'aot_unpaired'))), ',')"),
    (("reward",), "reward_filtered_pairs", "'warning'", "dropped_rows > 0", "concat_ws(',', dropped_rows, effective_rows)"),
    ((), "replay_exposure", "'info'", "replay_fraction IS NOT NULL AND sources > 1", "concat_ws(',', sources, replay_fraction)"),
    ((), "evaluation_coverage", "IF((eval_rows = 0 AND NOT synthetic_eval) OR eval_strategy = 'no', 'warning', 'info')", "true", "concat_ws(',', eval_rows, eval_strategy)"),
)
SETTINGS = (
    "method string, per_device long, accumulation long, sampling string, loss_types array<string>, workers long, smoothing double, fused boolean, effective_rows long, dropped_rows long, row_errors long, "
    "desirable long, undesirable long, sources long, replay_fraction double, eval_rows long, synthetic_eval boolean, eval_strategy string"
)


def method_findings(settings: DataFrame) -> DataFrame:
    """(method, code, severity, evidence) of the rules that hold on each row of SETTINGS; a condition that is null does not hold."""
    made = []
    for methods, code, severity, condition, evidence in FINDING_RULES:
        holds = F.expr(condition) & (F.col("method").isin(list(methods)) if methods else F.lit(True))
        made.append(F.when(holds, F.struct(F.lit(code).alias("code"), F.expr(severity).alias("severity"), F.expr(evidence).alias("evidence"))))
    return settings.select("method", F.explode(F.array_compact(F.array(*made))).alias("f")).select("method", "f.*")
