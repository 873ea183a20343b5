"""Row effects and findings of training methods against plain rules."""

import random

import pytest

from millrace.operators import methods
from millrace.operators.rows import RowError


def plain(method, masks, prompt, most, keep_end, packing):
    if masks is None:
        return None
    lengths = [len(m) for m in masks]
    end = keep_end and method != "kto"
    cut = lambda m: m if most is None or method not in ("sft", "dpo", "kto") or packing else (m[-most:] if end else m[:most])
    kept = [cut(m) for m in masks]
    trained = sum(sum(m[1:] if method in ("dpo", "kto") else m) for m in kept)
    dropped = most is not None and {"sft": not packing and trained == 0, "reward": max(lengths) > most, "dpo": not end and prompt >= most, "kto": prompt >= most}.get(method, False)
    if method == "sft":
        truncated = most is not None and (lengths[0] > most if packing else len(kept[0]) < lengths[0])
    else:
        truncated = not dropped and [len(m) for m in kept] != lengths
    by_token = method in ("sft", "dpo", "kto")
    return (sum(lengths), 0 if dropped else sum(map(len, kept)), (0 if dropped else trained) if by_token else None, truncated, dropped, (trained == 0 and not dropped) if by_token else None)


@pytest.mark.parametrize("method", list(methods.ROW_RULES))
def test_rows_of_each_method(spark, method):
    rng = random.Random(len(method))
    rows = [(0, None, 0), (1, [[0]] * (2 if method in ("dpo", "reward") else 1), 1)]
    for i in range(2, 60):
        prompt = rng.randrange(1, 12)
        branches = [[0] * prompt + [int(rng.random() < 0.7) for _ in range(rng.randrange(1, 12))] for _ in range(2 if method in ("dpo", "reward") else 1)]
        rows.append((i, branches, prompt))
    df = spark.createDataFrame(rows, "i long, masks array<array<int>>, p int").repartition(3)
    for most, keep_end, packing in ((8, False, False), (8, True, False), (None, False, False), *([(8, False, True)] if method == "sft" else [])):
        got = {r["i"]: r["effect"] and tuple(r["effect"]) for r in methods.row_effects(df, method, "masks", "p", most, keep_end, packing).collect()}
        assert got == {i: plain(method, m, p, most, keep_end, packing) for i, m, p in rows}, (most, keep_end, packing)


def test_refusals(spark):
    df = spark.createDataFrame([([[1]], 1, 2)], "masks array<array<int>>, p int, kept int")
    with pytest.raises(RowError, match="kept"):
        methods.row_effects(df, "sft", "masks", "p", 8)
    with pytest.raises(RowError, match="not one of"):
        methods.row_effects(df.drop("kept"), "ppo", "masks", "p", 8)


def test_findings(spark):
    base = {"method": "kto", "per_device": 4, "accumulation": 1, "sampling": "sequential", "loss_types": ["kto"], "workers": None, "smoothing": 0.0, "fused": False, "effective_rows": 9, "dropped_rows": 0, "row_errors": 0, "desirable": 3, "undesirable": 0, "sources": 1, "replay_fraction": None, "eval_rows": 5, "synthetic_eval": False, "eval_strategy": "steps"}
    found = lambda **more: {(r["code"], r["severity"]) for r in methods.method_findings(spark.createDataFrame([tuple((base | more).values())], methods.SETTINGS)).collect()}
    covered = ("evaluation_coverage", "info")
    assert found() == {("kto_singleton_kl", "warning"), ("kto_weighted_balance", "warning"), covered}
    assert found(loss_types=["apo_zero_unpaired"], undesirable=1, eval_strategy="no") == {("kto_weighted_balance", "info"), ("evaluation_coverage", "warning")}
    assert found(workers=4, row_errors=1) == {("kto_parallel_kl_groups", "info"), covered}
    assert found(sampling="random", effective_rows=None, desirable=None) == {("kto_kl_batch", "warning"), covered}
    assert found(method="dpo", loss_types=["sigmoid", "aot"], per_device=1, smoothing=0.2) == {("dpo_aot_batch", "warning"), ("dpo_inactive_smoothing", "warning"), covered}
    assert found(method="dpo", loss_types=["sigmoid"], smoothing=0.2, fused=True, sources=2, replay_fraction=0.5) == {("replay_exposure", "info"), covered}
    assert found(method="reward", dropped_rows=2, eval_rows=0, synthetic_eval=True) == {("reward_filtered_pairs", "warning"), covered}
