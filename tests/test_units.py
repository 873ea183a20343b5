"""Operators of rows, conversations, texts, scores, files and streams on literal inputs."""

import json
import math
import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from millrace.functions import quality, rewards
from millrace.operators import chunking, edits, endpoint, fields, messages, order, pairs, profile, quantize, repair, routing, rows, series
from millrace.operators.rows import RowError
from millrace.session import scratch
from millrace.sources import files, markup
from millrace.streaming import metrics


@pytest.fixture(scope="module")
def numbers(spark):
    return spark.range(100).select(F.col("id"), F.col("id").cast("string").alias("text"))


# order and rows


@pytest.mark.parametrize("partitions", [1, 4, 16])
def test_order_does_not_depend_on_partitions(numbers, partitions):
    df = numbers.repartition(partitions)
    assert [r["id"] for r in rows.shuffle(df, 1, "id").collect()] == [r["id"] for r in rows.shuffle(numbers.coalesce(1), 1, "id").collect()]
    assert [r["id"] for r in rows.sample(df, 9, 3, "id").collect()] == [r["id"] for r in rows.sample(numbers, 9, 3, "id").collect()]
    assert sorted((r["id"], r["row_idx"]) for r in order.dense_index(df, "id").collect()) == [(i, i) for i in range(100)]


@pytest.mark.parametrize(("total", "fraction", "want"), [(100, "0.07", 7), (23, "0.1", 3), (2, "0.1", 1)])
def test_evaluation_counts_are_exact(spark, total, fraction, want):
    df = spark.range(total)
    for seed in (None, 5):
        out = rows.train_eval(df, fraction, "id", seed).collect()
        assert sum(r["evaluation"] for r in out) == want and len(out) == total


def test_splits_cover_and_keep_order(numbers):
    first, rest = rows.split(numbers, "id", fraction=0.25)
    assert [r["id"] for r in first.orderBy("id").collect()] == list(range(25)) and rest.count() == 75
    for bad in ({"n": 0}, {"n": 100}, {}, {"n": 1, "fraction": 0.5}):
        with pytest.raises(RowError):
            rows.split(numbers, "id", **bad)


def test_groups_stay_together(spark):
    df = spark.createDataFrame([(0, "a"), (1, "b"), (2, "a"), (3, None), (4, "c"), (5, None)], "id long, k string")
    got = {r["id"]: r["first"] for r in rows.split_by_key(df, "k", "id", 3).collect()}
    assert got == {0: True, 1: True, 2: True, 3: False, 4: False, 5: False}


def test_mix_and_replay(spark, numbers):
    other = spark.range(10).select("id", F.lit(1).alias("extra"))
    mixed = rows.mix([(numbers, 0.1), (other, 0.5)], 2, "id").collect()
    assert [r["source_no"] for r in mixed] == [0] * 10 + [1] * 5 and mixed[0]["extra"] is None
    out = rows.replay_mix(numbers, numbers, 0.2, "id")
    assert out.filter("replay").count() == 25 and out.count() == 125
    with pytest.raises(RowError):
        rows.replay_mix(numbers, other, 0.2, "id")


@pytest.mark.parametrize("n", [6, 40, 99, 150])
def test_samples_past_a_top_k_meet_in_no_task(spark, monkeypatch, n):
    monkeypatch.setattr(rows, "TOP", 5, raising=False)
    df = spark.range(120).select((F.col("id") % 100).alias("id"), F.lit("text").alias("text"))  # some keys twice
    rank = lambda i: __import__("hashlib").md5(f"3:{i}".encode()).hexdigest()
    want = sorted(sorted((i % 100 for i in range(120)), key=lambda i: (rank(i), i))[:n])
    got = rows.sample(df, n, 3, "id")
    assert [r["id"] for r in got.collect()] == want
    assert "TakeOrdered" not in got._jdf.queryExecution().executedPlan().toString() and "Sort [__rank" not in got._jdf.queryExecution().optimizedPlan().toString()


def test_dedup_append_compares_nulls(spark):
    old = spark.createDataFrame([("a", None), ("b", "r")], "u string, r string")
    new = spark.createDataFrame([(0, "a", None), (1, "a", ""), (2, "c", None), (3, "c", None)], "i long, u string, r string")
    assert [r["i"] for r in rows.dedup_append(old, new, ["u", "r"], "i").orderBy("i").collect()] == [1, 2]


def test_replace_row_wants_one_hit(spark):
    df = spark.createDataFrame([("a",), ("b",), ("b",)], "line string")
    digest = lambda t: __import__("hashlib").sha256(t.encode()).hexdigest()
    assert sorted(r["line"] for r in rows.replace_row(df, digest("a"), "x").collect()) == ["b", "b", "x"]
    assert rows.replace_row(df, digest("a"), None).count() == 2
    for text in ("b", "none"):
        with pytest.raises(RowError):
            rows.replace_row(df, digest(text), "x")


def test_vocabulary_and_run_numbers(spark):
    a = spark.createDataFrame([("x", 1), ("y", 2), ("z", None)], "token string, id int")
    b = spark.createDataFrame([("x", 1), ("y", 3), ("w", 4)], "token string, id int")
    assert [r["token"] for r in rows.vocabulary_difference(a, b).collect()] == ["w", "y"]
    names = spark.createDataFrame([("2026-01-02-3",), ("x-2026-01-02-11",), ("2026-01-03-40",)], "name string")
    assert rows.next_run_number(names, "2026-01-02") == 12 and rows.next_run_number(names, "2025-01-01") == 1


# fields


def test_expressions(spark):
    df = spark.createDataFrame([(1, "abc", [1, 2], True, -7), (2, "", [], False, 7)], "a long, s string, l array<int>, b boolean, `odd name` long")
    out = fields.apply_fields(df, [("n", "len(s) + len(l)"), ("m", "row['odd name'] % 3"), ("t", "str(b)"), ("f", "int(2.9) if s and not l else a // 2"), ("last", "s[-1] if s else ''"), ("hit", "'b' in s and a in (1, 3)"), ("twice", "n * 2")]).collect()
    assert [(r["n"], r["m"], r["t"], r["f"], r["last"], r["hit"], r["twice"]) for r in out] == [(5, 2, "True", 0, "c", True, 10), (0, 1, "False", 1, "", False, 0)]
    assert [r["a"] for r in fields.where(df, "s").collect()] == [1] and [r["a"] for r in fields.where(df, "not l", "a > 1").collect()] == [2]


@pytest.mark.parametrize("source", ["__import__('os')", "a.b", "lenght(s)", "a +", "(lambda: 1)()", "nothing"])
def test_refused_expressions(spark, source):
    with pytest.raises(RowError):
        fields.compile_expression(spark.range(1).select(F.col("id").alias("a"), F.lit("x").alias("s")), source)


def test_field_operations(spark):
    df = spark.createDataFrame([(1, 2, 3)], "a int, b int, c int")
    out = fields.apply_fields(df, [("d", "a + b")], ["a"], [("b", "c")], [("c", "d")])
    assert out.columns == ["d", "c"] and tuple(out.first()) == (2, 3)
    for wrong in ({"removes": ["x"]}, {"renames": [("x", "y")]}, {"swaps": [("a", "x")]}):
        with pytest.raises(RowError):
            fields.apply_fields(df, **wrong)
    assert fields.assignment("a=b=c", "--add") == ("a", "b=c")
    with pytest.raises(RowError):
        fields.assignment("=x", "--add")


def test_length_limits(spark):
    df = spark.createDataFrame([("ab", [1]), ("abc", [1, 2]), (None, [])], "s string, l array<int>")
    assert rows.limit_lengths(df, {"s": 2}).count() == 1 and rows.limit_lengths(df, {"l": 1}).count() == 2
    with pytest.raises(RowError):
        rows.limit_lengths(df.withColumn("n", F.lit(1)), {"n": 2})


# conversations

CALL = ("c1", "function", "look", '{"q": 1}')


def context(spark, turns):
    return spark.createDataFrame([(1, turns)], f"k int, messages array<{messages.TOOL_MESSAGE}>")


@pytest.mark.parametrize(
    ("turns", "error"),
    [
        ([("user", "hi", None, None), ("assistant", None, [CALL], None), ("tool", "r", None, "c1"), ("assistant", "ok", None, None)], None),
        ([("assistant", None, [CALL], None)], "calls lack results"),
        ([("assistant", None, [CALL], None), ("user", "x", None, None)], "calls wait for their results"),
        ([("tool", "r", None, "c9")], "the result answers no pending call"),
        ([("assistant", None, [CALL], None), ("tool", "r", None, "c1"), ("tool", "r", None, "c1")], "the call has a result already"),
        ([("assistant", None, [CALL, CALL], None)], "a call id is used twice"),
        ([("user", None, [CALL], None)], "only the assistant calls tools"),
        ([("assistant", None, [], None)], "the list of calls is empty"),
        ([("assistant", None, [("c1", "other", "look", "{}")], None)], "a call is not a named function"),
        ([("assistant", None, [("c1", "function", "look", "[1]")], None)], "arguments are not a JSON object"),
        ([("user", "x", None, "c1")], "only tool results name a call"),
        ([("tool", "x", None, "")], "a tool result names no call"),
    ],
)
def test_contexts(spark, turns, error):
    assert [r["error"] for r in messages.context_errors(context(spark, turns), "k").collect()] == ([error] if error else [])


def test_message_edits_refuse_ranges(spark):
    df = spark.createDataFrame([([("user", "a"), ("assistant", "b")],)], f"m array<{messages.MESSAGE}>")
    m = F.col("m")
    one = lambda c: df.select(c.alias("x")).first()["x"]
    assert one(messages.remove_range(m, F.lit(1), F.lit(2))) is None and one(messages.remove_range(m, F.lit(-1), F.lit(1))) is None
    assert one(messages.insert_at(m, F.lit(3), m)) is None and len(one(messages.insert_at(m, F.lit(2), m))) == 4
    assert [x["content"] for x in one(messages.move_range(m, F.lit(0), F.lit(1), F.lit(1)))] == ["b", "a"]
    assert one(messages.next_call_id(F.array(F.lit("call_0001"), F.lit("call_0003")))) == "call_0002"
    assert one(messages.flatten_blocks(F.array(F.struct(F.lit("text").alias("type"), F.lit("x").alias("text")), F.struct(F.lit("image_url").alias("type"), F.lit(None).cast("string").alias("text"))))) == "x\n\n[image]"


def test_tool_results_follow_their_calls(spark):
    df = spark.createDataFrame([(["b", "a"], [("a", 1), ("b", 2), ("z", 3)])], "calls array<string>, results array<struct<tool_call_id:string,n:int>>")
    assert [r["n"] for r in df.select(messages.order_results(F.col("calls"), F.col("results")).alias("r")).first()["r"]] == [2, 1, 3]


def test_templates(spark):
    df = spark.createDataFrame([("{b}", None)], "a string, b string")
    filled = lambda t: df.select(messages.fill_template(t, {"a": F.col("a"), "b": F.col("b")}).alias("x")).first()["x"]
    assert filled("x {a} [[y {b}]]{c}") == "x {b} {c}" and filled("[[z {a}]]") == "z {b}"
    messages.check_template("{a} [[{b}]]", ("a",), ("b",))
    for bad in ("", "[[a", "[[ [[ ]] ]]", "{x}"):
        with pytest.raises(RowError):
            messages.check_template(bad, (), ("a",))
    with pytest.raises(RowError):
        messages.check_format(df, "preference")


# pairs and profiles


def test_pairs_are_positional(spark):
    side = lambda *r: spark.createDataFrame(list(r), "i long, k string")
    a, b = side((0, "q"), (1, "q"), (2, "x")), side((0, "q"), (1, "y"), (2, "q"), (3, "q"))
    assert sorted((r["chosen"]["i"], r["rejected"]["i"]) for r in pairs.align(a, b, "k", "i").collect()) == [(0, 0), (1, 2)]
    assert sorted((r["side"], r["i"]) for r in pairs.unmatched(a, b, "k", "i").collect()) == [("chosen", 2), ("rejected", 1), ("rejected", 3)]
    with pytest.raises(RowError):
        pairs.align_strict(a, b, "k", "i")


def test_spans_and_offsets(spark):
    offsets = spark.createDataFrame([(1, o) for o in (0, 3, 5, 9)], "d int, offset int")
    spans = spark.createDataFrame([(1, 3, 9), (1, 20, 30)], "d int, start int, end int")
    assert sorted((r["start"], r["n_tokens"]) for r in pairs.tokens_in_spans(offsets, spans, "d").collect()) == [(3, 2), (20, 0)]


def test_duplicates_conflicts_and_the_fingerprint(spark):
    df = spark.createDataFrame([(0, "p", "a", "b"), (1, "p", "b", "a"), (2, "p", "a", "b"), (3, "p", "c", "c")], "i long, prompt string, chosen string, rejected string")
    groups = profile.duplicates(df, profile.row_digest("prompt", "chosen", "rejected"), "i").collect()
    assert [(r["n_rows"], r["rows"]) for r in groups] == [(2, [0, 2])]
    assert [(r["a"], r["b"], r["n_rows"]) for r in profile.conflicting_preferences(df, "prompt", "chosen", "rejected").collect()] == [("a", "b", 3)]
    assert profile.identical_preferences(df, "chosen", "rejected").count() == 1
    value = lambda d, *c: profile.fingerprint(d, "i", *c).first()["fingerprint"]
    assert value(df, "prompt", "chosen") == value(df.repartition(3), "chosen", "prompt") != value(df.withColumn("i", -F.col("i")), "prompt", "chosen")


@pytest.mark.parametrize("n", [1, 9, 10, 11, 20])
def test_ninetieth_percentile_rule(spark, n):
    got = profile.length_summary(spark.range(n), F.col("id")).first()
    assert got["p90"] == min(n - 1, int(0.9 * n)) and got["count"] == n


def test_token_columns(spark):
    df = spark.createDataFrame([([1, 2, 3, 4], [0, 1, 1, 1])], "ids array<int>, mask array<int>")
    one = lambda c: df.select(c.alias("x")).first()["x"]
    assert one(profile.kept_window(F.col("ids"), 2, "keep_start")) == [1, 2] and one(profile.kept_window(F.col("ids"), 2, "keep_end")) == [3, 4]
    s = one(profile.shifted(F.col("ids"), F.lit(2)))
    assert (s["input_ids"], s["labels"]) == ([1, 2, 3], [-100, 3, 4])
    assert one(profile.folded_labels(F.col("ids"), F.col("mask"))) == [-100, 2, 3, 4]
    assert one(profile.document_starts(F.array(F.lit(2), F.lit(3), F.lit(1)))) == [0, 2, 5]
    assert one(profile.loss_positions(F.col("ids"), F.array(F.lit(0), F.lit(2)))) == 2
    assert one(series.windows(F.col("ids"), 2)) == [[1, 2], [2, 3], [3, 4]] and one(series.windows(F.slice("ids", 1, 1), 3)) == []
    assert one(profile.response_log_prob(F.array(F.lit(-1.0), F.lit(-3.0)), F.lit(2))) == -3.0
    assert one(profile.starts_with(F.col("ids"), F.slice("ids", 1, 2))) and one(profile.with_end(F.lit("a"), "$")) == "a$" == one(profile.with_end(F.lit("a$"), "$"))
    assert tuple(one(profile.preview(F.col("ids"), 2))) == (4, [1, 2])


def test_nonfinite_metrics_are_errors(spark):
    df = spark.createDataFrame([({"a": 1.0},), ({"a": float("nan")},)], "m map<string,double>")
    with pytest.raises(Exception, match="nonfinite"):
        profile.metric_means(df, "m").collect()


def test_type_conflicts(spark):
    df = spark.createDataFrame([(0, '{"a": 1, "b": "x"}'), (1, '{"a": "1", "b": null}'), (2, '{"a": 2.5}')], "i long, j string")
    assert [(r["path"], r["kinds"]) for r in profile.type_conflicts(df, "j", "i").collect()] == [("a", ["number", "string"])]


def test_budget_and_retention(spark):
    row = profile.batch_budget(spark.createDataFrame([(2, 4, 3, 8, 100, 5, 1)], "devices int, per_device int, accumulation int, generations int, n_rows int, warmup int, epochs int")).first()
    assert (row["effective_batch"], row["prompts_per_batch"], row["dropped_rows"], row["updates_per_epoch"], row["warmup_too_long"]) == (24, 3, 4, 5, True)
    a, b = (spark.createDataFrame(x, "s int, t int") for x in ([(1, 3), (1, 2), (2, 4)], [(1, 5), (2, 3)]))
    assert [(r["s"], r["before"], r["after"]) for r in profile.retention(a, b, "s", "t").collect()] == [(2, 4, 3)]


# routing and numbers


def test_routing_ties_and_masks(spark):
    df = spark.createDataFrame([(0, [0, 1], [0.5, 0.5], True), (0, [2, 1], [0.9, 0.1], True), (0, [3, 3], [9.0, 9.0], False)], "layer int, indices array<int>, weights array<double>, token_mask boolean")
    total = routing.scores(routing.totals(routing.exploded(df, "layer")), 2)
    assert {r["expert"]: (r["slots"], r["token_score"]) for r in total.collect()} == {0: (1, 0.25), 1: (2, 0.5), 2: (1, 0.25)}
    assert [r["expert"] for r in routing.select_top_p(total, 0.6).orderBy("expert").collect()] == [0, 1]
    assert [r["expert"] for r in routing.select_per_rank(total, 1, 2, 4).orderBy("expert").collect()] == [1, 2]


def test_exponents_are_exact():
    x = np.array([0, 2.0**-149, 2.0**-127, 2.0**-126, 0.75, 1, 1.0000001, 2, 448], np.float32)
    floor, ceiling = quantize.exponents(x)
    assert floor.tolist() == [-127, -127, -127, -126, -1, 0, 0, 1, 8] and ceiling[[0, 1, 2, 3, 4, 5, 6, 7, 8]].tolist() == [-127, -126, -126, -126, 0, 0, 1, 1, 9]


def test_fp4_codes():
    grid = np.array([0, 0.5, 1, 1.5, 2, 3, 4, 6, -0.0, -0.5, -6, 0.25, 0.75, 2.5, 5, -0.2] * 2, np.float32)
    codes, scale = quantize.fp4_groups(grid)
    assert codes.reshape(-1)[:16].tolist() == [0, 1, 2, 3, 4, 5, 6, 7, 8, 9, 15, 0, 2, 4, 6, 8] and scale.tolist() == [0]
    assert quantize.unpack_nibbles(quantize.pack_nibbles(codes)).tolist() == codes.reshape(-1).tolist()
    wide = np.zeros(32, np.float32)
    wide[0] = 7.9
    assert quantize.fp4_groups(wide)[1].tolist() == [0] and quantize.fp4_groups(wide, "min_error")[1].tolist() == [1]
    assert quantize.fp4_groups(np.zeros(32, np.float32))[1].tolist() == [-127]
    with pytest.raises(ValueError):
        quantize.fp4_groups(np.full(32, np.nan, np.float32))
    q, e = quantize.fp8_block(np.array([448.0, 1.0, 0.3], np.float32))
    assert e == 0 and q.tolist() == pytest.approx([448, 1, 0.3125])


# texts


def test_chunks():
    assert list(chunking.chunks("a b.\n\nc d.\n \n\ne", 3)) == ["a b.\n\nc d.", "e"]
    assert list(chunking.chunks("One two. Three four! Five", 3)) == ["One two.", "Three four", "! Five"]
    assert list(chunking.chunks(" \n\n ", 5)) == []
    assert "".join(chunking.chunks("x" * 100, 4)).replace(" ", "").replace("\n", "") == "x" * 100


def test_wrapped_and_best_fit(spark):
    df = spark.createDataFrame([(0, 5, 0), (1, 9, 0), (2, 0, 0), (3, 2, 0)], "i long, n long, b long")
    got = sorted(tuple(r) for r in chunking.wrapped(df, "i", "n", 8).collect())
    assert got == [(0, 0, 0, 0, 5), (1, 0, 0, 5, 3), (1, 1, 1, 0, 6), (3, 0, 1, 6, 2)]
    bins = {r["i"]: r["bin"] for r in chunking.best_fit_decreasing(df, "b", "i", "n", 8).collect()}
    assert bins[0] == bins[3] != bins[1]


@pytest.mark.parametrize(
    ("line", "last", "want", "n", "failed"),
    [
        ('{"a": 1,}', False, ['{"a": 1}'], 1, False),
        ("{'a': 'it\\'s \"x\"'}", False, ['{"a": "it\'s \\"x\\""}'], 1, False),
        ("{a: True, isNone: None}", False, ['{"a": true, "isNone": null}'], 2, False),
        ('{"a": 1} {"b": 2}', False, ['{"a": 1}', '{"b": 2}'], 1, False),
        ('{"a": [1, {"b": 2', False, ['{"a": [1, {"b": 2}]}'], 1, False),
        ('{"a": 1,', True, ['{"a": 1}'], 2, False),
        ('{"a": "cut', True, [], 1, False),
        ('{"a": "cut', False, ['{"a": "cut'], 0, True),
        ('{"a": ', True, [], 1, False),
        ('{"a": }', True, ['{"a": }'], 0, True),
        ('{"a": ]', False, ['{"a": ]'], 0, True),
        ("   ", False, ["   "], 0, False),
        ('{"True": "None, x:"}', False, ['{"True": "None, x:"}'], 0, False),
    ],
)
def test_repairs(line, last, want, n, failed):
    lines, repairs, error = repair.heal_line(line, last)
    assert (lines, len(repairs), error is not None) == (want, n, failed)


def test_repaired_document():
    text, repairs, error = repair.heal_document("[{a: 1,}, {'b': False}")
    assert json.loads(text) == [{"a": 1}, {"b": False}] and len(repairs) == 5 and error is None
    assert json.loads(repair.heal_document('{"a": 1}\n{"b": 2}')[0]) == [{"a": 1}, {"b": 2}]


def test_derived_edits_reproduce():
    rng = np.random.default_rng(1)
    for _ in range(300):
        old = "".join(rng.choice(list("abc ")) for _ in range(rng.integers(1, 60)))
        new = "".join(c for c in old if rng.random() > 0.1) + "x" * int(rng.integers(0, 2))
        made, at = [], 0
        spans = sorted((old.index(a), a, b) for a, b in edits.derived(old, new))
        for place, a, b in spans:
            assert old.count(a) == 1 and place >= at
            made += [old[at:place], b]
            at = place + len(a)
        assert "".join(made) + old[at:] == new


def test_span_labels(spark):
    labels = [("answer", "ab cd", "cd", "hedge", "why", False), ("answer", "cd ef", "ef", "hedge", "why", False), ("reasoning", "x", "x", "beyond-prompt", "why", False), ("answer", "zz", "zz", "hedge", "why", False), ("answer", "gh", "gh", "odd", "why", False), ("answer", "gh", "gh", "hedge", " ", False)]
    df = spark.createDataFrame(labels, "field string, span string, waste string, category string, reason string, retained boolean").withColumn("text", F.lit("ab cd ef gh x"))
    faults = {(r["span"], r["category"], r["reason"]): r["fault"] for r in edits.locate(df, "text").collect()}
    assert [f is not None for f in faults.values()].count(True) == 5 and faults[("cd ef", "hedge", "why")] is None
    good = edits.locate(df.filter("span = 'ab cd'"), "text")
    assert [tuple(e) for e in edits.removals(good).first()["edits"]] == [("ab cd", "ab ")]
    report = edits.waste_report(good, F.array(F.lit(0), F.lit(3), F.lit(4), F.lit(6)), 4, 100).first()
    assert (report["removed"], report["share"], report["remaining"]) == (2, 0.5, 2)


HTML = '<body><h2 id="a">A</h2><p>one<h3>in</h3>two<h2 id="b">B</h2><p>x</p><dl><dt id="t">T¶<dd>def</dl><section id="s">own<section id="i">inner</section>end</section><div id="d">k<b id="e">out</b>l  \n\n\n\nm</div></body>'


def test_markup():
    root = markup.parse(HTML)
    assert markup.by_id(root, "a") == "A\none\nintwo" and markup.by_id(root, "e") == "outl  \n\n\n\nm"
    assert markup.definition(root, "t") == "T\ndef"
    assert markup.section(root, "s") == "owninnerend" and markup.section(root, "s!") == "ownend"
    assert markup.clause(root, "d,e") == "kl\n\nm"
    with pytest.raises(ValueError):
        markup.by_id(root, "none")
    anchored = markup.anchored(markup.parse('<a id="section-1">1</a> text<span class="grey">page</span><a id="section-2">2</a>more'))
    assert anchored == {"section-1": "1 text", "section-2": "2more"}


def test_markdown():
    text = "# A\nx\n```py\n# no\n```\n``` one ```\n## B\ny\n# C"
    assert [(s[0], s[1], s[2], s[3]) for s in markup.markdown_sections(text)] == [("A", 1, 0, 8), ("B", 2, 6, 8), ("C", 1, 8, 9)]
    with pytest.raises(ValueError):
        markup.markdown_sections("# A\n# A")


# scores


def test_strict_and_lenient_json(spark):
    for bad in ('{"a": 1, "a": 2}', "NaN", "1e999", '{"a": 1} x', ""):
        with pytest.raises(ValueError):
            quality.strict_json(bad)
    df = spark.createDataFrame([(' {"a": NaN, "a": 1} ',), ('{"a": 1} x',), ("[1]",)], "t string")
    assert [r[0] for r in df.select(rewards.json_valid(F.col("t"))).collect()] == [1.0, 0.0, 1.0]
    assert [r[0] for r in df.select(rewards.json_valid(F.col("t"), ["a"])).collect()] == [1.0, 0.0, 0.0]


def test_json_equality():
    assert quality.same_json({"a": [1, {"b": 1.0}]}, {"a": [1.0, {"b": 1}]})
    for a, b in ((True, 1), ([1, 2], [2, 1]), ({"a": None}, {}), ("1", 1)):
        assert not quality.same_json(a, b)


def test_labels_and_answers():
    assert quality.score_label(" Final answer: (B). ", ["A", "B"], "b", True)["score"] == 1.0
    assert quality.score_label("A or B", ["A", "B"], "A")["ambiguous"] == 1.0
    assert quality.score_answer("the state-of-the-art", ["state of the art", "x"])["score"] == pytest.approx(8 / 9)
    assert quality.score_json('{"a": true}', ["a", "b"], {"a": 1}) == {"score": 0.0, "json_valid": 1.0, "required": 0.5, "reference": 0.0}
    assert quality.label_key("ﬁ  Straße") == "fi strasse"


@pytest.mark.parametrize(
    ("preset", "row", "good"),
    [
        ("language_modeling", {"text": "x"}, True),
        ("language_modeling", {"text": "x", "messages": []}, False),
        ("language_modeling", {"prompt": "x", "completion": [{"role": "assistant", "content": "y"}]}, False),
        ("qa", {"prompt": "q", "answers": ["a", "b"]}, True),
        ("qa", {"prompt": "q", "answer": "!!"}, False),
        ("qa", {"prompt": "q", "messages": [{"role": "user", "content": "x"}], "answer": "a"}, False),
        ("classification", {"prompt": "q", "label": "A", "labels": ["a", "b"]}, True),
        ("classification", {"prompt": "q", "label": "a", "labels": ["a", "A "]}, False),
        ("multiple_choice", {"prompt": "q", "answer": "A", "choices": {"A": "x", "B": "y"}}, True),
        ("multiple_choice", {"prompt": "q", "answer": "C", "choices": {"A": "x", "B": "y"}}, False),
        ("json", {"prompt": "q", "required_fields": ["a"], "reference": {"a": 1}}, True),
        ("json", {"prompt": "q", "required_fields": ["a", "a"]}, False),
        ("preference", {"chosen": "a", "rejected": "b"}, True),
        ("preference", {"chosen": "a", "rejected": [{"role": "user", "content": "x"}]}, False),
        ("writing", {"prompt": "q"}, True),
        ("writing", {"prompt": " "}, False),
        ("unknown", {}, False),
    ],
)
def test_presets(preset, row, good):
    assert (quality.row_fault(preset, row) is None) == good


def test_judge_replies():
    reply = {"score": 0.5, "criteria": dict.fromkeys(quality.CRITERIA, 0.5), "rationale": "ok"}
    assert quality.judge_reply(json.dumps(reply))["score"] == 0.5
    for change in ({"score": 0.6}, {"rationale": ""}, {"criteria": {}}, {"extra": 1}, {"score": True}):
        with pytest.raises(ValueError):
            quality.judge_reply(json.dumps(reply | change))


def test_rewards(spark):
    df = spark.createDataFrame([("The answer is 42.", "42")], "t string, r string")
    one = lambda c: df.select(c.alias("x")).first()["x"]
    assert one(rewards.regex(F.col("t"), r"(\d+)", 1, F.col("r"))) == 1.0 and one(rewards.regex(F.col("t"), "^b")) == 0.0
    assert one(rewards.reference_match(F.col("t"), F.col("r"), "contains")) == 1.0
    assert one(rewards.phrases(F.col("t"), ["ANSWER", "no"], ["42"])) == -0.5
    assert one(rewards.length_window(F.lit(14), 2, 10)) == 0.5 and one(rewards.judged(F.lit("about -1.5, or 3"))) == -1.5
    assert rewards.resolve("phrases") is rewards.phrases and rewards.resolve("math:sqrt") is math.sqrt
    for wrong in (lambda: rewards.phrases(F.col("t")), lambda: rewards.resolve("none"), lambda: rewards.reference_match(F.col("t"), F.col("r"), "fuzzy")):
        with pytest.raises(ValueError):
            wrong()


# endpoints


def test_retries():
    tries, waits = [], []

    def client(request):
        tries.append(request)
        raise endpoint.EndpointError("busy", 503 if len(tries) < 3 else 400)

    with pytest.raises(endpoint.EndpointError):
        endpoint.with_retries(client, 5, 1.0, waits.append)("r")
    assert len(tries) == 3 and waits == [1.0, 2.0]
    assert endpoint.redacted("key sk-1 here", "sk-1", "") == "key [redacted] here"


def test_requests_keep_their_rows(spark):
    def echo(request):
        return {"content": request[-1]["content"].upper(), "reasoning_content": "because"}

    df = spark.createDataFrame([(i, f"text {i}") for i in range(20)], "i long, t string").repartition(3)
    out = endpoint.summaries(df, "i", "t", echo, "say {text}")
    assert {r["i"]: (r["content"], r["reasoning"]) for r in out.collect()} == {i: (f"SAY TEXT {i}", "because") for i in range(20)}
    with pytest.raises(RowError):
        endpoint.summaries(df.union(spark.createDataFrame([(99, " ")], "i long, t string")), "i", "t", echo, "{text}")


# files and streams


@pytest.mark.parametrize("kind", ["jsonl", "json", "csv", "parquet"])
def test_formats_round_trip(spark, kind):
    path = f"{scratch(spark, 'f')}.{kind}"
    df = spark.createDataFrame([("hello, \"x\"\ny",), ("é",)], "value string")
    files.write_rows(df, path)
    assert sorted(r["value"] for r in files.read_rows(spark, path).collect()) == ["hello, \"x\"\ny", "é"]
    with pytest.raises(RowError):
        files.write_rows(df, path)
    files.write_rows(df.limit(1), path, force=True)
    assert files.read_rows(spark, path).count() == 1


def test_json_object_streams(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('{"a": 1}{"a":\n 2}\n\n{"a": 3}\n')
    out = files.read_json_stream(spark, str(tmp_path / "a.jsonl")).orderBy("record").collect()
    assert [(r["line"], json.loads(r["raw"])["a"]) for r in out] == [(1, 1), (1, 2), (4, 3)]
    for bad in ('{"a": 1} 2', '{"a": 1', '{"a": 1}\x0b{"a": 2}'):
        with pytest.raises(ValueError):
            list(files.json_objects(bad))
    assert sorted(r["a"] for r in files.read_rows(spark, str(tmp_path / "a.jsonl")).collect()) == [1, 2, 3]


def test_file_errors(spark, tmp_path):
    for path in ("none", "x.toml", str(tmp_path / "gone.parquet")):
        with pytest.raises(RowError):
            files.read_rows(spark, path)
    with pytest.raises(RowError):
        files.write_rows(spark.createDataFrame([([1],)], "a array<int>"), str(tmp_path / "n.csv"))
    df = spark.range(1)
    with pytest.raises(RowError):
        files.write_all({str(tmp_path / "a.jsonl"): df, str(tmp_path / "a.jsonl/b.jsonl"): df})


def test_metric_files(spark, tmp_path):
    record = '{"step": %d, "log": {"loss": 1.5}}\n'
    path = tmp_path / "metrics.jsonl"
    path.write_text(record % 1 + "\n" + record % 2 + '{"step": 3, "lo')
    assert [r["step"] for r in files.read_metrics(spark, str(path)).orderBy("seq").collect()] == [1, 2]
    path.write_text(record % 1 + "broken\n" + record % 2)
    with pytest.raises(Exception, match="line 2"):
        files.read_metrics(spark, str(path)).collect()
    (tmp_path / "checkpoint-5").mkdir()
    assert files.run_state(spark, str(tmp_path)) == {"checkpoints": [5], "phase": "training"}


def test_growing_files(spark, tmp_path):
    path = tmp_path / "m.jsonl"
    path.write_text('{"step": 1, "log": {"loss": 2.0}}\n{"step": 2, "lo')
    values = metrics.with_changes(metrics.metric_values(metrics.tail(spark, str(tmp_path / "*.jsonl"))))
    query = values.writeStream.format("memory").queryName("growing").option("checkpointLocation", str(tmp_path / "check")).start()
    try:
        query.processAllAvailable()
        assert [r["value"] for r in spark.table("growing").collect()] == [2.0]
        with open(path, "a") as f:
            f.write('g": {"loss": 0.5}}\n')
        query.processAllAvailable()
        got = {r["step"]: (r["value"], r["change"], r["baseline"]) for r in spark.table("growing").collect()}
        assert got[2] == (0.5, -1.5, 2.0)
    finally:
        query.stop()


def test_nothing_imports_the_llm_folder():
    root = os.path.join(os.path.dirname(__file__), "..", "millrace")
    for folder, _, names in os.walk(root):
        if os.path.basename(folder) not in ("llm", "__pycache__"):
            for name in names:
                if name.endswith(".py"):
                    assert "millrace.llm" not in open(os.path.join(folder, name), encoding="utf-8").read()


def test_token_f1_of_long_texts(spark):
    """Against counters, with repeats, nulls and more words than pairwise comparing could take."""
    import random
    from collections import Counter

    rng = random.Random(3)
    rows = [([str(rng.randrange(m)) for _ in range(n)], [str(rng.randrange(m)) for _ in range(k)]) for m, n, k in ((5, 9, 30), (2, 1, 1), (9, 0, 4), (9, 0, 0), (30000, 40000, 30000))]
    got = spark.createDataFrame(rows, "a array<string>, b array<string>").select(rewards.token_f1(F.col("a"), F.col("b")).alias("f")).collect()
    want = [2 * sum((Counter(a) & Counter(b)).values()) / (len(a) + len(b)) if a or b else 1.0 for a, b in rows]
    assert [round(r["f"], 9) for r in got] == [round(w, 9) for w in want]


def test_choices_are_stripped_before_they_are_looked_up():
    from millrace.functions.quality import Labels

    assert Labels(("yes.", "no")).said("yes.", True) is None and Labels(("yes.", "no")).said("yes.", False) == "yes."
    assert Labels(("option a", "b")).said("option a", True) is None
    b = Labels(("b", "c d"))
    for said in ("b", "b.", "(b)", "b)", "( b ) !", "the final answer is (b).", "answer: b", "option b"):
        assert b.said(said, True) == "b", said
    for said in ("b!!", "((b))", "b or c d", "the b", "answer", ""):
        assert b.said(said, True) is None, said
    assert b.said("answer is c d.", True) == "c d" and b.said("b.", False) is None
