"""Sources, sinks and operators whose inputs are files, long lines or planted faults."""

import hashlib
import json
import os
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from millrace.functions import quality
from millrace.operators import chunking, endpoint, order, pairs, profile, quantize, routing, series
from millrace.operators.rows import RowError
from millrace.session import drop_folder, scratch, settle, unsettle
from millrace.sources import files
from millrace.streaming import metrics


def put(folder, name, text):
    os.makedirs(folder, exist_ok=True)
    with open(os.path.join(folder, name), "wb") as f:
        f.write(text if isinstance(text, bytes) else text.encode())
    return "file://" + os.path.join(folder, name)


# sources


def test_objects_are_read_by_lines(spark, tmp_path):
    path = put(str(tmp_path), "a.jsonl", '{"a": 1}\n\n{"a": 2} {"a": 3}\n  {"a": 4}')
    assert sorted(json.loads(r["raw"])["a"] for r in files.read_json_objects(spark, path).collect()) == [1, 2, 3, 4]
    plan = files.read_json_objects(spark, path)._jdf.queryExecution().executedPlan().toString()
    assert "text" in plan.lower() and "binaryFile" not in plan


def test_objects_that_span_lines_are_read_whole(spark, tmp_path):
    path = put(str(tmp_path), "b.jsonl", '{"a":\n 1}\n{"a": 2}{"a": 3}')
    assert sorted(r["a"] for r in files.read_rows(spark, path).collect()) == [1, 2, 3]
    with pytest.raises(RowError, match="cannot read"):
        files.read_rows(spark, put(str(tmp_path), "c.jsonl", '{"a": 1}\n[2]\n{"a":\n3}'))


def test_tensors_are_read_by_range(spark, tmp_path):
    payloads = {"x": b"abcdefgh" * 100, "y": b"", "z": b"\x00\xff" * 7}
    head, at = {"__metadata__": {}}, 0
    for name, data in payloads.items():
        head[name] = {"dtype": "U8", "shape": [len(data)], "data_offsets": [at, at + len(data)]}
        at += len(data)
    raw = json.dumps(head).encode()
    path = put(str(tmp_path), "m.safetensors", len(raw).to_bytes(8, "little") + raw + b"".join(payloads.values()))
    got = {r["name"]: r["digest"] for r in files.tensor_headers(spark, path, most=64).collect()}
    assert got == {k: hashlib.sha256(v).hexdigest() for k, v in payloads.items()}


# sinks


def test_all_destinations_are_checked_first(spark, tmp_path):
    first, second = (f"file://{tmp_path}/{n}.jsonl" for n in "ab")
    files.write_rows(spark.range(2).toDF("a"), second)
    with pytest.raises(RowError, match="exists"):
        files.write_all({first: spark.range(3).toDF("a"), second: spark.range(3).toDF("a")})
    assert not os.path.exists(first.removeprefix("file://"))
    with pytest.raises(RowError, match="way"):
        files.write_all({f"file://{tmp_path}/x.parquet": spark.range(1), f"file://{tmp_path}/x.parquet/y.parquet": spark.range(1)})
    with pytest.raises(RowError, match="nested"):
        files.write_all({first: spark.range(1), f"file://{tmp_path}/n.csv": spark.range(1).select(F.array("id").alias("l"))})
    assert not os.path.exists(first.removeprefix("file://"))


def test_a_late_destination_is_refused(spark, tmp_path, monkeypatch):
    path = f"file://{tmp_path}/late.parquet"
    seen = []

    def refuse(session, target, force, known=files._refuse_existing):
        known(session, target, force)
        if not seen:  # another writer comes between the check and the end
            seen.append(session.range(1).write.parquet(target))

    monkeypatch.setattr(files, "_refuse_existing", refuse)
    with pytest.raises(RowError, match="exists"):
        files.write_rows(spark.range(5), path)
    assert spark.read.parquet(path).count() == 1
    assert [n for n in os.listdir(tmp_path) if n.startswith("late")] == ["late.parquet"]


def test_settled_tables_go(spark):
    df = settle(spark.range(3), "three")
    path = df.settled_at.removeprefix("file://")
    assert os.path.isdir(path) and df.count() == 3
    unsettle(df)
    assert not os.path.exists(path)


# streams


def test_lines_longer_than_a_read_are_not_lost(spark, tmp_path):
    long = "x" * 500
    put(str(tmp_path), "m.jsonl", f"{long}\nshort\n{long}")
    reader = metrics.TailReader(f"{tmp_path}/*.jsonl", 64)
    lines, offset = [], {}
    for _ in range(10):
        rows, offset = reader.read(offset)
        lines += [r[2] for r in rows]
    assert lines == [long, "short"]


def test_throttle_and_silence(spark):
    rows = spark.createDataFrame([("a", 0.0, 1), ("a", 0.4, 2), ("a", 1.2, 3), ("b", 9.0, 1)], "s string, at double, n long")
    folder = scratch(spark, "throttle")
    rows.write.parquet(folder + "/in")
    source = spark.readStream.schema("s string, at double, n long").parquet(folder + "/in")
    query = metrics.throttled(source, "s", "at", "n").writeStream.format("memory").queryName("throttled").start()
    query.processAllAvailable()
    query.stop()
    assert {(r["source"], r["at"]) for r in spark.table("throttled").collect()} == {("a", 0.0), ("a", 1.2), ("b", 9.0)}
    drop_folder(spark, folder)


# endpoint


def test_bodies_are_kept_before_parsing(spark):
    def client(request):
        return "<html>" if "bad" in request[-1]["content"] else json.dumps({"choices": [{"message": {"content": "yes", "reasoning_content": "why"}}]})

    rows = spark.createDataFrame([(1, "good"), (2, "bad")], "id long, q string").withColumn("request", endpoint.user_request(F.col("q")))
    bodies = endpoint.complete_raw(rows, "id", "request", client)
    assert {r["id"]: r["body"][:1] for r in bodies.collect()} == {1: "{", 2: "<"}
    assert {(r["id"], r["content"], r["reasoning"], r["fault"]) for r in endpoint.parsed_bodies(bodies, "id").collect()} == {(1, "yes", "why", None), (2, None, None, "not JSON")}


def test_generate_checks_its_settings():
    asked = []

    def client(turns, **settings):
        asked.append((turns, settings))
        return {"content": "c", "reasoning_content": "r"}

    assert endpoint.generate(client, "u", "s", [{"role": "user", "content": "before"}], top_p=0.5, top_k=None) == {"answer": "c", "reasoning": "r"}
    assert asked == [([{"role": "system", "content": "s"}, {"role": "user", "content": "before"}, {"role": "user", "content": "u"}], {"top_p": 0.5})]
    for wrong in ({"top_p": 2}, {"seed": 1}, {"max_tokens": 0}, {"temperature": True}):
        with pytest.raises(RowError):
            endpoint.generate(client, "u", **wrong)
    with pytest.raises(RowError, match="blank"):
        endpoint.generate(client, " ")


# profiles


def test_running_sums_and_ranks(spark):
    rng = random.Random(3)
    rows = [(rng.choice(["a", "b", None]), float(rng.randrange(40))) for _ in range(500)]
    df = spark.createDataFrame(rows, "g string, v double").repartition(7)
    summed = order.running_sum(df.withColumn("one", F.lit(1)), "one", "v", "g")
    assert sorted(r["before"] for r in summed.collect()) == list(range(500))
    found = {r["g"]: r for r in profile.distribution(df, F.col("v"), "g").collect()}
    short = {r["g"]: r for r in profile.length_summary(df, F.col("v"), "g").collect()}
    for g in ("a", "b", None):
        values = np.array([v for k, v in rows if k == g])
        for p in (50, 95, 99):
            assert found[g][f"p{p}"] == pytest.approx(np.percentile(values, p))
        assert short[g]["median"] == np.median(values) and short[g]["p90"] == np.sort(values)[min(len(values) - 1, int(0.9 * len(values)))]
    none = profile.distribution(df.filter("false"), F.col("v")).collect()
    assert len(none) == 1 and none[0]["p50"] is None


def test_digest_in_order_is_that_of_the_pieces(spark):
    df = spark.range(1000).select(F.col("id").alias("o"), F.sha2(F.col("id").cast("string"), 256).alias("d")).repartition(6)
    got = profile.ordered_digest(df, "o", F.unhex("d"), "x").collect()
    want = hashlib.sha256(b"".join(hashlib.sha256(str(i).encode()).digest() for i in range(1000))).hexdigest()
    assert [tuple(r) for r in got] == [(want, 1000)]


def test_first_example(spark):
    df = spark.createDataFrame([(2, [1], [1]), (1, [5, 6, 7], [-100, 6, 7])], "o long, ids array<int>, labels array<int>")
    row = profile.first_example(df, "o", "ids", "labels").first()
    assert (row["tokens"], row["trained_tokens"], row["trained_ids"], row["note"]) == (3, 2, [6, 7], None)


def test_rows_of_duplicates_and_overlaps(spark):
    df = spark.createDataFrame([(1, "a"), (2, "b"), (3, "a")], "i long, t string")
    assert {r["row"] for r in profile.duplicate_rows(df, F.col("t"), "i").collect()} == {1, 3}
    other = spark.createDataFrame([(9, "b"), (8, "c")], "i long, t string")
    assert {(r["side"], r["row"]) for r in pairs.overlap_rows(df, other, "t", "i").collect()} == {("train", 2), ("eval", 9)}


def test_carried_value(spark):
    df = spark.createDataFrame([("a", 1, None), ("a", 2, 0.5), ("a", 3, None), ("b", 1, None)], "r string, s long, v double")
    assert {(r["r"], r["s"]): r["known"] for r in series.carried_forward(df, "r", "s", "v", "known").collect()} == {("a", 1): None, ("a", 2): 0.5, ("a", 3): 0.5, ("b", 1): None}


# packing and numbers


def test_bins_are_the_fullest_that_hold(spark):
    rng = random.Random(2)
    sizes = sorted((rng.randrange(1, 130) for _ in range(300)), reverse=True)
    bins, room = chunking.Bins(100), []
    for n in sizes:
        fits = [i for i, r in enumerate(room) if r >= n]
        want = min(fits, key=lambda i: (room[i], i)) if fits else len(room)
        if want == len(room):
            room.append(max(100, n))
        room[want] -= n
        assert bins.place(n) == want
    rows = spark.createDataFrame([(0, "a", 250), (0, "b", 50), (0, "c", 0)], "batch long, key string, n long")
    cut = chunking.best_fit_split(rows, "batch", "key", "n", 100).collect()
    assert sorted((r["key"], r["start"], r["length"]) for r in cut) == [("a", 0, 100), ("a", 100, 100), ("a", 200, 50), ("b", 0, 50)]
    assert len({r["bin"] for r in cut}) == 3


def test_matrices_go_in_tiles(spark):
    rng = np.random.RandomState(0)
    weight = rng.randn(256, 128).astype(np.float32)
    weight[:128] *= 1000
    codes, exponent = quantize.fp8_tiles(weight)
    assert exponent.shape == (2, 1) and exponent[0, 0] > exponent[1, 0]
    back = quantize.fp8_tile_values(codes, exponent)
    assert (np.abs(back - weight) <= np.abs(weight) / 16 + np.abs(weight).max() * 1e-5).all()
    again = quantize.fp8_tiles(back)
    assert (quantize.fp8_tile_values(*again) == back).all()
    with pytest.raises(ValueError, match="tiles"):
        quantize.fp8_tiles(weight[:100])
    df = spark.createDataFrame([(1, [0.0] * 6), (2, [1.0, 2.0, 3.0, 4.0])], "k long, v array<double>")
    got = {r["k"]: (r["n_exact"], r["n_zero_tiles"], len(r["exponents"])) for r in quantize.fp8_matrix_round_trip(df, "k", "v", 2).collect()}
    assert got == {1: (6, 1, 1), 2: (4, 0, 1)}


def test_selection_faults(spark):
    selected = spark.createDataFrame([(0, 3), (1, 99), (1, -1)], "layer long, expert long")
    found = routing.selection_faults(selected, spark.range(3).toDF("layer"), 64)
    assert {tuple(r) for r in found.collect()} == {(2, None, "no selection"), (1, 99, "no such expert"), (1, -1, "no such expert")}


# labels


@pytest.mark.parametrize(
    ("output", "predicted", "ambiguous"),
    [("(a)", "A", 0.0), ("The final answer is b.", "B", 0.0), ("option  A!", "A", 0.0), ("a)", "A", 0.0), ("(a", None, 0.0), ("a, b", None, 1.0), ("ab", None, 0.0), ("answer: (b )", "B", 0.0), ("option option a", None, 0.0)],
)
def test_choices(output, predicted, ambiguous):
    scored = quality.score_label(output, ["A", "B"], "A", True)
    assert scored["predicted"] == predicted and scored["ambiguous"] == ambiguous and scored["invalid"] == float(predicted is None)


def test_labels_that_share_words():
    scored = quality.score_label("in new york or so", ["New York", "York", "New"], "York")
    assert scored["invalid"] == 1.0 and scored["ambiguous"] == 1.0


def test_empty_reference_asks_for_an_object():
    assert quality.score_json("[]", [], {})["reference"] == 0.0 and quality.score_json("{}", [], {})["score"] == 1.0
