"""JSON object streams over split files against one process that reads the whole text."""

import json
import random

import pytest
from pyspark.sql import functions as F

from millrace.operators.rows import RowError
from millrace.sources import files, json_stream


def value(rng, depth=0):
    kind = rng.randrange(7 if depth < 3 else 4)
    if kind == 0:
        return rng.choice([1, -2.5, True, None])
    if kind < 4:
        return "".join(rng.choice(['"', "\\", "{", "}", "a", "é", "\n", " ", "日", "\\\\", "\\\""]) for _ in range(rng.randrange(9)))
    if kind == 4:
        return [value(rng, depth + 1) for _ in range(rng.randrange(4))]
    return {f"k{i}": value(rng, depth + 1) for i in range(rng.randrange(4))}


def stream(rng, n):
    """Text of ``n`` objects, parted and laid out in all ways."""
    out = rng.choice(["", "\n", " \t\r\n"])
    for i in range(n):
        row = {"i": i} | {f"v{k}": value(rng) for k in range(rng.randrange(4))}
        out += json.dumps(row, ensure_ascii=rng.random() < 0.5, indent=rng.choice([None, None, 1, 4])) + rng.choice(["", "\n", "\n\n", " ", "\r\n"])
    return out


@pytest.fixture
def split_small(spark):
    name = "spark.sql.files.maxPartitionBytes"
    before = spark.conf.get(name)

    def to(size):
        spark.conf.set(name, f"{size}b")
        spark.conf.set("spark.sql.files.openCostInBytes", "0")

    yield to
    spark.conf.set(name, before)
    spark.conf.unset("spark.sql.files.openCostInBytes")


@pytest.mark.parametrize("size", [37, 300, 1 << 20])
def test_any_split_gives_the_same_objects(spark, tmp_path, split_small, size):
    rng = random.Random(size)
    want = []
    for k in range(4):
        text = stream(rng, 12 if size < 100 else 60)
        (tmp_path / f"{k}.jsonl").write_bytes(text.encode())
        want += [(f"{k}.jsonl", line, raw) for line, raw in files.json_objects(text)]
    split_small(size)
    found = json_stream.read_objects(spark, f"file://{tmp_path}/*.jsonl")
    got = sorted((r["file"].rsplit("/", 1)[1], r["offset"], r["line"], r["raw"]) for r in found.collect())
    assert [(f, line, raw) for f, _, line, raw in got] == want
    for name, offset, _, raw in got:
        assert (tmp_path / name).read_bytes()[offset:].startswith(raw.encode())
    if size < 1000:
        assert json_stream._pieces(spark, f"file://{tmp_path}/*.jsonl").rdd.getNumPartitions() > 4


@pytest.mark.parametrize("size", [16, 1 << 20])
def test_first_bad_object_is_named(spark, tmp_path, split_small, size):
    cases = {
        '{"a": 1}\n[2]\n': (2, 1, "a record is a list"),
        '{"a": 1}\n\n  3': (3, 3, "a record is a number"),
        '{"a": {"b": 1}}\n{"a": \n {"b":, 1}}\n{"a" 1}\n': (3, 7, "Expecting value"),
        '{"a": {"b": "}"}}\n{"a": {"b": 1}\n': (3, 1, "Expecting ',' delimiter"),
        '{"a": 1}}\n{"b": 2}': (1, 9, "Expecting an object"),
        '{"a": 1}\n{"b': (2, 2, "Unterminated string"),
        '{"a": "x\ny"}': (1, 9, "Invalid control character"),
        "{'a': 1}": (1, 2, "Expecting property name"),
        '﻿{"a": 1} x': None,
    }
    for k, (text, said) in enumerate(cases.items()):
        (tmp_path / f"{k}.jsonl").write_bytes(text.encode())
        split_small(size)
        error = json_stream.first_error(json_stream.found_objects(spark, f"file://{tmp_path}/{k}.jsonl"))
        if said:
            assert error and f"line {said[0]} column {said[1]}: {said[2]}" in error, (text, error)
        else:
            assert error
    (tmp_path / "z.jsonl").write_bytes(b'{"a": "\xff"}')
    with pytest.raises(RowError, match="not UTF-8"):
        files.read_rows(spark, f"file://{tmp_path}/z.jsonl")
    with pytest.raises(RowError, match="line 2 column 1: a record is a list"):
        files.read_rows(spark, f"file://{tmp_path}/0.jsonl")


def test_empty_and_blank_files(spark, tmp_path, split_small):
    (tmp_path / "a.jsonl").write_bytes(b"")
    (tmp_path / "b.jsonl").write_bytes(b" \n\t\n")
    (tmp_path / "c.jsonl").write_bytes(b'{"s": "' + b"{x}" * 4000 + b'", "n": {"m": {}}}')
    split_small(64)  # one object over some hundred splits
    assert [r["line"] for r in json_stream.read_objects(spark, f"file://{tmp_path}/*.jsonl").collect()] == [1]
    with pytest.raises(RowError, match="no rows"):
        files.read_rows(spark, f"file://{tmp_path}/b.jsonl")


def test_one_file_is_read_by_many_tasks(spark, tmp_path, split_small):
    path = tmp_path / "big.jsonl"
    path.write_text("".join(json.dumps({"i": i, "in": {"text": "x" * 50}}, indent=2) + "\n" for i in range(3000)))
    split_small(20_000)
    rows = files.read_rows(spark, f"file://{path}")
    assert rows.agg(F.sum("i"), F.count("*")).first() == (3000 * 2999 // 2, 3000)
    assert json_stream._pieces(spark, f"file://{path}").rdd.getNumPartitions() > 8


def test_columns_and_rows_in_the_order_of_the_file(spark, tmp_path, split_small):
    rows = [{"z": i, "n": {"b": 1}} if i < 40 else {"m": 1, "a b": "x", "z": i} for i in range(90)]
    (tmp_path / "a.jsonl").write_text("".join(json.dumps(r, indent=1) + "\n" for r in rows))
    split_small(100)  # objects cross splits
    df = files.read_rows(spark, f"file://{tmp_path}/a.jsonl", first_seen=True)
    assert df.columns == ["z", "n", "m", "a b"]
    assert [r["z"] for r in df.collect()] == list(range(90))
    files.write_rows(df.drop("n").limit(2), f"file://{tmp_path}/out.csv")
    assert files.read_rows(spark, f"file://{tmp_path}/out.csv").columns == ["z", "m", "a b"]
    split_small(1 << 20)  # fewer splits than were scanned
    with pytest.raises(Exception, match="read it again"):
        df.filter("z >= 0").collect()
