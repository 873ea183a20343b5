"""The pipeline's stages on a small corpus, and its queries' registration."""

import importlib
import random

import pytest

pytest.importorskip("public_tokenizers")
import corpus_pipeline  # noqa: E402
from millrace.session import scratch  # noqa: E402


def prose(rng, n):
    common = "the of and to in is that was".split()
    return " ".join(rng.choice(common) if rng.random() < 0.3 else "".join(rng.choice("bcdfglmnprst") + rng.choice("aeiou") for _ in range(rng.randint(2, 4))) for _ in range(n))


@pytest.fixture(scope="module")
def folder(spark):
    rng = random.Random(1)
    lines = lambda n: "\n".join(prose(rng, 20) for _ in range(n))
    clean = [(i, lines(6)) for i in range(30)]
    item = prose(rng, 30)
    near = clean[0][1].split()
    for k in range(0, len(near), 60):
        near[k] = "altered"
    rows = [
        *clean,
        (40, clean[1][1]),
        (41, " ".join(near)),
        (42, lines(3) + "\n" + item + "\n" + lines(3)),
        (43, "| " * 200),
        (44, None),
        (45, clean[2][1] + "\n" + clean[3][1].split("\n")[0]),
    ]
    path = scratch(spark, "data")
    docs = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return path


def test_stages(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    names, kept = docs.columns, {}
    for name, stage in corpus_pipeline.STAGES:
        path = scratch(spark, name)
        stage(spark, docs, folder).write.parquet(path)
        docs = spark.read.parquet(path)
        kept[name] = {r["doc_id"] for r in docs.select("doc_id").collect()}
        if name != "sequences":
            assert docs.columns == names
    clean = set(range(30))
    assert kept["quality"] == clean | {40, 41, 42, 45}
    assert kept["lines"] >= clean | {41, 42} and 40 not in kept["lines"]
    assert kept["near_copies"] >= clean and 41 not in kept["near_copies"]
    assert 42 in kept["near_copies"] and 42 not in kept["benchmark"] and kept["benchmark"] >= clean
    assert kept["sequences"] == kept["benchmark"]


def test_run_equals_the_stages(spark, folder):
    out = corpus_pipeline.run(spark, folder)
    assert out.groupBy("sequence_id").sum("length").filter("`sum(length)` > 4096").count() == 0
    assert {r["doc_id"] for r in out.select("doc_id").distinct().collect()} >= set(range(30))


def test_registered():
    entry = importlib.import_module("__spark_entry__")
    names = list(entry.queries())
    for n in range(1, 11):
        assert sum(name.startswith(f"op{n}_") for name in names) == 1
    assert "pipeline" in names and len(corpus_pipeline.STAGES) == 5
