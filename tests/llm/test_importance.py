"""Importance resampling against plain Python."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

pytest.importorskip("public_tokenizers")
from millrace.llm import importance  # noqa: E402

SCHEMA = "doc_id long, text string"


def plain(rows, target, percent=5, least=20, buckets=10000):
    def found(text):
        words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        return len(words), [zlib.crc32(" ".join(words[i : i + k]).encode()) % buckets for k in (1, 2, 3) for i in range(len(words) - k + 1)]

    rows = [(i, *found(t)) for i, t in rows]
    s, t = Counter(b for *_, f in rows for b in f), Counter(b for x in target for b in found(x)[1])
    gain = [math.floor(1000 * math.log((t[b] + 1) * (s.total() + buckets) / ((s[b] + 1) * (t.total() + buckets)))) for b in range(buckets)]
    out = []
    for i, n, f in rows:
        weight = sum(gain[b] for b in f)
        h = None if i is None else int(hashlib.sha256(f"42:{i}".encode()).hexdigest()[:8], 16)
        out.append([i, len(f), weight, None if h is None else weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None, n])
    drawn = sum(r[5] >= least for r in out) * percent // 100
    able = sorted((r for r in out if r[5] >= least and r[3] is not None), key=lambda r: (-r[3], r[0]))
    for place, r in enumerate(able[:drawn]):
        r[4] = place + 1
    return sorted((tuple(r[:5]) for r in out), key=repr)


def prose(rng, n):
    return " ".join(rng.choice(["Alpha", "beta,", "élan", "ÉTÉ", "x1", "and", "of", "K", "日本", "w%d" % rng.randrange(400)]) for _ in range(n))


def got(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def test_scores_and_ranks(spark):
    rng = random.Random(3)
    rows = [(i, prose(rng, rng.choice([0, 1, 2, 3, 19, 20, 60]))) for i in range(300)]
    rows += [(400, None), (401, ""), (402, " ,;\n"), (403, "long " + prose(rng, 9000)), (404, "one two"), (404, "one two"), (405, "same words " * 15), (405, "same words " * 15), (None, prose(rng, 40)), (None, None)]
    target = [prose(rng, 30), None, "", "long and short"]
    docs = spark.createDataFrame(rows, SCHEMA).withColumn("rank", F.lit("own")).withColumn("b1", F.lit(0)).repartition(5, "doc_id")
    wanted = spark.createDataFrame([(t,) for t in target], "text string")
    assert got(importance.resampled(docs, wanted)) == plain(rows, target)
    assert got(importance.resampled(docs, wanted, percent=50, least=2)) == plain(rows, target, 50, 2)


def test_blocks_join(spark, monkeypatch):
    monkeypatch.setattr(importance, "BLOCK", 4)
    rng = random.Random(4)
    rows = [(i, prose(rng, i)) for i in range(30)]
    wanted = spark.createDataFrame([("of and",)], "text string")
    assert got(importance.resampled(spark.createDataFrame(rows, SCHEMA), wanted, percent=100)) == plain(rows, ["of and"], 100)


def test_one_shuffle_for_all_words(spark):
    plan = importance.feature_table(spark.createDataFrame([(1, "a b")], SCHEMA), "doc_id", "text", 3, 10000)._jdf.queryExecution().toString()
    physical = plan[plan.index("== Physical Plan") :]
    assert physical.count("Exchange") == 1 and "Python" not in physical and "Arrow" not in physical


def test_empty_tables_and_draw(spark):
    empty = spark.createDataFrame([], SCHEMA)
    texts = spark.createDataFrame([("of and",)], "text string")
    assert importance.resampled(empty, texts).count() == 0
    rows = [(i, "word " * 25) for i in range(40)]
    docs = spark.createDataFrame(rows, SCHEMA).withColumn("rank", F.lit("own"))
    assert got(importance.resampled(docs.select("doc_id", "text"), texts.limit(0))) == plain(rows, [])
    drawn = importance.draw(docs, texts, 10)
    assert drawn.columns == ["doc_id", "text", "rank", "rank_"] and sorted(r["rank_"] for r in drawn.collect()) == [1, 2, 3, 4]
