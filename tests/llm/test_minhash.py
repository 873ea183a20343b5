"""The multi-index Hamming join against all pairs."""

import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

pytest.importorskip("public_tokenizers")
from millrace.llm import minhash_join as m  # noqa: E402
from millrace.llm.word_hashes import shingle_sets  # noqa: E402

SCHEMA = "doc_id long, text string"


def plain(rows, size, threshold):
    sets, root = {}, {}
    out = []
    for i, text in rows:
        if i is None:
            continue
        words = re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode().lower())
        grams = {tuple(words[k : k + size]) for k in range(max(1, len(words) - size + 1))} if words else set()
        sets.setdefault(i, []).append(grams)
        root.setdefault(i, i)
        out.append((i, len(grams)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    ids = sorted(sets)
    for a, i in enumerate(ids):
        for j in ids[a + 1 :]:
            if find(i) != find(j) and any(s and t and 100 * len(s & t) >= threshold * len(s | t) for s in sets[i] for t in sets[j]):
                x, y = sorted((find(i), find(j)))
                root[y] = x
    return sorted((i, n, find(i)) for i, n in out)


def got(df, size, threshold):
    classes, links = m.minhash_components(df, size, threshold)
    return sorted(tuple(r)[:3] for r in classes.collect()), links


def near_copies(rng):
    base = [f"w{rng.randrange(4000)}" for _ in range(150)]
    rows = []
    for i in range(220):  # edits around the threshold: some are linked with many, some with none
        words = list(base)
        for _ in range(rng.randrange(0, 9)):
            words[rng.randrange(len(words))] = f"x{rng.randrange(9999)}"
        rows.append((i, " ".join(words)))
    return rows


def test_classes_of_near_copies(spark):
    rng = random.Random(7)
    rows = near_copies(rng)
    rows += [(1000 + i, "copied text of seven words or so") for i in range(90)] + [(2000 + i, f"word{i}") for i in range(20)]
    for i in range(60):
        words = [f"v{rng.randrange(9000)}" for _ in range(rng.randrange(1, 400))]
        rows += [(3000 + 2 * i, " ".join(words)), (3001 + 2 * i, " ".join(w.upper() if rng.random() < 0.5 else w for w in words) + " tail" * (i % 2))]
    rows += [(5000, None), (5001, ""), (5002, " \t\n"), (5003, None), (None, "copied text of seven words or so"), (None, None), (6000, "Two words"), (6001, "two words"), (6002, "two")]
    rows += [(7000, "one id of two texts"), (7000, "copied text of seven words or so"), (7001, "one id of two texts"), (7001, "one id of two texts")]
    docs = spark.createDataFrame(rows, SCHEMA).withColumn("doc", F.lit("own")).withColumn("root", F.lit(0)).repartition(7)
    for size, threshold in ((3, 85), (5, 80)):
        assert got(docs, size, threshold)[0] == plain(rows, size, threshold)


def test_blocks_of_a_large_group(spark, monkeypatch):
    rows = near_copies(random.Random(8))
    monkeypatch.setattr(m, "BLOCK", 30)
    monkeypatch.setattr(m, "PART_ROWS", 500)
    monkeypatch.setattr(m, "ORDERS", 1)
    assert got(spark.createDataFrame(rows, SCHEMA), 3, 85)[0] == plain(rows, 3, 85)


def test_empty_tables(spark):
    found, links = got(spark.createDataFrame([], SCHEMA), 3, 85)
    assert found == [] and links.count() == 0
    assert got(spark.createDataFrame([(1, None), (2, "")], SCHEMA), 3, 85)[0] == [(1, 0, 1), (2, 0, 2)]
    docs = spark.createDataFrame([(1, "a b c d e f"), (2, "a b c d e f"), (None, "a b c d e f"), (3, "z")], SCHEMA).withColumn("gone", F.lit(1))
    assert sorted((r["doc_id"] or 0) for r in m.one_of_each(docs).collect()) == [0, 1, 3]


def test_every_pair_within_the_distance_shares_a_key():
    rng = np.random.default_rng(9)
    bound = m.distance_bound(85)
    starts = m.chunk_starts(bound)
    assert 38 <= bound <= 42 and 2 * len(starts) > bound
    one = rng.integers(0, 256, (400, m.PLACES), dtype=np.uint8)
    two = one.copy()
    for k, row in enumerate(two):
        places = rng.choice(m.PLACES, k % (bound + 1), replace=False)
        row[places] ^= rng.integers(1, 256, len(places), dtype=np.uint8)
    same = m.chunk_keys(one, starts) == m.chunk_keys(two, starts)
    assert same.any(axis=1).all()
    assert (m.first_slot(one != two, starts) == np.argmax(same, axis=1)).all()
    other = rng.integers(0, 256, (400, m.PLACES), dtype=np.uint8)
    assert (m.first_slot(one != other, starts) == -1).all() and not (m.chunk_keys(one, starts) == m.chunk_keys(other, starts)).any()


def test_bounds_of_signature_and_sketch():
    rng = random.Random(10)
    far = []
    for _ in range(300):
        a = {rng.getrandbits(64) for _ in range(rng.randrange(40, 400))}
        b = set(a)
        while 100 * len(a & b) >= 85 * len(a | b):
            last = set(b)
            b = b - {rng.choice(sorted(b))} if rng.random() < 0.5 else b | {rng.getrandbits(64)}
        x, y = (np.array(sorted(s), np.uint64) for s in (a, last))
        bits = int(np.bitwise_count(m.sketch(x) ^ m.sketch(y)).sum())
        assert bits <= len(a ^ last) and bits * 185 <= (len(x) + len(y)) * 15
        far.append(int((m.signature(x) != m.signature(y)).sum()))
    assert max(far) <= m.distance_bound(85) and 15 < np.mean(far) < 20
    assert m.signature(shingle_sets([b"a b c"], 3)[0]).shape == (m.PLACES,)
