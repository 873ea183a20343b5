"""Best-fit decreasing by runs against one row after the other."""

import random
from collections import Counter

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from millrace.operators import best_fit
from millrace.operators.chunking import Bins
from millrace.operators.rows import RowError


def one_by_one(lengths, size):
    rooms, out = [], []
    for n in sorted(lengths, reverse=True):
        fits = [r for r in rooms if r >= n]
        if fits:
            place = rooms.index(min(fits))
        else:
            place = len(rooms)
            rooms.append(max(size, n))
        rooms[place] -= n
        out.append(place)
    return out


def by_runs(lengths, size):
    out = []
    for run in best_fit.plan(Counter(min(n, size + 1) for n in lengths), size):
        assert run.low == len(out)
        out += [run.first + (i - run.low) // run.each for i in range(run.low, run.high)]
    return out


@settings(max_examples=300, deadline=None)
@given(st.integers(1, 40), st.lists(st.integers(0, 50), max_size=120))
def test_plan_is_the_rule(size, lengths):
    assert by_runs(lengths, size) == one_by_one(lengths, size)


def test_plan_of_many_rows_is_small():
    rng = random.Random(1)
    histogram = {n: rng.randrange(1, 10**9) for n in range(1, 513)}
    runs = best_fit.plan(histogram, 512)
    assert sum(r.high - r.low for r in runs) == sum(histogram.values()) and len(runs) < 4 * 512
    bins = Bins(64)
    lengths = sorted((rng.randrange(1, 70) for _ in range(3000)), reverse=True)
    assert [bins.place(n) for n in lengths] == by_runs(lengths, 64)


def test_rows_find_their_bins(spark):
    rng = random.Random(2)
    rows = [(i, rng.choice([0, 1, 7, 30, 64, 65, 900, rng.randrange(64)])) for i in range(700)]
    df = spark.createDataFrame(rows, "key long, n int").repartition(6)
    order = sorted(rows, key=lambda r: (-r[1], r[0]))
    want = dict(zip((i for i, _ in order), one_by_one([n for _, n in rows], 64)))
    assert {r["key"]: r["bin"] for r in best_fit.best_fit(df, "n", 64, "key").collect()} == want
    pieces = best_fit.best_fit_pieces(df, "key", "n", 64).collect()
    assert {k: sum(r["length"] for r in pieces if r["key"] == k) for k in range(700)} == dict(rows)
    assert max(Counter({b: sum(r["length"] for r in pieces if r["bin"] == b) for b in {r["bin"] for r in pieces}}).values()) <= 64
    cut = sorted((r["length"] for r in pieces), reverse=True)
    assert sorted(r["bin"] for r in pieces) == sorted(one_by_one(cut, 64))


def test_refusals_and_empty_tables(spark):
    assert best_fit.best_fit(spark.createDataFrame([], "key long, n int"), "n", 8, "key").count() == 0
    for bad in ([(1, None)], [(1, -1)]):
        with pytest.raises(RowError):
            best_fit.best_fit(spark.createDataFrame(bad, "key long, n int"), "n", 8, "key")
    with pytest.raises(RowError):
        best_fit.best_fit(spark.createDataFrame([(1, 1)], "key long, n int"), "n", 0, "key")
    assert [r["bin"] for r in best_fit.best_fit(spark.createDataFrame([(1, 0), (2, 0)], "key long, n int"), "n", 8, "key").collect()] == [0, 0]
