"""Trees of digests against plain hashing."""

import hashlib

import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

import __spark_entry__
from millrace.operators import identity_tree, profile
from millrace.operators.rows import RowError


def plain(digests, fan):
    """{(level, node): (digest, rows)} of row digests in order."""
    level, now, out = 0, [(d, 1) for d in digests], {}
    while True:
        runs = [now[i : i + fan] for i in range(0, len(now), fan)]
        now = [(hashlib.sha256(b"".join(bytes.fromhex(d) for d, _ in r)).hexdigest(), sum(n for _, n in r)) for r in runs]
        out |= {(level, i): x for i, x in enumerate(now)}
        if len(now) == 1:
            return out
        level += 1


def rows_of(spark, n):
    return spark.range(n).select(F.col("id").alias("i"), F.sha2(F.col("id").cast("string"), 256).alias("d")).repartition(3)


def nodes_of(df):
    return {(r["level"], r["node"]): (r["digest"], r["n"]) for r in df.collect()}


@pytest.mark.parametrize("n, fan", [(1, 4), (4, 4), (5, 4), (16, 4), (17, 4), (100, 3), (70, 64)])
def test_trees(spark, n, fan):
    digests = [hashlib.sha256(str(i).encode()).hexdigest() for i in range(n)]
    want = plain(digests, fan)
    nodes = identity_tree.tree(rows_of(spark, n), "i", F.col("d"), fan)
    assert nodes_of(nodes) == want
    root = identity_tree.root(nodes).first()
    assert (root["fingerprint"], root["n_rows"]) == want[max(want)] and root["levels"] == max(want)[0] + 1


@pytest.mark.parametrize("before, after", [(1, 2), (4, 5), (16, 17), (10, 80), (63, 64), (64, 65)])
def test_rows_that_come_behind_change_the_right_edge(spark, before, after):
    old = identity_tree.tree(rows_of(spark, before), "i", F.col("d"), 4)
    read = rows_of(spark, after).filter(F.col("i") >= before // 4 * 4)  # nothing in front of the edge is needed
    new = identity_tree.appended(old, read, "i", F.col("d"), before, 4)
    assert nodes_of(new) == plain([hashlib.sha256(str(i).encode()).hexdigest() for i in range(after)], 4)


def test_refusals(spark):
    df = rows_of(spark, 3)
    for bad, fan in ((df, 1), (df.limit(0), 4), (df.withColumn("i", F.col("i") - 1), 4), (df.withColumn("i", F.lit(None).cast("long")), 4)):
        with pytest.raises(RowError):
            identity_tree.tree(bad, "i", F.col("d"), fan)


def test_front_to_back_reads_sorted_files(spark):
    df = rows_of(spark, 500).repartition(7)
    want = hashlib.sha256(b"".join(hashlib.sha256(str(i).encode()).digest() for i in range(500))).hexdigest()
    got = profile.ordered_digest(df, "i", F.unhex("d"), "x")
    assert got.first() == (want, 500)
    assert "Sort" not in got._jdf.queryExecution().executedPlan().toString()
    assert profile.ordered_digest(df.limit(0), "i", F.unhex("d"), "x").first() == (hashlib.sha256().hexdigest(), 0)


@pytest.mark.parametrize("name", ["input_tree", "tree_fingerprint"])
def test_queries_past_the_levels_of_their_sql(spark, tmp_path, name):
    duckdb = pytest.importorskip("duckdb")
    n = 16**4 + 300
    docs = pa.table({"doc_id": range(n), "n_chars": [i % 911 for i in range(n)], "source": [f"s{i % 7}" for i in range(n)]})
    pq.write_table(docs, tmp_path / "documents.parquet")
    con = duckdb.connect()
    con.register("documents", docs)
    found = con.execute(__spark_entry__.oracle_sql()[name])
    columns = [c[0] for c in found.description]
    got = __spark_entry__.queries()[name](spark, str(tmp_path)).select(*columns)
    assert sorted(map(tuple, got.collect())) == sorted(found.fetchall())
