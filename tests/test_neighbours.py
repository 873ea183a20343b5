"""Scores of neighbouring documents: each one's words are listed once."""

import pytest

import __spark_entry__


def test_neighbours_over_borders_gaps_and_repeats(spark, tmp_path):
    duckdb = pytest.importorskip("duckdb")
    ids = [*range(60, 70), 70, 70, 71, 127, 128, 130, 191, 192, 193]
    rows = [(i, " ".join(f"w{(i * k) % 5}" for k in range(n % 7))) for n, i in enumerate(ids)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{tmp_path}/documents.parquet/*.parquet')")
    once = ",".join(str(i) for i in ids if i not in (69, 70, 71))  # the SQL adds up the words of rows that share an id
    want = con.execute(f"SELECT doc_id, f1 FROM ({__spark_entry__.oracle_sql()['token_f1_all']}) WHERE doc_id IN ({once})").fetchall()
    got = __spark_entry__.queries()["token_f1_all"](spark, str(tmp_path))
    assert got._jdf.queryExecution().executedPlan().toString().count("Exchange ") == 1
    found = [tuple(r) for r in got.collect()]
    assert sorted(r for r in found if r[0] not in (69, 70, 71)) == sorted((i, pytest.approx(f)) for i, f in want)
    assert sorted(i for i, _ in found if i in (69, 70, 71)) == [69, 69, 70, 70]
