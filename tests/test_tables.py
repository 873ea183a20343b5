"""Table functions called from SQL."""

import pytest

from millrace.operators import checks
from millrace.operators.chunking import chunks
from millrace.operators.repair import heal_line


@pytest.fixture(scope="module")
def sql(spark):
    checks.register_functions(spark)
    return lambda text, **tables: spark.sql(text, **tables)


def test_chunks(spark, sql):
    rows = [("a", "One. Two.\n\n" * 20, 1), ("b", None, 2), ("c", "", 3), ("d", "word", 4), ("a", "again", 5)]
    docs = spark.createDataFrame(rows, "Name string, Body string, chunk_no long").repartition(3)
    got = sql("SELECT * FROM chunk_text(TABLE({docs}), key => 'name', text => 'body', most => 10)", docs=docs)
    assert got.dtypes == [("Name", "string"), ("chunk_no", "bigint"), ("chunk", "string")]
    assert sorted(map(tuple, got.collect())) == sorted((n, i, c) for n, t, _ in rows for i, c in enumerate(chunks(t or "", 10)))
    assert sql("SELECT * FROM chunk_text(TABLE({docs}), key => 'name', text => 'body', most => 10)", docs=docs.limit(0)).count() == 0


def test_rows_do_not_each_become_a_batch(sql):
    lines = "(SELECT id % 7 AS file, id AS n, '{\"k\": 1,}' AS line FROM range(50))"
    plan = sql(f"SELECT * FROM heal(TABLE({lines[1:-1]}) PARTITION BY file ORDER BY n, key => 'file', number => 'n', line => 'line')")._jdf.queryExecution().executedPlan().toString()
    assert "BatchEvalPythonUDTF" in plan and "ArrowEvalPythonUDTF" not in plan


@pytest.mark.parametrize(
    "call, said",
    [
        ("chunk_text(TABLE({docs}), key => 'none', text => 'body', most => 10)", "no column none"),
        ("chunk_text(TABLE({docs}), key => 'name', text => 'n', most => 10)", "column n is bigint"),
        ("chunk_text(TABLE({docs}), key => 'name', text => 'body', most => 0)", "1 or more"),
        ("heal(TABLE({docs}) PARTITION BY name, key => 'name', number => 'body', line => 'body')", "column body is string"),
        ("md_sections('x', key => 'name', text => 'body')", "is a table"),
    ],
)
def test_refusals_name_the_column(spark, sql, call, said):
    docs = spark.createDataFrame([("a", "b", 1)], "name string, body string, n long")
    with pytest.raises(Exception, match=said):
        sql(f"SELECT * FROM {call}", docs=docs).collect()


def test_heal_by_file(spark, sql):
    lines = {
        "cut": ['{"a": 1,}', "{b: True}", '{"c": "cu'],
        "blank end": ['{"a": 1}', '{"c": "cu', "", "  "],
        "cut within": ['{"c": "cu', '{"a": 1}{"b": 2}'],
        "one": ['{"c": "cu'],
    }
    df = spark.createDataFrame([(f, i, t) for f, ts in lines.items() for i, t in enumerate(ts)], "file string, n int, t string").repartition(4)
    got = sql("SELECT * FROM heal(TABLE({df}) PARTITION BY file ORDER BY n, key => 'file', number => 'n', line => 't')", df=df).collect()
    want = []
    for file, texts in lines.items():
        last = max(i for i, t in enumerate(texts) if t.strip())
        for i, text in enumerate(texts):
            healed, repairs, error = heal_line(text, i == last)
            want += [(file, i, p, x, repairs, error) for p, x in list(enumerate(healed)) or [(-1, None)]]
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, want))


def test_sections(spark, sql):
    docs = spark.createDataFrame([(1, "# A\nx\n## B\n```\n# no\n```"), (2, None), (3, "no heading")], "id int, t string")
    got = sql("SELECT id, heading, level, first_line, end_line FROM md_sections(TABLE({docs}), key => 'id', text => 't')", docs=docs).collect()
    assert sorted(map(tuple, got)) == [(1, "A", 1, 0, 6), (1, "B", 2, 2, 6)]
