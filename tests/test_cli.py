"""Commands end to end on small files."""

import json

import pytest

from millrace.cli import main
from millrace.operators import checks
from millrace.operators.rows import RowError
from millrace.sources import files


@pytest.fixture
def chats(tmp_path):
    path = tmp_path / "chats.jsonl"
    path.write_text("\n".join(json.dumps({"messages": [{"role": "user", "content": f"q{i}"}, {"role": "assistant", "content": f"a{i}"}], "n": i}) for i in range(12)))
    return str(path)


def test_commands(spark, tmp_path, chats):
    out = lambda name: str(tmp_path / name)
    run = lambda *a: main([str(x) for x in a], spark)
    read = lambda name: files.read_rows(spark, out(name))
    assert run("convert", chats, out("p.jsonl"), "--to", "prompt-completion") == 0
    assert set(read("p.jsonl").columns) == {"prompt", "completion", "n"}
    assert run("convert", out("p.jsonl"), out("m.parquet"), "--to", "messages") == 0 and read("m.parquet").count() == 12
    assert run("shuffle", chats, out("s.jsonl"), "--seed", 1) == 0 and sorted(r["n"] for r in read("s.jsonl").collect()) == list(range(12))
    assert run("sample", chats, out("h.jsonl"), "--n", 3, "--head") == 0 and [r["n"] for r in read("h.jsonl").orderBy("n").collect()] == [0, 1, 2]
    assert run("split", chats, out("a.jsonl"), out("b.jsonl"), "--n", 5) == 0 and (read("a.jsonl").count(), read("b.jsonl").count()) == (5, 7)
    assert run("mix", out("x.jsonl"), f"{chats}=0.5", f"{chats}=0.25", "--seed", 3) == 0 and read("x.jsonl").count() == 9
    assert run("fields", chats, out("f.jsonl"), "--add", "big=n > 5", "--remove", "messages") == 0 and read("f.jsonl").filter("big").count() == 6
    assert run("filter", chats, out("w.jsonl"), "--where", "n % 2 == 0", "--max-length", "messages=2") == 0 and read("w.jsonl").count() == 6
    assert run("pairs", chats, out("d.jsonl"), "--rejected", chats, "--strict") == 0 and set(read("d.jsonl").columns) == {"prompt", "chosen", "rejected"}
    assert run("stats", chats) == 0
    assert run("split", chats, out("a.jsonl"), out("b.jsonl"), "--n", 5) == 1
    assert run("filter", chats, out("z.jsonl"), "--where", "nothing > 1") == 1 and run("stats", out("none.jsonl")) == 1


def test_text_commands(spark, tmp_path):
    (tmp_path / "t.txt").write_text("One. Two.\n\n" * 10)
    assert main(["cpt", str(tmp_path / "t.txt"), str(tmp_path / "c.jsonl"), "--max-tokens", "10"], spark) == 0
    assert files.read_rows(spark, str(tmp_path / "c.jsonl")).count() > 2
    (tmp_path / "b.jsonl").write_text('{"a": 1,}\n{b: True}\n{"c": "cu')
    assert main(["heal", str(tmp_path / "b.jsonl"), str(tmp_path / "h.jsonl")], spark) == 0
    assert files.read_json_stream(spark, str(tmp_path / "h.jsonl")).count() == 2


def test_checks(spark):
    assert checks.check_ranges({"loss": [0, 2]}) == {"loss": (0.0, 2.0)}
    for bad in ([2, 1], [True, 2], [1], "x"):
        with pytest.raises(RowError):
            checks.check_ranges({"loss": bad})
    assert checks.merged_settings({"a": {"b": 1, "c": 2}, "d": 3}, {"a": {"b": 9}, "d": {"e": 1}}) == {"a": {"b": 9, "c": 2}, "d": {"e": 1}}
    environment = {"A": "kept"}
    assert checks.load_env("A=1\n# note\nexport B='x y'\nC=\"z", environment) == {"A": "1", "B": "x y", "C": '"z'}
    assert environment == {"A": "kept", "B": "x y", "C": '"z'}
    with pytest.raises(RowError):
        checks.load_env("nothing", {})
    df = spark.createDataFrame([("x",), (" ",)], "text string")
    with pytest.raises(RowError):
        checks.check_plain_text(df)
    checks.check_plain_text(df.limit(1))
    checks.register_functions(spark)
    assert spark.sql("SELECT label_key('  ﬁne ')").first()[0] == "fine"
