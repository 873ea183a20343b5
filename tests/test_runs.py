"""Run folders, tails and rounds on file systems that pyarrow opens."""

import json
import os

import pytest
from pyarrow import fs
from pyspark.sql import functions as F

from millrace.sources import runs, storage
from millrace.streaming import metrics, rounds


def put(path, data):
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(path, "wb") as f:
        f.write(data if isinstance(data, bytes) else data.encode())


def record(step, **more):
    return json.dumps({"step": step, "log": {"loss": step / 2}} | more) + "\n"


# storage


def test_globs_and_ranges_of_lines(tmp_path):
    for name in ("a/m.jsonl", "b/m.jsonl", "b/other.txt", "b/deep/m.jsonl"):
        put(f"{tmp_path}/{name}", "x\n")
    for base in (str(tmp_path), f"file://{tmp_path}"):
        assert [f.name for f in storage.found_files(f"{base}/*/m.jsonl")] == [f"{base}/a/m.jsonl", f"{base}/b/m.jsonl"]
        assert [f.name for f in storage.found_files(f"{base}/b/*")] == [f"{base}/b/m.jsonl", f"{base}/b/other.txt"]
        assert storage.found_files(f"{base}/none/*") == [] and [f.size for f in storage.found_files(f"{base}/a/m.jsonl")] == [2]
    data = b"one\n\nthree is longer\r\nfour\rstill four\nlast"
    put(f"{tmp_path}/r.txt", data)
    uri = f"{tmp_path}/r.txt"
    want, at = [], 0
    for line in data.split(b"\n"):
        want.append((at, line + b"\n" if at + len(line) < len(data) else line))
        at += len(line) + 1
    for most in (1, 3, 7, 1000):
        assert [x for a, b in storage.ranges(0, len(data), most) for x in storage.lines_between(uri, a, b)] == want
    assert storage.end_of_lines(uri, len(data)) == data.rindex(b"\n") + 1 and storage.end_of_lines(uri, 3) == 0
    assert [storage.line_number(uri, a) for a, _ in want] == [1, 2, 3, 4, 5]


def test_small_blocks(tmp_path, monkeypatch):
    monkeypatch.setattr(storage, "BLOCK", 5)
    test_globs_and_ranges_of_lines(tmp_path)


# runs


def test_records_of_runs(spark, tmp_path):
    put(f"{tmp_path}/r1/metrics.jsonl", "".join(record(i, time=1.5) for i in range(200)) + "\n  \n" + record(200, eval=True, quality={"phase": "baseline", "preset": "p"}) + '{"step": 3, "lo')
    put(f"{tmp_path}/r2/metrics.jsonl", record(5).rstrip("\n"))
    put(f"{tmp_path}/r3/metrics.jsonl", "")
    put(f"{tmp_path}/r4/log.txt", "none")
    df = runs.read_runs(spark, f"file://{tmp_path}", most=500)
    assert df.groupBy("run").count().orderBy("run").collect() == [("r1", 201), ("r2", 1)]
    assert df.rdd.getNumPartitions() > 10
    assert df.filter("eval").select("step", "phase", "preset").collect() == [(200, "baseline", "p")]
    assert df.filter("run = 'r1' AND step BETWEEN 10 AND 12").agg(F.sum(F.col("log")["loss"])).first()[0] == 16.5


def test_a_filter_on_one_run_opens_one_folder(spark, tmp_path):
    put(f"{tmp_path}/good/metrics.jsonl", record(1))
    put(f"{tmp_path}/bad/metrics.jsonl", "broken\n")
    path = f"file://{tmp_path}"
    assert runs.read_runs(spark, path, "good").count() == 1 and runs.read_runs(spark, path, "good", "none", "..").count() == 1
    with pytest.raises(Exception, match="bad/metrics.jsonl: line 1: invalid JSON"):
        runs.read_runs(spark, path).count()
    assert runs.read_runs(spark, path, "good", steps=(2, None)).count() == 0 and runs.read_runs(spark, path, "good", steps=(1, 1)).count() == 1


@pytest.mark.parametrize(
    "line, said",
    [("[1]", "not an object"), ('{"step": 1}', "lacks log"), ('{"step": 1, "log": 2}', "log is not an object"), ('{"step": 1, "log": {}, "quality": 1}', "quality is not"), ('{"step": 1, "log": {}, "quality": {"phase": "x", "preset": "p"}}', "quality.phase"), ('{"step": 1, "log": {}, "quality": {"phase": "baseline", "preset": ""}}', "quality.preset")],
)
def test_bad_records_are_named(spark, tmp_path, line, said):
    put(f"{tmp_path}/r/metrics.jsonl", record(1) + "\n" + line + "\n" + record(2))
    with pytest.raises(Exception, match=f"line 3: .*{said}"):
        runs.read_runs(spark, f"file://{tmp_path}", most=20).collect()


def test_states(spark, tmp_path):
    put(f"{tmp_path}/new/config.toml", "a = 1")
    put(f"{tmp_path}/new/log.txt", "x" * 70_000 + "\nlast but one\nlast\n")
    put(f"{tmp_path}/going/metrics.jsonl", record(10, max_steps=20) + json.dumps({"step": 10, "eval": True, "log": {"eval_loss": 2.0}}) + "\n" + json.dumps({"step": 15, "eval": True, "max_steps": 20, "log": {"eval_loss": 1.0}}) + "\n")
    for step in (15, 5, 10):
        os.makedirs(f"{tmp_path}/going/checkpoint-{step}")
    put(f"{tmp_path}/done/metrics.jsonl", record(20, max_steps=20))
    put(f"{tmp_path}/checked/verify.json", '{"ok": true}')
    got = {r["run"]: r for r in runs.run_states(spark, f"file://{tmp_path}").collect()}
    assert {k: r["phase"] for k, r in got.items()} == {"new": "starting", "going": "training", "done": "trained", "checked": "verified"}
    assert [tuple(c) for c in got["going"]["checkpoints"]] == [(5, None, False), (10, 2.0, False), (15, 1.0, True)]
    assert got["new"]["config"] == "a = 1" and got["new"]["log"] == ["last but one", "last"] and json.loads(got["checked"]["verify"]) == {"ok": True}
    put(f"{tmp_path}/checked/preflight.json", '{"ok": tr')
    with pytest.raises(Exception, match="preflight.json: not JSON"):
        runs.run_states(spark, f"file://{tmp_path}").collect()


# tails


def test_both_tails_give_the_same_lines_on_another_file_system(tmp_path, monkeypatch):
    other = fs.SubTreeFileSystem(str(tmp_path), fs.LocalFileSystem())
    known = storage.system_of
    monkeypatch.setattr(storage, "system_of", lambda uri: (other, uri.removeprefix("other://")) if uri.startswith("other://") else known(uri))
    put(f"{tmp_path}/in/a.jsonl", "one\rstill one\ntwo\r\n" + "long " * 40 + "\nunfinished")
    put(f"{tmp_path}/in/b.jsonl", "three\n")
    want = [("a.jsonl", 0, "one\rstill one"), ("a.jsonl", 14, "two"), ("a.jsonl", 19, "long " * 40), ("b.jsonl", 0, "three")]
    for base in ("other://", f"file://{tmp_path}/", f"{tmp_path}/"):
        shared = metrics.SharedTailReader(f"{base}in/*.jsonl", 16, None)
        start, end = shared.initialOffset(), shared.latestOffset()
        parts = shared.partitions(start, end)
        assert len(parts) > 10  # one file is read by several tasks
        assert [(n.rsplit("/", 1)[1], o, line) for p in parts for n, o, line in shared.read(p)] == want
        simple, got, offset = metrics.TailReader(f"{base}in/*.jsonl", 64), [], {}
        for _ in range(6):
            rows, after = simple.read(offset)
            rows = list(rows)
            assert sorted(rows) == sorted(simple.readBetweenOffsets(offset, after))
            got, offset = got + rows, after
        assert sorted((n.rsplit("/", 1)[1], o, line) for n, o, line in got) == want


def test_finished_and_deleted_files_leave_the_offset(tmp_path):
    put(f"{tmp_path}/old.jsonl", "a\n")
    put(f"{tmp_path}/cut.jsonl", "b\nunfinished")
    put(f"{tmp_path}/gone.jsonl", "c\n")
    for name in ("old", "cut", "gone"):
        os.utime(f"{tmp_path}/{name}.jsonl", (1000, 1000))
    reader = metrics.SharedTailReader(f"{tmp_path}/*.jsonl", 100, 60.0)
    first = reader.latestOffset()
    assert len(first["files"]) == 3
    os.remove(f"{tmp_path}/gone.jsonl")
    put(f"{tmp_path}/new.jsonl", "d\n")
    second = reader.latestOffset()
    names = lambda offset: {n.rsplit("/", 1)[1] for n in offset["files"]}
    assert "gone.jsonl" not in names(second) and {"cut.jsonl", "new.jsonl"} <= names(second)
    assert [line for p in reader.partitions(first, second) for _, _, line in reader.read(p)] == ["d"]
    put(f"{tmp_path}/cut.jsonl", "b\nunfinished no more\n")
    third, fourth = reader.latestOffset(), reader.latestOffset()
    assert [line for p in reader.partitions(second, third) for _, _, line in reader.read(p)] == ["unfinished no more"]
    assert names(fourth) == {"cut.jsonl", "new.jsonl"} and fourth["finished"] >= 1000
    again = metrics.SharedTailReader(f"{tmp_path}/*.jsonl", 100, 60.0)  # a restart lists all files, and the start offset tells what is finished
    assert [p for p in again.partitions(fourth, again.latestOffset())] == []


# rounds


def test_a_round_is_published_once(spark, tmp_path):
    folder, schema = f"file://{tmp_path}/out", "round_id long, score double"
    source = tmp_path / "in"
    source.mkdir()
    (source / "0.json").write_text("".join(json.dumps({"round_id": i, "score": i / 4}) + "\n" for i in range(20)))
    stream = lambda: spark.readStream.schema(schema).json(f"file://{source}").repartition(3)
    rounds.append_rounds(stream(), folder, f"file://{tmp_path}/check").awaitTermination(60)
    assert rounds.read_rounds(spark, folder, schema).agg(F.count("*"), F.sum("round_id")).first() == (20, 190)
    rounds.append_rounds(stream(), folder, f"file://{tmp_path}/check-lost").awaitTermination(60)  # the same batch again, after its checkpoint is lost
    assert rounds.read_rounds(spark, folder, schema).count() == 20
    assert len([n for n in os.listdir(tmp_path / "out") if n.endswith(".jsonl")]) == len(json.loads((tmp_path / "out/_rounds" / f"{0:020d}.json").read_text())["files"])


def test_a_failure_between_stage_and_commit_leaves_nothing_to_read(spark, tmp_path):
    writer = rounds.RoundsWriter(f"file://{tmp_path}/out")
    staged = [writer.write(iter([("{\"a\": 1}",)])), writer.write(iter([])), None]
    assert rounds.read_rounds(spark, f"file://{tmp_path}/out", "a long").count() == 0  # staged, and then the driver is lost
    again = [writer.write(iter([("{\"a\": 1}",)])), writer.write(iter([]))]
    writer.commit(again, 7)
    assert [tuple(r) for r in rounds.read_rounds(spark, f"file://{tmp_path}/out", "a long").collect()] == [(1, 7)]
    writer.commit([writer.write(iter([("{\"a\": 1}",)]))], 7)
    writer.abort(staged, 7)
    assert [tuple(r) for r in rounds.read_rounds(spark, f"file://{tmp_path}/out", "a long").collect()] == [(1, 7)]
    assert len([n for n in os.listdir(tmp_path / "out") if n.endswith(".jsonl")]) == 1
