"""Stage stacks, throttled counts and notices of silence, by both clocks."""

import json
import os
import time

import pytest

from millrace.streaming import stages


@pytest.fixture
def rocks(spark):
    name = "spark.sql.streaming.stateStore.providerClass"
    spark.conf.set(name, stages.PROVIDER)
    yield spark
    spark.conf.unset(name)


def put(folder, number, events):
    rows = [{"source": s, "at": f"2026-01-01T00:{int(at) // 60:02}:{at % 60:06.3f}Z", "seq": i, "kind": kind} | more for i, (s, at, kind, more) in enumerate(events)]
    with open(f"{folder}/{number}.tmp", "w") as f:
        f.write("".join(json.dumps(r) + "\n" for r in rows))
    os.rename(f"{folder}/{number}.tmp", f"{folder}/{number}.json")


def run(spark, folder, tmp_path, name, trigger, **how):
    events = spark.readStream.schema(stages.EVENTS).option("pathGlobFilter", "*.json").option("maxFilesPerTrigger", 1).json(f"file://{folder}")
    out = stages.stage_notices(events, **how)
    return out.writeStream.format("memory").queryName(name).outputMode("append").option("checkpointLocation", f"file://{tmp_path}/check-{name}").trigger(**trigger).start()


EVENTS = [
    ("a", 0.0, "start", {"label": "load", "total": 100, "unit": "rows"}),
    ("a", 0.5, "count", {"label": "load", "completed": 10}),
    ("a", 0.9, "count", {"label": "load", "completed": 20}),  # within a second of the last one shown
    ("a", 2.0, "count", {"label": "load", "completed": 30}),
    ("a", 3.0, "start", {"label": "parse"}),
    ("a", 4.0, "fail", {"label": "parse"}),
    ("a", 26.5, "end", {"label": "load"}),
    ("b", 1.0, "count", {"label": "never begun", "completed": 1}),
    ("b", 1.5, "note", {"message": "hello"}),
    ("b", 2.0, "start", {"label": "wait"}),
    ("c", 60.0, "note", {"message": "late"}),
]
WANT = [
    ("a", 0.0, "start", "load; 0/100 rows"),
    ("a", 0.5, "count", "load; 10/100 rows"),
    ("a", 2.0, "count", "load; 30/100 rows"),
    ("a", 3.0, "start", "parse"),
    ("a", 4.0, "fail", "parse; failed in 1.0s"),
    ("a", 14.0, "waiting", "waiting: load; 30/100 rows; stage elapsed 14.0s; last measured progress 12.0s ago"),
    ("a", 24.0, "waiting", "waiting: load; 30/100 rows; stage elapsed 24.0s; last measured progress 22.0s ago"),
    ("a", 26.5, "end", "load; 30/100 rows; finished in 26.5s"),
    ("b", 1.5, "note", "hello"),
    ("b", 2.0, "start", "wait"),
    *[("b", 2.0 + 10 * k, "waiting", f"waiting: wait; stage elapsed {10 * k:.1f}s; no measured progress yet") for k in range(1, 6)],
    ("c", 60.0, "note", "late"),
]


@pytest.mark.parametrize("batches", [1, 3])
def test_notices_by_event_time(rocks, tmp_path, batches):
    folder = tmp_path / "events"
    folder.mkdir()
    ordered = sorted(EVENTS, key=lambda e: e[1])
    for i in range(batches):
        put(folder, i, ordered[i * len(ordered) // batches : (i + 1) * len(ordered) // batches])
        os.utime(folder / f"{i}.json", (1000 + i, 1000 + i))
    name = f"notices{batches}"
    run(rocks, folder, tmp_path, name, {"availableNow": True}, clock="event").awaitTermination(120)
    start = 1767225600.0
    got = sorted((r["source"], round(r["at"] - start, 3), r["kind"], r["text"]) for r in rocks.table(name).collect())
    assert got == sorted(WANT)


def test_silence_is_noticed_without_a_new_event(rocks, tmp_path):
    folder = tmp_path / "events"
    folder.mkdir()
    put(folder, 0, [("a", 0.0, "start", {"label": "load"}), ("b", 0.0, "note", {"message": "x"})])
    query = run(rocks, folder, tmp_path, "silence", {"processingTime": "200 milliseconds"}, wait=1.0)
    try:
        end = time.time() + 90
        while time.time() < end and rocks.table("silence").filter("kind = 'waiting'").count() < 2:
            time.sleep(0.5)
        put(folder, 1, [("a", 9.0, "end", {"label": "load"})])
        while time.time() < end and rocks.table("silence").filter("kind = 'end'").count() < 1:
            time.sleep(0.5)
        done = rocks.table("silence").filter("kind = 'waiting'").count()
        time.sleep(3)
        rows = rocks.table("silence").orderBy("at").collect()
    finally:
        query.stop()
    waits = [r["at"] for r in rows if r["kind"] == "waiting"]
    assert len(waits) == done >= 2 and all(b - a > 0.9 for a, b in zip(waits, waits[1:]))
    assert {r["source"] for r in rows if r["kind"] == "waiting"} == {"a"}
