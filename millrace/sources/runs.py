"""Run folders as a source: metric records by byte ranges, and what each folder tells of its run.

``spark.read.format("runs")`` has a partition for each range of each run's metrics.jsonl. Only the folders of the runs that are
named are opened; bounds on steps are applied while lines are read.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from millrace.operators.rows import RowError
from millrace.sources import storage

# Fixed names and values of run folders.
METRICS, CONFIG, PREFLIGHT, VERIFY, LOG = "metrics.jsonl", "config.toml", "preflight.json", "verify.json", "log.txt"
PHASES = ("baseline", "scheduled", "completion")
LOG_BYTES = 65_536
REQUIRED = ("step", "log")

RECORDS = "run string, offset bigint, step bigint, max_steps bigint, epoch double, time double, eval boolean, log map<string,double>, phase string, preset string"
STATES = "run string, phase string, step bigint, max_steps bigint, checkpoints array<struct<step:bigint,eval_loss:double,best:boolean>>, config string, preflight string, verify string, log array<string>"


def checked_record(line: bytes, where: str, required: tuple[str, ...] = REQUIRED) -> dict:
    """A record of a metrics file, or an error that says where and what."""
    try:
        record = json.loads(line)
    except UnicodeDecodeError as error:
        raise RowError(f"{where}: not UTF-8") from error
    except json.JSONDecodeError as error:
        raise RowError(f"{where}: invalid JSON: {error.msg}") from error
    if not isinstance(record, dict):
        raise RowError(f"{where}: a record is not an object")
    if missing := [k for k in required if k not in record]:
        raise RowError(f"{where}: a record lacks {', '.join(missing)}")
    if not isinstance(record["log"], dict):
        raise RowError(f"{where}: log is not an object")
    if "quality" in record:
        context = record["quality"]
        if not isinstance(context, dict):
            raise RowError(f"{where}: quality is not an object")
        if context.get("phase") not in PHASES:
            raise RowError(f"{where}: quality.phase is one of {', '.join(PHASES)}")
        if not isinstance(context.get("preset"), str) or not context["preset"]:
            raise RowError(f"{where}: quality.preset names the preset of the evaluation")
    return record


def records_between(uri: str, start: int, stop: int, size: int, required: tuple[str, ...] = REQUIRED) -> Iterator[tuple[int, dict]]:
    """(offset, record) of the lines that begin in [start, stop) of a file of ``size`` bytes: blank lines and an unfinished last line are left out."""
    for at, line in storage.lines_between(uri, start, min(stop, size)):
        if at + len(line) > size:
            continue  # written after the file was listed
        if line.strip() and not line.endswith(b"\n"):
            try:
                json.loads(line)
            except ValueError:
                continue  # a writer is in the middle of it
        if line.strip():
            try:
                record = checked_record(line, "", required)
            except RowError:
                record = checked_record(line, f"{uri}: line {storage.line_number(uri, at)}", required)  # says the number
            yield at, record


#: Ranges that one task opens at most; small runs share a task.
RANGES = 200
#: Runs whose states make a batch; a log alone may have LOG_BYTES.
TOGETHER = 64


class RunPart(InputPartition):
    """Ranges (run, file, start, stop, file size) that one task reads."""

    def __init__(self, ranges: list[tuple[str, str, int, int, int]]):
        self.ranges = ranges


class RunsReader(DataSourceReader):
    """Reads the named runs (none: all) and records of steps from ``low`` to ``high``.

    These are options and no pushed filters: Spark 4.1 keeps what a Python reader was told for one query and reuses it for
    the next of the same DataFrame, even if that has no filter.
    """

    def __init__(self, path: str, most: int, names: list[str] | None, low: int | None, high: int | None):
        self.path, self.most, self.names, self.low, self.high = path.rstrip("/"), most, names, low, high

    def partitions(self) -> list[RunPart]:
        if self.names is None:
            found = storage.found_files(f"{self.path}/*/{METRICS}")
        else:  # the folders that are asked for, and no other
            found = [f for n in sorted(set(self.names)) if n and "/" not in n for f in storage.found_files(f"{self.path}/{n}/{METRICS}")]
        parts, size = [RunPart([])], 0
        for f in found:
            for a, b in storage.ranges(0, f.size, self.most):
                if parts[-1].ranges and (size + b - a > self.most or len(parts[-1].ranges) == RANGES):
                    parts.append(RunPart([]))
                    size = 0
                parts[-1].ranges.append((f.name.rsplit("/", 2)[1], f.name, a, b, f.size))
                size += b - a
        return parts

    def read(self, partition: RunPart) -> Iterator[tuple]:
        for run, uri, start, stop, size in partition.ranges:
            for at, r in records_between(uri, start, stop, size):
                step = r["step"]
                if step is not None and (self.low is not None and step < self.low or self.high is not None and step > self.high):
                    continue
                log = {k: float(v) for k, v in r["log"].items() if isinstance(v, (int, float)) and not isinstance(v, bool)}
                epoch, time = (None if r.get(k) is None else float(r[k]) for k in ("epoch", "time"))
                quality = r.get("quality") or {}
                yield run, at, step, r.get("max_steps"), epoch, time, r.get("eval"), log, quality.get("phase"), quality.get("preset")


class Runs(DataSource):
    """Format ``runs``: option path is a folder of run folders, maxBytes the size of a range, runs a JSON list of names, fromStep and toStep bounds."""

    @classmethod
    def name(cls) -> str:
        return "runs"

    def schema(self) -> str:
        return RECORDS

    def reader(self, schema) -> RunsReader:
        named, low, high = (self.options.get(k) for k in ("runs", "fromStep", "toStep"))
        return RunsReader(self.options["path"], int(self.options.get("maxBytes", str(32 << 20))), None if named is None else json.loads(named), None if low is None else int(low), None if high is None else int(high))


def read_runs(spark: SparkSession, path: str, *names: str, steps: tuple[int | None, int | None] = (None, None), most: int = 32 << 20) -> DataFrame:
    """RECORDS of the named runs under ``path``, of all if none is named, with steps between two bounds; only the folders of
    these runs are opened. Values of a log that are no numbers are left out."""
    spark.dataSource.register(Runs)
    options = {"maxBytes": most} | ({"runs": json.dumps(names)} if names else {}) | {k: v for k, v in zip(("fromStep", "toStep"), steps, strict=True) if v is not None}
    return spark.read.format("runs").options(**options).load(path)


def _json_file(uri: str) -> str | None:
    """The text of a JSON file; one that cannot be read is an error, since a half-written result is not an absent one."""
    data = storage.whole_text(uri)
    if data is None:
        return None
    try:
        json.loads(data)
    except ValueError as error:
        raise RowError(f"{uri}: not JSON: {error}") from error
    return data.decode()


def _state(folder: str, lines: int) -> tuple:
    """A row of STATES. Records are read one after the other; those of evaluations are kept by step."""
    uri = f"{folder}/{METRICS}"
    last, losses = None, {}
    system, path = storage.system_of(folder)
    inside = system.get_file_info(storage.fs.FileSelector(path))
    files = {i.base_name: i.size for i in inside if i.type == storage.fs.FileType.File}
    if METRICS in files:
        for _, r in records_between(uri, 0, files[METRICS], files[METRICS]):
            last = (r["step"], r.get("max_steps"))
            if r.get("eval") and r["log"].get("eval_loss") is not None:
                losses[r["step"]] = float(r["log"]["eval_loss"])
    steps = sorted(int(m[1]) for i in inside if i.type == storage.fs.FileType.Directory and (m := re.fullmatch(r"checkpoint-(\d+)", i.base_name)))
    best = min((losses[s] for s in steps if s in losses), default=None)
    checkpoints = [{"step": s, "eval_loss": losses.get(s), "best": s in losses and losses[s] == best} for s in steps]
    verify, preflight = (_json_file(f"{folder}/{name}") if name in files else None for name in (VERIFY, PREFLIGHT))
    if verify is not None:
        phase = "verified"
    elif last is None:
        phase = "starting"
    else:
        phase = "trained" if last[1] and last[0] >= last[1] else "training"
    config = storage.whole_text(f"{folder}/{CONFIG}") if CONFIG in files else None
    step, most = last or (None, None)
    return folder.rsplit("/", 1)[1], phase, step, most, checkpoints, config.decode() if config is not None else None, preflight, verify, _log(f"{folder}/{LOG}", lines) if LOG in files else []


def _log(uri: str, lines: int) -> list[str]:
    """The last lines of a log, from its last LOG_BYTES; a line that is cut at the front is left out."""
    if not storage.exists(uri) or lines < 1:
        return []
    system, path = storage.system_of(uri)
    with system.open_input_file(path) as f:
        size = f.size()
        text = f.read_at(min(size, LOG_BYTES), max(0, size - LOG_BYTES)).decode("utf-8", "replace")
    return text.splitlines()[size > LOG_BYTES :][-lines:]


def run_states(spark: SparkSession, path: str, lines: int = 100) -> DataFrame:
    """STATES of each folder under ``path``: phase, last step, checkpoints with the loss of their step (the least is best), texts of
    config, preflight and verify, and the end of the log. Folders are dealt to tasks, each read by one."""
    system, at = storage.system_of(path.rstrip("/"))
    names = sorted(i.base_name for i in system.get_file_info(storage.fs.FileSelector(at)) if i.type == storage.fs.FileType.Directory)
    root = path.rstrip("/")
    columns = [c.split()[0] for c in re.split(r", (?=\w+ )", STATES)]
    checkpoint = pa.list_(pa.struct([("step", pa.int64()), ("eval_loss", pa.float64()), ("best", pa.bool_())]))
    kinds = [pa.string(), pa.string(), pa.int64(), pa.int64(), checkpoint, pa.string(), pa.string(), pa.string(), pa.list_(pa.string())]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = batch.column("run").to_pylist()
            for i in range(0, len(found), TOGETHER):
                rows = [_state(f"{root}/{name}", lines) for name in found[i : i + TOGETHER]]
                yield pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(zip(*rows, strict=True), kinds, strict=True)], columns)

    listed = spark.createDataFrame([(n,) for n in names], "run string").repartition("run")
    return listed.mapInArrow(run, STATES)
