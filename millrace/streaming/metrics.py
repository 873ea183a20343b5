"""Metric records as streams: the tail of growing files, last values by metric, repeated events."""

from __future__ import annotations

import time
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition, SimpleDataSourceStreamReader
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from millrace.sources import storage

SCHEMA = "file string, offset bigint, line string"


def _line(data: bytes) -> str:
    return data.decode("utf-8").rstrip("\r\n")


class TailReader(SimpleDataSourceStreamReader):
    """Whole new lines of files that grow; a last line without its newline waits until it is complete."""

    def __init__(self, pattern: str, most: int):
        self.pattern, self.most = pattern, most

    def initialOffset(self) -> dict:
        return {}

    def read(self, start: dict) -> tuple[Iterator[tuple], dict]:
        rows, end = [], {}
        for f in storage.found_files(self.pattern):  # files that are gone leave the offset
            at = end[f.name] = start.get(f.name, 0)
            stop = at + self.most
            for offset, line in storage.lines_between(f.name, at, min(stop, f.size), at):
                if line.endswith(b"\n") and (offset + len(line) <= stop or offset == at):  # a line may be longer than a read
                    rows.append((f.name, offset, _line(line)))
                    end[f.name] = offset + len(line)
        return iter(rows), end

    def readBetweenOffsets(self, start: dict, end: dict) -> Iterator[tuple]:
        for name, stop in sorted(end.items()):
            at = start.get(name, 0)
            for offset, line in storage.lines_between(name, at, stop, at):
                yield name, offset, _line(line)

    def commit(self, end: dict) -> None:
        pass


class Tail(DataSource):
    """Format ``tail``: option path is a glob of files that one writer appends to, as a run's metrics are; the driver reads them."""

    @classmethod
    def name(cls) -> str:
        return "tail"

    def schema(self) -> str:
        return SCHEMA

    def simpleStreamReader(self, schema) -> TailReader:
        return TailReader(self.options["path"], int(self.options.get("maxBytes", str(8 << 20))))


class FilePart(InputPartition):
    """Lines of one file that begin from one byte to another; ``base`` is where the batch begins in it."""

    def __init__(self, name: str, start: int, stop: int, base: int):
        self.name, self.start, self.stop, self.base = name, start, stop, base


class SharedTailReader(DataSourceStreamReader):
    """The same lines read by the executors, a file by several of them: the driver only looks for the last newline of each file.

    An offset holds, for each file, its bytes and the time of its last change. With ``finished`` seconds, a file that was
    read to its end and has not changed for so long leaves the offset, which keeps the time up to which that holds;
    such files must not grow any more. Files that are gone leave it too.
    """

    def __init__(self, pattern: str, most: int, finished: float | None):
        self.pattern, self.most, self.finished = pattern, most, finished
        self.before: dict = {}

    def initialOffset(self) -> dict:
        return {"files": {}, "finished": 0.0}

    def latestOffset(self) -> dict:
        known = self.before.get("files", {})
        floor = self.before.get("finished", 0.0)
        listed, ends = storage.found_files(self.pattern), {}
        for f in listed:
            if f.name not in known and f.changed <= floor:
                continue
            old = known.get(f.name)
            ends[f.name] = [old[0] if old and old[0] == f.size else storage.end_of_lines(f.name, f.size), f.changed]
        if self.finished is not None:
            sizes = {f.name: f.size for f in listed}
            done = {n for n, (at, _) in ends.items() if at == sizes[n] and known.get(n, [None])[0] == at}
            limit = min([time.time() - self.finished, *[changed - 1e-6 for n, (_, changed) in ends.items() if n not in done]])
            floor = max(floor, limit)
            ends = {n: e for n, e in ends.items() if n not in done or e[1] > floor}
        self.before = {"files": ends, "finished": floor}
        return self.before

    def partitions(self, start: dict, end: dict) -> list[FilePart]:
        parts = []
        for name, (stop, changed) in sorted(end["files"].items()):
            if name not in start["files"] and changed <= start["finished"]:
                continue
            at = start["files"].get(name, [0])[0]
            parts += [FilePart(name, a, b, at) for a, b in storage.ranges(at, stop, self.most)]
        return parts

    def read(self, partition: FilePart) -> Iterator[tuple]:
        for offset, line in storage.lines_between(partition.name, partition.start, partition.stop, partition.base):
            yield partition.name, offset, _line(line)

    def commit(self, end: dict) -> None:
        pass


class SharedTail(DataSource):
    """Format ``shared_tail``: option path is a glob of files that the driver and all executors reach, maxBytes the part of a file
    that one task reads, finishedAfter the seconds after which a file that does not change is finished (none: never)."""

    @classmethod
    def name(cls) -> str:
        return "shared_tail"

    def schema(self) -> str:
        return SCHEMA

    def streamReader(self, schema) -> SharedTailReader:
        finished = self.options.get("finishedAfter")
        return SharedTailReader(self.options["path"], int(self.options.get("maxBytes", str(32 << 20))), None if finished is None else float(finished))


def shared_tail(spark: SparkSession, pattern: str, **options: object) -> DataFrame:
    spark.dataSource.register(SharedTail)
    return spark.readStream.format("shared_tail").options(path=pattern, **options).load()


def tail(spark: SparkSession, pattern: str) -> DataFrame:
    spark.dataSource.register(Tail)
    return spark.readStream.format("tail").option("path", pattern).load()


def state_view(values: DataFrame, path: str, checkpoint: str):
    """Keep (file, metric, n, step, last) of all that a stream of metric_values() has brought, written anew with each batch."""
    last = F.max_by(F.struct("step", "value"), F.struct("step", "offset"))
    state = values.groupBy("file", "metric").agg(F.count("*").alias("n"), last.alias("l")).select("file", "metric", "n", "l.step", F.col("l.value").alias("last"))

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(path)

    return state.writeStream.outputMode("complete").foreachBatch(write).option("checkpointLocation", checkpoint).start()


def metric_values(lines: DataFrame) -> DataFrame:
    """(file, offset, step, metric, value) of lines that are records."""
    record = F.from_json("line", "step bigint, log map<string,double>")
    return lines.filter(F.length(F.trim("line")) > 0).select("file", "offset", record.alias("r")).select("file", "offset", "r.step", F.explode("r.log").alias("metric", "value"))


def with_changes(values: DataFrame) -> DataFrame:
    """(file, metric, step, value, change, baseline): each value against the one before and the first finite one, by file and metric."""

    def advance(key, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        before, baseline = state.get if state.exists else (None, None)
        rows = []
        for batch in batches:
            for offset, step, value in sorted(zip(batch["offset"], batch["step"], batch["value"], strict=True)):
                if baseline is None and value == value and abs(value) != float("inf"):
                    baseline = float(value)
                rows.append((*key, int(step), float(value), None if before is None else float(value) - before, baseline))
                before = float(value)
        state.update((before, baseline))
        yield pd.DataFrame(rows, columns=["file", "metric", "step", "value", "change", "baseline"])

    return values.groupBy("file", "metric").applyInPandasWithState(advance, "file string, metric string, step bigint, value double, change double, baseline double", "before double, baseline double", "append", GroupStateTimeout.NoTimeout)


def throttled(events: DataFrame, source: str, at: str, count: str, gap: float = 1.0) -> DataFrame:
    """(source, at, count): progress counts of each source, at most one in ``gap`` seconds of event time, the last always kept in state."""

    def advance(key, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        (last,) = state.get if state.exists else (float("-inf"),)
        rows = []
        for batch in batches:
            for when, n in sorted(zip(batch[at], batch[count], strict=True)):
                if when - last >= gap:
                    rows.append((*key, float(when), int(n)))
                    last = float(when)
        state.update((last,))
        yield pd.DataFrame(rows, columns=["source", "at", "count"])

    chosen = events.select(F.col(source).alias("source"), F.col(at).cast("double").alias(at), F.col(count).cast("bigint").alias(count))
    return chosen.groupBy("source").applyInPandasWithState(advance, "source string, at double, count bigint", "last double", "append", GroupStateTimeout.NoTimeout)


def silences(events: DataFrame, by: str, at: str, seconds: float) -> DataFrame:
    """(by, from, to): gaps of more than ``seconds`` between neighbours of a finished log."""
    from pyspark.sql import Window

    after = F.lead(at).over(Window.partitionBy(by).orderBy(at))
    return events.select(by, F.col(at).alias("from"), after.alias("to")).filter(F.col("to").cast("timestamp").cast("double") - F.col("from").cast("timestamp").cast("double") > seconds)


def distinct_events(events: DataFrame, *keys: str, watermark: tuple[str, str] | None = None) -> DataFrame:
    """One event of each key; with a watermark (column, delay) the state is dropped when it has passed."""
    if watermark:
        return events.withWatermark(*watermark).dropDuplicatesWithinWatermark(list(keys))
    return events.dropDuplicates(list(keys))


def request_states(events: DataFrame) -> DataFrame:
    """(state, n): requests by the state of their last event."""
    return events.groupBy("request").agg(F.max_by("state", "seq").alias("state")).groupBy("state").agg(F.count("*").alias("n"))
