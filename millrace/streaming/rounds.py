"""Complete rounds appended exactly once: tasks stage files, a commit publishes them by a manifest with the batch's number.

A reader sees only files that a manifest names. A batch that is run again after its manifest was written adds nothing; one
that failed before it leaves files that nobody reads.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

from pyarrow import fs
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceStreamWriter, WriterCommitMessage

from millrace.sources import storage

LINE = "line string"


@dataclass
class Staged(WriterCommitMessage):
    name: str | None
    rows: int


def _manifest(folder: str, number: int) -> str:
    return f"{folder}/_rounds/{number:020d}.json"


class RoundsWriter(DataSourceStreamWriter):
    def __init__(self, folder: str):
        self.folder = folder.rstrip("/")

    def write(self, iterator: Iterator[Row]) -> Staged:
        system, path = storage.system_of(self.folder)
        name, out, rows = f"{uuid.uuid4().hex}.jsonl", None, 0  # a name of its own for each attempt
        for row in iterator:
            if out is None:
                system.create_dir(path, recursive=True)
                out = system.open_output_stream(f"{path}/{name}", compression=None)
            out.write(row[0].encode() + b"\n")
            rows += 1
        if out is not None:
            out.close()
        return Staged(name if rows else None, rows)

    def commit(self, messages: list[Staged | None], batchId: int) -> None:
        target = _manifest(self.folder, batchId)
        if storage.exists(target):
            self.abort(messages, batchId)  # this round is there already
            return
        system, path = storage.system_of(target)
        system.create_dir(path.rsplit("/", 1)[0], recursive=True)
        with system.open_output_stream(path + ".new", compression=None) as f:
            f.write(json.dumps({"files": sorted(m.name for m in messages if m and m.name), "rows": sum(m.rows for m in messages if m)}).encode())
        system.move(path + ".new", path)  # whole or not at all

    def abort(self, messages: list[Staged | None], batchId: int) -> None:
        system, path = storage.system_of(self.folder)
        for m in messages:
            if m and m.name and system.get_file_info(f"{path}/{m.name}").type == fs.FileType.File:
                system.delete_file(f"{path}/{m.name}")


class Rounds(DataSource):
    """Format ``rounds``, to be written as a stream of one column of lines; option path is a folder that all tasks share."""

    @classmethod
    def name(cls) -> str:
        return "rounds"

    def schema(self) -> str:
        return LINE

    def streamWriter(self, schema, overwrite: bool) -> RoundsWriter:
        return RoundsWriter(self.options["path"])


def append_rounds(rounds: DataFrame, path: str, checkpoint: str):
    """Append the rows of a stream as JSON lines, each batch once; the running query."""
    rounds.sparkSession.dataSource.register(Rounds)
    lines = rounds.select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("line"))
    return lines.writeStream.format("rounds").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def read_rounds(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """All published rows, with ``round``, the number of their batch. Manifests name files one for each task; the driver reads their names."""
    folder = path.rstrip("/")
    named = []
    for f in storage.found_files(f"{folder}/_rounds/*.json"):
        number = int(f.name.rsplit("/", 1)[1].removesuffix(".json"))
        named += [(n, number) for n in json.loads(storage.whole_text(f.name))["files"]]
    if not named:
        return spark.createDataFrame([], f"{schema}, round bigint")
    rows = spark.read.schema(schema).json([f"{folder}/{n}" for n, _ in named]).withColumn("__file", F.col("_metadata.file_name"))
    numbers = spark.createDataFrame(named, "__file string, round bigint")
    return rows.join(numbers, "__file").drop("__file")
